import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_parts(tmp_path):
    """Copied without them, the entry still imports and offers the other queries."""
    import shutil

    keep = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
    pytest = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    found = subprocess.run([*pytest, "--collect-only", "tests"], cwd=tmp_path / "repo", check=True, timeout=300, capture_output=True, text=True).stdout
    assert "test_engine.py" in found and "llm" not in found.replace("without_the_llm", "").replace("knows_the_llm", "")
    subprocess.run([*pytest, "tests/test_properties.py", "tests/test_engine.py", "-k", "properties or viewports or known_samples"], cwd=tmp_path / "repo", check=True, timeout=300)


def test_only_the_entry_knows_the_llm_parts():
    for path in (ROOT / "pointlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
