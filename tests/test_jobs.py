"""Builds on request: refusals, one build for many callers, builds that were stopped."""

import time

import pytest

from pointlens.operators import curves
from pointlens.operators.sampling import configured
from pointlens.operators.scope import Scope
from pointlens.plans import engine as facade
from pointlens.plans.engine import Engine
from pointlens.plans.jobs import MISSING, NEEDS_BOTH, NEEDS_STATE, ONLY_SCOPES, RUNNING, Jobs
from pointlens.sources.shared import children, create_once, read_text

STATE = Scope("state", "S")


@pytest.fixture
def points(spark):
    rows = [(f"A-{i}", (i * 37 % 23) / 7, (i * 53 % 29) / 5, "S" if i < 20 else "T", "C", i) for i in range(26)]
    return spark.createDataFrame(rows, "id string, lat double, lng double, state string, county string, row_pos long")


def test_refusals(points, tmp_path):
    jobs = Jobs(Engine(points, str(tmp_path)))
    for asked, why in ((("country",), ONLY_SCOPES), (("elsewhere", "S"), ONLY_SCOPES), (("state", "  "), NEEDS_STATE), (("county", "S", ""), NEEDS_BOTH), ((" COUNTY ", "", "C"), NEEDS_BOTH)):
        assert jobs.generate(*asked) == {"available": False, "generation_supported": False, "message": why}
    assert children(points.sparkSession, f"{tmp_path}/jobs") == []


def test_two_engines_build_once(points, tmp_path, monkeypatch):
    first, second = Jobs(Engine(points, str(tmp_path))), Jobs(Engine(points, str(tmp_path)))
    builds, build = [], Engine.build
    seen = {}

    def watched(engine, scope, most=100):
        builds.append(scope)
        seen.update(second.generate("state", "S"))  # asks while the first one builds
        assert second.missing(STATE)["message"] == RUNNING and second.missing(STATE)["points"] == []
        build(engine, scope, 3)

    assert first.missing(STATE)["message"] == MISSING.format("State") and first.missing(Scope()) is None and first.missing(STATE, "random") is None
    monkeypatch.setattr(Engine, "build", watched)
    done = first.generate("state", "S")
    assert builds == [STATE] and done["generation_status"] == "done" and done["available"] and done["row_count"] == 3
    assert seen["generation_status"] == "running" and seen["job"]["owner"] == first.owner
    assert second.job(STATE).status == "done" and second.missing(STATE) is None


def test_leases_end(points, tmp_path, monkeypatch):
    gone, other = Jobs(Engine(points, str(tmp_path)), lease=0.2), Jobs(Engine(points, str(tmp_path)))
    job, mine = gone.take(STATE)
    assert mine and not other.take(STATE)[1]
    time.sleep(0.3)
    assert other.take(STATE)[1] and other.job(STATE).owner == other.owner and not gone.take(STATE)[1]

    def fails(*_):
        raise ValueError("no disk")

    monkeypatch.setattr(Engine, "build", fails)
    third = Jobs(Engine(points, str(tmp_path)))
    with pytest.raises(ValueError):
        third.generate("county", "S", "C")
    assert third.job(Scope("county", "S", "C")).status == "error" and "no disk" in third.status(Scope("county", "S", "C"))["job"]["message"]
    assert third.take(Scope("county", "S", "C"))[1]  # may be tried again


def test_files_are_created_once(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert create_once(spark, path, "one") and not create_once(spark, path, "two") and read_text(spark, path) == "one" and read_text(spark, f"{tmp_path}/none") is None


def test_a_stopped_build_computes_the_others(points, tmp_path, monkeypatch):
    monkeypatch.setattr(facade, "STAGE", 2)
    engine, asked, computed = Engine(points, str(tmp_path)), [], curves.error_curve

    def stops(*a, **k):
        if len(asked) == 2:
            raise RuntimeError("stopped")
        asked.append(k["percentages"])
        return computed(*a, **k)

    monkeypatch.setattr(facade.curves, "error_curve", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        engine.build(STATE, 6)
    assert asked == [[1, 2], [3, 4]] and not engine.status(STATE).first().available  # readers see no half curve
    assert engine.staged(STATE) == 4 and Jobs(engine).status(STATE)["progress"] == round(100 * 4 / len(configured("state")))
    monkeypatch.setattr(facade.curves, "error_curve", lambda *a, **k: asked.append(k["percentages"]) or computed(*a, **k))
    engine.build(STATE, 6)
    assert asked == [[1, 2], [3, 4], [5, 6]] and engine.status(STATE).first().row_count == 6
    assert children(points.sparkSession, f"{tmp_path}/curves_staging") == [] and engine.staged(STATE) == 0
