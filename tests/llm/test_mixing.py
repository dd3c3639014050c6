from collections import Counter

import pytest

from pointlens.llm.mixing import mix


def test_targets_are_met_and_runs_agree(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id < 5000 THEN 'big' WHEN id < 5900 THEN 'mid' END AS source")
    weights = spark.createDataFrame([("big", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    out = mix(docs, weights).collect()
    n = Counter(r.source for r in out)
    assert set(n) == {"big", None} and abs(n["big"] / n[None] - 1) < 0.15 and abs(len(out) - 6000) < 600
    assert sorted(out) == sorted(mix(docs.repartition(7), weights).collect())
    assert all(r.copy == i for rows in _per_doc(out).values() for i, r in enumerate(sorted(rows, key=lambda r: r.copy), 1))
    assert sorted(mix(docs, weights, seed=1).collect()) != sorted(out)


def _per_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_order_is_a_shuffle(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source")
    ids = [r.doc_id for r in mix(docs).collect()]
    falls = sum(a > b for a, b in zip(ids, ids[1:]))
    assert 0.4 < falls / len(ids) < 0.6


def test_rates_far_above_one_part(spark):
    docs = spark.createDataFrame([(1, "x", "rare")] + [(i, "x", "common") for i in range(2, 1002)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("rare", 1.0), ("common", 1.0)], "source string, weight double")
    n = Counter(r.source for r in mix(docs, weights).collect())
    assert 400 < n["rare"] < 600 and 400 < n["common"] < 600


def test_edges(spark):
    rows = [(None, "a", "s"), (None, "b", "s"), (1, None, None), (2, "", "s"), (2, "", "s"), (3, "x" * 100000, "t")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, copy string, `a.b c` int")
    out = mix(docs)
    assert out.columns == ["doc_id", "text", "source", "a.b c", "copy", "shuffle_key"] and dict(out.dtypes)["copy"] == "int"
    assert sum(r.doc_id == 2 for r in out.collect()) % 2 == 0
    assert mix(docs.limit(0)).collect() == []


def test_odd_weights(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    table = lambda *rows: spark.createDataFrame(list(rows), "source string, weight double")
    for weights in (table(), table(("a", 0.0), ("b", 0.0)), table(("other", 1.0)), table(("a", None))):
        assert mix(docs, weights).collect() == []
    assert {r.source for r in mix(docs, table(("a", 0.0), ("b", 9.0))).collect()} <= {"b"}
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            mix(docs, table(("a", bad)))
