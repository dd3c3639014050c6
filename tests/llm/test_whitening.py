import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlens.llm import whitening
from pointlens.llm.queries import op12_whitening


def exact(rows, scale=64, shift=1_000_000):
    """Integer vectors, n * x - S, and the covariance from exact integers."""
    good = [(i, [math.floor(scale * c) + shift for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], object)
    z = len(x) * x - x.sum(axis=0)
    return [i for i, _ in good], z, (z.T @ z).astype(float) / len(x) ** 3


def check(found, rows, components=32):
    ids, z, v = exact(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k = int((values > 1e-12 * values[0]).sum())
    n = len(ids)
    expected = (z / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k])
    table = {}
    for r in found:
        table.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(found) == n * k
    signs = {}
    for row, i in enumerate(ids):
        mine = table[i]
        assert sorted(mine) == list(range(1, k + 1))
        for c in mine:
            r = mine[c][0]
            assert r.n == n and r.deviation == int((z[row] ** 2).sum()) and 0 <= r.identity_error < 1e-6
            assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-8)
            if abs(expected[row, c - 1]) > 1e-3:
                signs.setdefault(c, np.sign(expected[row, c - 1] * r.whitened))
            assert r.whitened == pytest.approx(signs.get(c, 1) * expected[row, c - 1], abs=1e-6)


def run(spark, rows, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("_x", F.lit(0))
    return whitening.whiten(vectors, **more).collect()


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op12_whitening(spark, sf_dir).collect(), rows)


def test_restarts_and_breakdowns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(300, 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, 12))  # rank 6 of 12, but for rounding down
    rows = [(i, x.tolist()) for i, x in enumerate(mixed)]
    check(run(spark, rows), rows)


def test_operator_with_small_bases():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(120, 120)))
    for values in (np.sort(rng.uniform(0, 10, 120))[::-1], np.r_[[8.0] * 7, [5.0] * 3, np.linspace(4, 0, 110)], np.r_[[3.0, 2.0], np.zeros(118)], np.full(120, 2.0)):
        a = (q * values) @ q.T
        passes = []
        found, vectors = whitening.block_lanczos(lambda b, a=a, p=passes: (p.append(b.shape[1]), a @ b)[1], 120, 6, block=4, most_basis=24)
        assert np.allclose(found, values[:6], atol=1e-9), values[:6]
        assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-10)
        assert np.linalg.norm(a @ vectors - vectors * found) < 1e-9


def test_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (6, []), (7, [0.5, -3.0]), (8, [2.0, 2.5])]
    check(run(spark, rows), rows)
    assert {r.vec_id for r in run(spark, [*rows, (None, [4.0, 4.0])])} == {1, 7, 8, None}
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    found = run(spark, [*rows, (20, [1.0, 2.0, 3.0]), (21, [2.0, 2.0, 2.5])])  # another length is a fit of its own
    assert {r.n for r in found} == {4, 2} and {r.component for r in found if r.n == 2} == {1}
    with pytest.raises(Exception, match="exceed a long"):
        run(spark, [(1, [1e16, 1.0]), (2, [-1e16, 1.0])])
