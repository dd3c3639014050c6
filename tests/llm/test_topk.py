import math

import numpy as np
from pyspark.sql import functions as F

from pointlens.llm import topk
from pointlens.llm.topk import build_tree, search_tree, top_k


def brute(rows, k, scale=64.0, every=20):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n and len(b) == len(a))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, every=20, kind="float"):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in top_k(vectors, F.col("_id") % every == 0, k).collect())


def test_many_small_trees(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 60)
    monkeypatch.setattr(topk, "PAGE_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) / 8]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(1000, 1150)]  # a third are equal
    assert run(spark, rows) == brute(rows, 20)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -0.25]), (20, [0.5, -0.25]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (40, [1.0, 2.0, 3.0]), (7, [0.0, 0.0, 1.0]), (60, []), (8, [-1e-9, 0.1])]
    assert run(spark, rows, kind="double") == brute(rows, 20)
    assert run(spark, [], kind="double") == []
    assert run(spark, [(1, [1.0])], kind="double") == []


def test_bounds_spare_work():
    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(size=(4000, 2))).astype(np.int64)
    ids, top = np.arange(4000), int((rows**2).sum(axis=1).max())
    queries = np.flatnonzero(ids % 20 == 0)
    scores, found, work = search_tree(build_tree(ids, rows, top), ids[queries], rows[queries], 5, top)
    assert work < 0.3 * len(queries) * 4000
    dots = rows[queries] @ rows.T
    dots[np.arange(len(queries)), queries] = np.iinfo(np.int64).min
    assert (np.sort(dots, axis=1)[:, :-6:-1] == scores).all() and found.shape == scores.shape


def test_query_spares_work_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 250)
    monkeypatch.setattr(topk, "PAGE_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in 2 * centres[i % 20] + rng.normal(size=16) / 40]) for i in range(2000)]
    counter = spark.sparkContext.accumulator(0)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in top_k(vectors, F.col("_id") % 20 == 0, 5, counter=counter).collect())
    assert found == brute(rows, 5)
    assert 0 < counter.value < 0.5 * 100 * 2000  # inner products of brute force


def test_queries_share_visits(monkeypatch):
    """A visit of a page serves all queries whose next page it is, so that visits grow with pages and not with queries."""
    rng = np.random.default_rng(6)
    rows = rng.integers(-40, 40, (4096, 16))
    top, visits, visit = int((rows**2).sum(axis=1).max()), [], topk.Search._visit_page
    tree = topk.build_tree(np.arange(4096), rows, top)
    monkeypatch.setattr(topk.Search, "_visit_page", lambda self, *a: visits.append(1) or visit(self, *a))
    for start in range(0, 1024, topk.BLOCK_QUERIES):
        of = np.arange(start, min(1024, start + topk.BLOCK_QUERIES))
        scores, ids, _ = topk.search_tree(tree, of, rows[of], 5, top)
        dots = rows[of] @ rows.T
        dots[np.arange(len(of)), of] = topk._NONE
        assert [list(zip(s, i)) for s, i in zip(scores[:20].tolist(), ids[:20].tolist())] == [sorted(((int(d), k) for k, d in enumerate(r)), key=lambda x: (-x[0], x[1]))[:5] for r in dots[:20].tolist()]
    assert len(visits) < 1024 * len(tree["centres"]) / 8
