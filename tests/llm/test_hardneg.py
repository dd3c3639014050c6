import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlens.llm import hardneg
from pointlens.llm.queries import op11_hard_negatives


def brute(rows, anchor_every=100, positives=5, negatives=5, low=80, high=100, scale=256):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * x) for x in v]))
    out = []
    for m, (a, label, v) in enumerate(good):
        if a % anchor_every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for n, (i, other, w) in enumerate(good) if n != m and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            window = sorted(x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def run(spark, rows, every=100, kind="double", **more):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("rank", F.lit("clash")).withColumn("_row", F.lit(0))
    label = F.when(F.col("_id") % 7 == 0, (F.col("_label") + 1) % 10).otherwise(F.col("_label"))
    return sorted(tuple(r) for r in hardneg.mine(vectors, F.col("_id") % every == 0, label, **more).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("ANCHOR_ROWS", 3), ("BLOCK_ROWS", 20), ("CHUNK_DIMS", 2), ("MOST_CHUNKS", 3)):
        monkeypatch.setattr(hardneg, name, n)


def test_equal_to_brute_force_over_many_tiles(spark, small_blocks):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=9) / 4 + 0.2).tolist(), int(rng.integers(4))) for i in range(200)]
    rows += [(i, rows[10][1], 3) for i in range(1000, 1100)]  # a third are equal: ties go to the smaller id
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, rows, 10, positives=2, negatives=1, low=50, high=90) == brute(rows, 10, 2, 1, 50, 90)


def test_edges(spark, small_blocks):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 2),
            (None, [1.0, 1.0], 2), (5, [1.0, 1.9], 2), (6, [1.0, 1.8], None), (8, [1.0, 1.8], 2), (200, [1.0, 2.0, 3.0], 1), (9, [1.0, 2.0, 2.5], 1), (10, [1.0, 2.0, 2.4], 0),
            (300, [], 1), (400, [-1.0, -2.0], 5), (11, [1.0, 0.5], 5), (12, [0.0, 0.0], 1), (500, [0.0, 0.0], 3), (13, [0.0, 0.1], 3)]
    assert run(spark, rows) == brute(rows)
    assert brute(rows)
    assert run(spark, []) == []
    with pytest.raises(OverflowError):
        run(spark, [(0, [1e30], 1), (1, [1e30], 2)])


def test_bounds_keep_what_a_window_can_hold():
    rng = np.random.default_rng(0)
    scores = rng.integers(-50, 100, (6, 300))
    numbers = np.arange(300)
    rows = {"ids": numbers, "labels": rng.integers(3, size=300), "numbers": numbers}
    anchors = {"labels": rng.integers(3, size=6), "numbers": np.arange(6)}
    best, rest = hardneg.reduce_tile(scores, anchors, rows, 5, 80)
    for a in range(6):
        least = scores[a, best[a][-1]]
        left = set(numbers[rows["labels"] != anchors["labels"][a]]) - set(rest[a])
        assert len(best[a]) == 5 and all(100 * scores[a, x] < 80 * least for x in left)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, sf_dir).collect()) == brute(rows)
