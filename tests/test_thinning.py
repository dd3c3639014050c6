"""Thinning of large scopes: the same points as in one task, in rounds that follow tiles."""

import numpy as np
import pytest

from pointlens.operators import pixels


def thinned(spark, at, distance, **how):
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "row_pos long, px double, py double").repartition(3)
    return sorted(r.row_pos for r in pixels.thin_distributed(points, distance, **how).collect())


@pytest.mark.parametrize("how", [{"tile": 8}, {"tile": 64, "tile_rows": 150}, {"tile": 16, "tile_rows": 1}], ids=["tiles", "small tiles", "cells"])
def test_equal_to_one_task(spark, how):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(0, 60, (400, 2)), rng.normal(30, 1, (200, 2)), np.repeat(rng.uniform(0, 60, (20, 2)), 5, axis=0), np.stack(np.meshgrid(np.arange(8.0), np.arange(8.0)), -1).reshape(-1, 2)])
    for distance in (1.0, 5.0):
        assert thinned(spark, at, distance, **how) == pixels.thin_in_memory(at[:, 0], at[:, 1], distance).tolist()


def test_rounds_follow_tiles(spark):
    """Points in order from west to east: a chain of thousands of points, but of few tiles."""
    rng = np.random.default_rng(1)
    at = rng.uniform(0, (400, 60), (20_000, 2))
    at = at[np.argsort(at[:, 0])]
    rounds = []
    assert thinned(spark, at, 1.0, tile=64, rounds=rounds) == pixels.thin_in_memory(at[:, 0], at[:, 1], 1.0).tolist()
    assert len(rounds) <= 2 * 400 / 64 + 3


def test_a_region_decides_what_it_sees():
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 20, (2000, 2))
    whole = np.zeros(2000, bool)
    whole[pixels.thin_in_memory(at[:, 0], at[:, 1], 1.0)] = True
    mine = np.flatnonzero((at[:, 0] < 12) & (at[:, 1] < 12))
    state = pixels.thin_region(at[mine, 0], at[mine, 1], 1.0, (0.0, 12.0, 0.0, 12.0))
    sure = state >= 0
    assert sure.mean() > 0.5 and (whole[mine][sure] == (state[sure] == 1)).all()


def test_empty_and_no_distance(spark):
    assert thinned(spark, [], 1.0) == [] and thinned(spark, [(0.0, 0.0), (0.0, 0.0)], 0.0) == [0, 1]
