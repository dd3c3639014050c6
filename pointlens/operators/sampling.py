"""Samples at retain percentages: prefixes of the farthest-point order, and seeded random draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlens.functions.columns import n_keep, random_seed
from pointlens.sources.points import with_coordinates
from pointlens.sources.shared import checkpoint, sized

#: Retain percentages that a scope's error curve is built for.
PERCENTAGES = {"country": [*range(1, 51), *range(55, 101, 5)], "state": [*range(1, 31), *range(32, 101, 2)], "county": [*range(1, 101)]}


BIN_ROWS = 50_000  # points of a bin that are ranked together


def configured(zoom: str, most: int = 100) -> list[int]:
    return [p for p in PERCENTAGES[zoom] if p <= most]


def retain_sizes(sizes: DataFrame, percentages: list[int], n_col: str = "n") -> DataFrame:
    """Each row of sizes for each percentage, with n_keep."""
    each = sizes.withColumn("percentage", F.explode(F.array(*[F.lit(p) for p in percentages])))
    return each.withColumn("n_keep", n_keep(n_col, "percentage"))


def fps_prefixes(points: DataFrame, order: DataFrame, percentages: list[int], *by: str) -> DataFrame:
    """The points of each percentage's sample with percentage, n_keep and fps_rank: one order serves all percentages, a smaller sample is part of a larger one."""
    sizes = with_coordinates(points).groupBy(*by).agg(F.count("*").alias("n"))
    kept = retain_sizes(sizes, percentages).drop("n")
    ranked = with_coordinates(points).join(order, [*by, "row_pos"])
    joined = ranked.join(sized(kept), list(by)) if by else ranked.join(F.broadcast(kept))  # one row for each percentage
    return joined.where(F.col("fps_rank") < F.col("n_keep"))


def dense_positions(points: DataFrame, *by: str, order: tuple[str, ...] = ("row_pos",)) -> DataFrame:
    """Adds `place`: 0, 1, ... in the given order inside each scope, without gathering a scope in one task."""
    keys = [*by, *order]
    ranged = checkpoint(points.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *by).count()
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # rows: partitions of a scope
    starts = sizes.select("_part", *by, F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return ranged.withColumn("_inner", inner).join(starts, ["_part", *by]).withColumn("place", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")


def draw(n: int, k: int, seed: int) -> np.ndarray:
    """k different places below n."""
    return np.random.default_rng(seed).choice(n, size=k, replace=False)


def random_sample(points: DataFrame, zoom: str, percentage: int, *by: str) -> DataFrame:
    """A seeded sample of each scope with `draw_rank`, its order. The seed depends on the scope and the percentage alone.

    A task draws the places of a scope (numbers only, 8 bytes for each of its points); points come by a join on their place. A scope that is
    kept whole is in order of its places.
    """
    percentage = max(1, min(100, int(percentage)))
    blank = F.lit("")
    placed = dense_positions(with_coordinates(points), *by)
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    scopes = sizes.withColumn("k", n_keep("n", F.lit(percentage))).withColumn(
        "seed", random_seed(F.lit(zoom), F.col("state") if "state" in by else blank, F.col("county") if "county" in by else blank, F.lit(percentage))
    )
    kinds = "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in by)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                found = draw(row.n, row.k, row.seed)
                for start in range(0, len(found), 1 << 16):
                    part = found[start : start + (1 << 16)]
                    yield pd.DataFrame({**{c: getattr(row, c) for c in by}, "place": part, "draw_rank": np.arange(start, start + len(part))}, columns=[*by, "place", "draw_rank"])

    drawn = scopes.where("k < n").mapInPandas(places, f"{kinds}place long, draw_rank long")
    some = placed.join(drawn, [*by, "place"])
    full = sized(scopes.where("k >= n").select(*by, F.lit(True).alias("_whole")))
    whole = (placed.join(full, list(by)) if by else placed.join(full)).drop("_whole").withColumn("draw_rank", F.col("place"))
    return some.unionByName(whole).drop("place")


def keyed_sample(points: DataFrame, zoom: str, percentage: int, *by: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """A seeded sample of each scope with `draw_rank`: the n_keep points whose MD5 of "seed:row_pos" is smallest, in that order, without a task that draws.

    The first digits of the digests are bins of about bin_rows points. Bins are counted, those beyond the bin that holds the last drawn point are left out
    before anything is shuffled, and ranks inside a bin follow the counts of the bins before it. Seed and size are those of random_sample.
    """
    percentage = max(1, min(100, int(percentage)))
    blank = F.lit("")
    placed = with_coordinates(points)
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_k", n_keep("_n", F.lit(percentage)))
    seed = random_seed(F.lit(zoom), F.col("state") if "state" in by else blank, F.col("county") if "county" in by else blank, F.lit(percentage))
    scopes = sized(sizes.withColumn("_seed", seed))
    most = scopes.agg(F.max("_n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most / bin_rows, 1), 16)))
    known = placed.join(scopes, list(by)) if by else placed.join(F.broadcast(scopes))  # one row
    keyed = known.withColumn("_key", F.md5(F.concat_ws(":", "_seed", "row_pos"))).withColumn("_bin", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*by, "_bin", "_k").count()
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))  # rows: bins of a scope
    used = sized(counts.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before < _k").select(*by, "_bin", "_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_key", "row_pos")) - 1
    drawn = keyed.join(used, [*by, "_bin"]).withColumn("draw_rank", F.col("_before") + rank).where("draw_rank < _k")
    return drawn.select(*points.columns, "draw_rank")
