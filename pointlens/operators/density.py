"""Density grids over a reference's extent and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.sources.points import with_coordinates

BINS = 50


def extent(points: DataFrame) -> DataFrame:
    """One row: lat_min, lat_max, lng_min, lng_max."""
    return with_coordinates(points).agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lng").alias("lng_min"), F.max("lng").alias("lng_max"))


def edges(bounds: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: lat_edges and lng_edges, bins + 1 values each."""
    at = lambda axis: F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col(f"{axis}_min") + (F.col(f"{axis}_max") - F.col(f"{axis}_min")) * i / bins)
    return bounds.select(at("lat").alias("lat_edges"), at("lng").alias("lng_edges"))


def grid(points: DataFrame, bounds: DataFrame, bins: int = BINS) -> DataFrame:
    """lat_bin, lng_bin, mass: the share of points in each cell that has some. The last edge belongs to the last cell; points outside the bounds do not count."""
    placed = with_coordinates(points).join(F.broadcast(bounds))  # one row

    def place(axis: str):
        low, high = F.col(f"{axis}_min"), F.col(f"{axis}_max")
        return F.when(high == low, F.lit(0)).otherwise(F.least(F.floor((F.col(axis) - low) / (high - low) * bins), F.lit(bins - 1))).cast("int")

    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lng").between(F.col("lng_min"), F.col("lng_max"))
    cells = placed.where(inside).groupBy(place("lat").alias("lat_bin"), place("lng").alias("lng_bin")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.join(F.broadcast(total)).select("lat_bin", "lng_bin", (F.col("n") / F.col("total")).alias("mass"))


def difference(reference: DataFrame, reduced: DataFrame, bins: int = BINS) -> DataFrame:
    """lat_bin, lng_bin, original, reduced, difference of all cells in which either has mass, over the reference's extent."""
    bounds = extent(reference)
    a = grid(reference, bounds, bins).withColumnRenamed("mass", "original")
    b = grid(reduced, bounds, bins).withColumnRenamed("mass", "reduced")
    both = a.join(b, ["lat_bin", "lng_bin"], "full_outer").na.fill(0.0, ["original", "reduced"])
    return both.withColumn("difference", F.col("original") - F.col("reduced"))


def metrics(cells: DataFrame) -> DataFrame:
    """One row of figures on a difference: L2 norm, largest change, overlap, gained and lost mass, number of cells with a tenth of the largest change."""
    d = F.col("difference")
    sums = cells.agg(
        F.coalesce(F.sqrt(F.sum(d * d)), F.lit(0.0)).alias("l2_norm"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("linf_distance"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.sum(F.abs(d)), F.lit(0.0)) / 2)).alias("overlap"),
        F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)).alias("positive_mass"),
        F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0.0)).alias("negative_mass"),
    )
    bound = F.greatest(F.col("linf_distance"), F.lit(1e-12)) * 0.1
    high = cells.join(F.broadcast(sums.select("linf_distance"))).agg(F.count_if((F.abs(d) >= bound) & (d != 0)).alias("high_change_cells"))
    return sums.join(F.broadcast(high))


def matrix(cells: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """One row: a column of cells as bins rows of bins values, zero where no cell is. The grid has a fixed size."""
    spark = cells.sparkSession
    empty = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("lat_bin"), (F.col("id") % bins).cast("int").alias("lng_bin"))
    full = empty.join(cells, ["lat_bin", "lng_bin"], "left").select("lat_bin", "lng_bin", F.coalesce(column, F.lit(0.0)).alias("v"))
    rows = full.groupBy("lat_bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("lng_bin", "v"))), lambda x: x.v).alias("row"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("lat_bin", "row"))), lambda x: x.row).alias(column))
