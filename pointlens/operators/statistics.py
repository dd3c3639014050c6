"""Statistical comparison of a reduced point set with its reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.sources.points import with_coordinates

MEASURES = ("mean_lat", "mean_lng", "std_lat", "std_lng", "correlation")


def summary(points: DataFrame, *by: str) -> DataFrame:
    """Mean, population deviation and Pearson correlation of the coordinates; the correlation of fewer than two points is null."""
    return with_coordinates(points).groupBy(*by).agg(
        F.avg("lat").alias("mean_lat"),
        F.avg("lng").alias("mean_lng"),
        F.stddev_pop("lat").alias("std_lat"),
        F.stddev_pop("lng").alias("std_lng"),
        F.when(F.count("*") >= 2, F.corr("lat", "lng")).alias("correlation"),
        F.count("*").alias("n"),
    )


def compare(reference: DataFrame, reduced: DataFrame, *by: str) -> DataFrame:
    """original_, reduced_ and error_ (absolute difference) of each measure, and both counts. A scope without reduced points keeps its row."""
    a = summary(reference, *by).select(*by, *[F.col(m).alias(f"original_{m}") for m in MEASURES], F.col("n").alias("n_exact"))
    b = summary(reduced, *by).select(*by, *[F.col(m).alias(f"reduced_{m}") for m in MEASURES], F.col("n").alias("n_displayed"))
    both = a.join(b, list(by), "left") if by else a.join(F.broadcast(b))  # one row
    errors = {f"error_{m}": F.abs(F.col(f"original_{m}") - F.col(f"reduced_{m}")) for m in MEASURES}
    return both.withColumns(errors).withColumn("n_displayed", F.coalesce("n_displayed", F.lit(0)))


def ranked_errors(compared: DataFrame, *by: str) -> DataFrame:
    """The errors as rows: measure, difference; the largest and the smallest measure of each scope are marked."""
    long = compared.select(*by, *[f"error_{m}" for m in MEASURES]).unpivot(list(by), [f"error_{m}" for m in MEASURES], "measure", "difference")
    long = long.where("difference IS NOT NULL").withColumn("measure", F.replace("measure", F.lit("error_"), F.lit("")))
    key = lambda sign: F.struct((F.col("difference") * sign).alias("d"), F.col("measure"))
    return long.groupBy(*by).agg(
        F.max(key(1)).getField("measure").alias("largest"),
        F.max("difference").alias("largest_difference"),
        F.min(key(1)).getField("measure").alias("smallest"),
        F.min("difference").alias("smallest_difference"),
    )
