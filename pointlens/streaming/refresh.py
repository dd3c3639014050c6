"""Keep counts and label inputs of scopes up to date from a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointlens.operators.scope import by_zoom


def running_counts(points: DataFrame, time_col: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Points and coordinate sums of every scope; with a time column, in windows that close once the watermark has passed them."""
    there = by_zoom(points).where("lat IS NOT NULL AND lng IS NOT NULL")
    keys = ["zoom", "state", "county"]
    if time_col:
        there = there.withWatermark(time_col, late)
        keys = [F.window(time_col, window), *keys]
    return there.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("lat").alias("sum_lat"), F.sum("lng").alias("sum_lng"))


def refresh(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's counts to a table; readers add them up with current_counts().

    The batch number makes a repeated batch overwrite itself, so that counts stay exact after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(batches: DataFrame) -> DataFrame:
    """zoom, state, county, n and mean coordinates over all batches."""
    sums = batches.groupBy("zoom", "state", "county").agg(F.sum("n").alias("n"), F.sum("sum_lat").alias("lat"), F.sum("sum_lng").alias("lng"))
    return sums.select("zoom", "state", "county", "n", (F.col("lat") / F.col("n")).alias("lat"), (F.col("lng") / F.col("n")).alias("lng"))
