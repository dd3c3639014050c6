"""Point tables: reading, the display projection, explicit row positions, sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlens.sources.shared import checkpoint

#: Columns of a point file as they are displayed, and their names in this library.
FILE_COLUMNS = {"ID": "id", "Start_Lat": "lat", "Start_Lng": "lng", "State": "state", "County": "county", "City": "city"}
REQUIRED = ("lat", "lng")
FILE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c.startswith("Start") else T.StringType()) for c in FILE_COLUMNS])


def read_points(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Points from CSV (with a header), Parquet, ORC or JSON, under this library's names. The header decides which columns there are."""
    if form == "csv":
        header = spark.read.option("header", True).csv(path).columns  # no inference: one line is read
        schema = T.StructType([FILE_SCHEMA[c] if c in FILE_COLUMNS else T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(schema).option("header", True).csv(path)
    else:
        raw = spark.read.format(form).load(path)
    return trim_sample(raw.withColumnsRenamed(FILE_COLUMNS))


def trim_sample(points: DataFrame) -> DataFrame:
    """The display columns that are there, in their order. Missing coordinates are an error."""
    if missing := [c for c in REQUIRED if c not in points.columns]:
        raise KeyError(f"a point table needs {', '.join(missing)}")
    return points.select(*[c for c in [*FILE_COLUMNS.values(), "row_pos"] if c in points.columns])


def with_row_pos(points: DataFrame, *order: str) -> DataFrame:
    """Adds row_pos: 0, 1, ... in the given order (default: id), without sorting all rows in one task.

    Rows are range-partitioned; a partition's first position is the number of rows before it.
    """
    keys = order or ("id",)
    ranged = points.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = checkpoint(ranged)  # both readings below must see the same partitions
    sizes = ranged.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_part").withColumn("row_pos", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_coordinates(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are there (neither null nor NaN)."""
    return points.na.drop(subset=list(REQUIRED))


def frame_signature(points: DataFrame, *scope: str) -> DataFrame:
    """Rows, first and last id by row_pos, and an order-free content hash, per scope."""
    ident = F.coalesce(F.col("id"), F.lit(""))
    return points.groupBy(*scope).agg(
        F.count("*").alias("n_rows"),
        F.min_by(ident, "row_pos").alias("first_id"),
        F.max_by(ident, "row_pos").alias("last_id"),
        F.sum(F.xxhash64("id", "lat", "lng", "row_pos").cast("decimal(38,0)")).alias("content_hash"),
    )


def file_signature(files: DataFrame) -> DataFrame:
    """Path, bytes and time of change of the files behind a table that was read from files."""
    meta = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return meta.groupBy("file_path").agg(F.max("file_size").alias("size_bytes"), F.max("file_modification_time").alias("modified"))
