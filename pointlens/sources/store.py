"""Results kept as tables: manifests, curves, tolerant reading, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlens.functions.columns import route_digest

SCOPE = ("zoom", "state", "county")
#: Fields that name places on the machine that wrote a payload.
LOCAL_FIELDS = ("cache_path", "sample_abs_path")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_json_or_default(spark: SparkSession, path: str, schema: str, default: dict) -> DataFrame:
    """A JSON document with a declared schema; one that is missing or corrupt is the default row."""
    fallback = spark.createDataFrame([default], schema)
    try:
        read = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
        good = read.where("_corrupt IS NULL").drop("_corrupt")
        return fallback if good.first() is None else good
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return fallback


def append(rows: DataFrame, path: str) -> None:
    """Add manifest rows; readers take the latest ones, so that writers never read and rewrite what others wrote."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest(manifest: DataFrame, *keys: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("written_at").desc()))
    return manifest.withColumn("_newest", newest).where("_newest = 1").drop("_newest")


def valid(manifest: DataFrame, signatures: DataFrame, *keys: str) -> DataFrame:
    """Manifest rows whose signature is that of the present data."""
    return manifest.join(signatures, [*keys, "n_rows", "first_id", "last_id", "content_hash"], "left_semi")


def of_scope(rows: DataFrame, zoom: str, state: str, county: str) -> DataFrame:
    """Rows of one scope from a table by scope; only its folder is read. Blank names are null in folder names."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.where((F.col("zoom") == zoom) & (blank("state") == state) & (blank("county") == county))


def write_curve(curve: DataFrame, path: str) -> None:
    """Curves by scope, in one atomic write each; other scopes' folders stay."""
    curve.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples by scope, one folder for each, so that a reader of a scope opens no other."""
    write_curve(samples, path)


def read_samples(spark: SparkSession, path: str, zoom: str, state: str = "", county: str = "", percentage: int | None = None) -> DataFrame:
    found = of_scope(spark.read.parquet(path), zoom, state, county)
    return found if percentage is None else found.where(F.col("percentage") == percentage)


def sanitized(payload: DataFrame, local_prefix: str) -> DataFrame:
    """A payload table without local fields; the local prefix in its text columns is replaced."""
    kept = payload.drop(*LOCAL_FIELDS)
    text = [f.name for f in kept.schema.fields if f.dataType.simpleString() == "string"]
    return kept.withColumns({c: F.replace(c, F.lit(local_prefix), F.lit("<data>")) for c in text}) if local_prefix and text else kept


def snapshots(payloads: DataFrame, key: Column | str, payload: Column | str) -> DataFrame:
    """name, route, payload (JSON) of each distinct route."""
    rows = payloads.select(F.col(key).alias("route") if isinstance(key, str) else key.alias("route"), F.to_json(payload).alias("payload"))
    return rows.withColumn("name", route_digest("route")).select("name", "route", "payload")


def export_snapshots(rows: DataFrame, path: str) -> None:
    """One folder with a JSON file for each snapshot, and a manifest of routes. An existing folder is not touched: it is an error."""
    rows.select("name", "payload").write.mode("error").partitionBy("name").text(f"{path}/api")
    rows.select("route", "name").write.mode("error").json(f"{path}/manifest")
