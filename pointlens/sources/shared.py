"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset in local mode, as in tests, a new local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place, system = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    place, system = _place(spark, path)
    system.delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that is not there yet; False if it is. Of several writers one succeeds."""
    place, system = _place(spark, path)
    system.mkdirs(place.getParent())
    try:
        out = system.create(place, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def overwrite(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file."""
    place, system = _place(spark, path)
    out = system.create(place, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a new shared folder and read again, with the sizes that Spark then knows, and the folder, which the caller removes."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Rows of a key together, keys over all shuffle partitions. rows: as many partitions, if that is more, up to 8 times the shuffle partitions, for large rows.

    For groups that take long for their bytes: Spark would put small partitions together by size and run their groups one after the other.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, min(rows, 8 * parts)), *keys)


def sized(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a row for each scope or so, computed once: with a broadcast hint if it has at most `limit` rows.

    Its other side then keeps its place, however many of its rows one scope has.
    """
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= limit else kept
