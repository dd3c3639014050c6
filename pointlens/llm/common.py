"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.sources.shared import checkpoint, shared_dir

__all__ = ["BROADCAST_ROWS", "checkpoint", "quoted", "shared_dir", "small", "table", "text_slices"]

#: A side of a join is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, df itself otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into row slices of about max_bytes of text (at least one row each).

    Yields the slice and its texts as a LargeBinary array, null as empty.
    """
    if batch.num_rows == 0:
        return
    whole = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)
    part = lambda start, n: (batch.slice(start, n), pc.fill_null(whole.slice(start, n), "").cast(pa.large_string()).cast(pa.large_binary()))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > max_bytes:
            yield part(start, i - start)
            start, held = i, 0
        held += n
    yield part(start, batch.num_rows - start)
