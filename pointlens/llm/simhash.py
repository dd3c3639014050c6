"""SimHash near-dedup with pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles. Fingerprints
link at `distance` or fewer differing bits. Distinct fingerprints are cut into four 16-bit blocks; two that differ in at most
two bits agree in at least two blocks, so each pair of blocks is a join key. Within a key, pairs are verified
by their Hamming distance.

No pair list grows with a group: copies fall together as one fingerprint first, and a key with over `bucket_limit`
fingerprints is not paired up. Its fingerprints go an exact way instead: each one names itself and its 64
one-bit neighbours; two fingerprints name a common word exactly if they differ in two bits or fewer, and all
that name a word link to the least of them.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; rows with a null id take
part but never name a component, unless all rows of it have none; repeated rows appear as often as they occur;
an empty table gives an empty result; other columns are ignored, or returned untouched by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint, quoted, small, text_slices
from pointlens.llm.graph import connected_components

SLICE_BYTES = 1 << 20
SEED = 42
BUCKET_LIMIT = 64
DISTANCE = 2  # the keys below hold for this distance


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    spans = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 15)):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """_id, _hash (of the text), _fp (signed long) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                fps = np.fromiter((fingerprint(t, shingle) for t in texts.to_pylist()), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_hash"), pa.array(fps)], ["_id", "_hash", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(each, f"_id {kind}, _hash long, _fp long")


def _block_keys() -> F.Column:
    """For each two of the four blocks, their bits and which two they are."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = combinations(range(4), 2)
    return F.array(*[F.struct(F.lit(n).alias("n"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("bits")) for n, (i, j) in enumerate(pairs)])


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp), enough of them to hold every group together."""
    keyed = checkpoint(fps.select("fp", F.explode(_block_keys()).alias("key")).select("fp", "key.n", "key.bits"))
    sizes = checkpoint(keyed.groupBy("n", "bits").agg(F.count("*").alias("size")).where("size > 1"))
    held = checkpoint(keyed.join(sizes, ["n", "bits"]))
    few = held.where(F.col("size") <= bucket_limit)
    a, b = few.select("n", "bits", F.col("fp").alias("u")), few.select("n", "bits", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = a.join(b, ["n", "bits"]).where((F.col("u") < F.col("v")) & near).select("u", "v")

    many = held.where(F.col("size") > bucket_limit).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).view(np.int64)))) for i in range(64)]
    named = checkpoint(many.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("word")))
    least = checkpoint(named.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select(F.col("word").alias("w"), "v"))
    stars = named.join(least, F.col("word") == F.col("w")).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _groups(rows: DataFrame) -> DataFrame:
    """fp, component: the group (its least fingerprint) of every fingerprint of rows."""
    fps = rows.select(F.col("_fp").alias("fp")).distinct()
    found = connected_components(links(fps))
    return checkpoint(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    groups = _groups(rows)
    first = rows.groupBy("_fp").agg(F.min("_id").alias("first")).join(groups, F.col("_fp") == F.col("fp"))
    named = first.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = checkpoint(groups.join(named, "component").select("fp", "component_id"))
    return rows.join(by_fp, F.col("_fp") == F.col("fp")).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Of each group the row with the smallest id (nulls last, then by the text's hash), with all its columns."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    return one_of_each(docs, rows, _groups(rows), id_col, text_col)


def one_of_each(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that keep_one() keeps. rows: _id, _hash, _fp of docs; groups: fp, component."""
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    per_fp = rows.groupBy("_fp").agg(F.min(order).alias("best"))  # few rows for a group of copies
    best = per_fp.join(groups, F.col("_fp") == F.col("fp")).groupBy("component").agg(F.min("best").alias("best"))
    by_fp = groups.join(best, "component").select("fp", "best")
    losers = rows.join(by_fp, F.col("_fp") == F.col("fp")).where(order > F.col("best")).select(F.col("_id").alias("_lose_id"), F.col("_hash").alias("_lose_hash")).distinct()
    losers = small(checkpoint(losers))
    text_hash = F.xxhash64(F.coalesce(F.col(f"_doc.{quoted(text_col)}"), F.lit("")))
    whole = docs.select(F.struct("*").alias("_doc")).withColumn("_id", F.col(f"_doc.{quoted(id_col)}")).withColumn("_hash", text_hash)
    kept = whole.join(losers, F.col("_id").eqNullSafe(F.col("_lose_id")) & (F.col("_hash") == F.col("_lose_hash")), "left_anti")
    if not rows.groupBy("_id", "_hash").count().where("count > 1").isEmpty():  # one of rows that share id and text
        kept = kept.dropDuplicates(["_id", "_hash"])
    return kept.select("_doc.*")
