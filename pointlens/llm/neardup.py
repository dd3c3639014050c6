"""Near-duplicates by exact Jaccard similarity of word shingles.

Two texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are the connected
components of that. Candidates come from SimHash first (fingerprints of the sets, linked as in simhash.links) and are verified; no distance of
fingerprints covers a similarity for certain, so the rest come from prefixes: sets
of n shingles are put into one order, and two similar ones must share one of their first n - ceil(0.8 n) + 1. The order
(any one is exact) has shingles that many texts of a sample hold last, so that a passage in many texts is rarely a key.

Every set has a sketch of parity bits, as many as shingles. Each shingle that only one of two sets has flips one bit, so the sketches differ
by at most as many bits as the sets by shingles, and a pair whose sketches differ by more than 0.8 allows is dropped for certain.
What is left is verified by the sets themselves.

Texts of equal sets fall together first. The hub of a key is the least of the sets that have it; every set is compared with one of its keys'
hubs, and only sets of a key that are in different groups after that, and whose sizes and places of the key leave room for the similarity, are compared
with each other. So a group of copies or near copies costs a pair for each of its members, not for each two of them, and a frame that many
texts share costs none.

Defined cases: words are cut and lower-cased as in simhash; a text of one to four words is one shingle; null and wordless texts are
equal; shingles are compared by their XXH64 hashes; ids, repeated rows and other columns as in simhash.keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlens.llm import simhash
from pointlens.llm.common import checkpoint, small, text_slices
from pointlens.llm.graph import connected_components
from pointlens.llm.simhash import SEED, SLICE_BYTES, one_of_each

SHINGLE = 5
#: Similarity as a fraction, so that 0.8 is exact.
OVER, UNDER = 4, 5
LEAST_BITS = 256
SAMPLE = 50  # of so many texts one says which shingles are common
COMMON = 3  # texts of the sample
MOST_COMMON = 1_000_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    spans = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in spans), np.uint64))


def prefix(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set must share one. common: sorted hashes that come last."""
    n = len(tokens)
    if not n:
        return tokens
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        hot = common[at] == tokens
        tokens = np.concatenate([tokens[~hot], tokens[hot]])
    return tokens[: n - -(-OVER * n // UNDER) + 1]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens by remainder: as many bits as tokens, up to the next power of two."""
    bits = max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def simhash_of(tokens: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles: bits that are set in over half of them."""
    ones = np.unpackbits(tokens.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(tokens)).view(">i8")[0])


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("_text"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *[a.view(np.int64) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _sets(rows: DataFrame, *keep: str) -> DataFrame:
    """keep... and `tokens`, the shingles of _text."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                found = [shingles(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], _lists(found)], [*keep, "tokens"])

    return rows.select(*keep, "_text").mapInArrow(each, f"{kinds}, tokens array<long>")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that several different texts of a sample hold, the most frequent ones if they are many."""
    some = rows.where(F.pmod("_hash", F.lit(SAMPLE)) == 0)
    held = _sets(some, "_hash").select("_hash", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = held.where(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "token").limit(MOST_COMMON).toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def keyed_rows(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """_id, _hash, _fp (names the set), n, sim (its SimHash fingerprint), bits, keys for each row."""
    kind = rows.schema["_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                found = [shingles(t) for t in texts.to_pylist()]
                names = np.fromiter((xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found), np.uint64, len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_hash"), pa.array(names), pa.array([len(f) for f in found], pa.int32()), pa.array([simhash_of(f) for f in found], pa.int64()), _lists([sketch(f) for f in found]), _lists([prefix(f, last) for f in found])],
                    ["_id", "_hash", "_fp", "n", "sim", "bits", "keys"],
                )

    return rows.mapInArrow(each, f"_id {kind}, _hash long, _fp long, n int, sim long, bits array<long>, keys array<long>")


def _sizes_match() -> Column:
    return (F.col("nu") * UNDER >= F.col("nv") * OVER) & (F.col("nv") * UNDER >= F.col("nu") * OVER)


def _may_match() -> Column:
    """Sizes and sketches of u and v leave room for the similarity."""
    size = F.least(F.size("bu"), F.size("bv"))

    def folded(b: str) -> Column:  # a sketch of twice the bits has those of half of them
        halves = F.zip_with(F.slice(b, F.lit(1), size), F.slice(b, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(b) > size, halves).otherwise(F.col(b))

    apart = F.aggregate(F.zip_with(folded("bu"), folded("bv"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _sizes_match() & (apart * (UNDER + OVER) <= (F.col("nu") + F.col("nv")) * (UNDER - OVER))


def _same_row(i: str, h: str) -> Column:
    return F.col("_id").eqNullSafe(F.col(i)) & (F.col("_hash") == F.col(h))


def _verified(pairs: DataFrame, one: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar. one: fp, n, bits, doc; docs: _id, _hash, _text.

    A text is fetched where it lies and sent once for each of its pairs to the other text.
    """
    side = lambda x: one.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"), F.col("doc.id").alias(f"i{x}"), F.col("doc.hash").alias(f"h{x}"))
    near = checkpoint(pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(_may_match()).select("u", "v", "iu", "hu", "iv", "hv"))
    left = docs.join(small(near.select("u", "v", "iu", "hu")), _same_row("iu", "hu")).select("u", "v", F.col("_text").alias("tu"))
    right = docs.join(small(near.select("v", "iv", "hv").distinct()), _same_row("iv", "hv")).select(F.col("v").alias("w"), F.col("_text").alias("tv"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            for i in range(batch.num_rows):
                if v[i] != name:
                    name, hub = v[i], shingles((batch.column("tv")[i].as_py() or "").encode())
                own = shingles((batch.column("tu")[i].as_py() or "").encode())
                both = len(np.intersect1d(own, hub, assume_unique=True))
                good.append(both * UNDER >= (len(own) + len(hub) - both) * OVER)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()).filter(pa.array(good, pa.bool_())), pa.array(v, pa.int64()).filter(pa.array(good, pa.bool_()))], ["u", "v"])

    met = left.join(right, F.col("v") == F.col("w")).select("u", "v", "tu", "tv")
    return checkpoint(met.mapInArrow(compare, "u long, v long"))


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: pairs of similar sets, enough of them to hold every group together. rows: of keyed_rows; docs: _id, _hash, _text."""
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    one = checkpoint(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("doc"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bits").alias("bits"), F.count("*").alias("copies")))
    copies = rows.select("_id", "_hash", "_fp").join(one.where("copies > 1").select("fp", "doc"), F.col("_fp") == F.col("fp")).where(order > F.col("doc"))
    copies = checkpoint(copies.select(F.col("_id").alias("i"), F.col("_hash").alias("h")).distinct())
    keyed = rows.join(small(copies), _same_row("i", "h"), "left_anti").select(F.col("_fp").alias("fp"), "n", F.posexplode("keys").alias("pos", "key"))
    # hubs and mixed keys are tables of their own, so that both sides of their joins are exchanged and Spark can split a key in many texts
    shared = checkpoint(keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub < other").select(F.col("key").alias("k"), "hub"))
    held = checkpoint(keyed.join(shared, F.col("key") == F.col("k")).select("key", "fp", "hub", "n", "pos"))

    # SimHash: sets of equal fingerprints with the least of them, and those least ones of linked fingerprints with each other
    named = checkpoint(one.groupBy("sim").agg(F.min("fp").alias("least")))
    same = one.join(named.withColumnRenamed("sim", "s"), F.col("sim") == F.col("s")).where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    end = lambda x: named.select(F.col("sim").alias(f"s{x}"), F.col("least").alias(f"l{x}"))
    linked = simhash.links(named.select(F.col("sim").alias("fp"))).join(end("u"), F.col("u") == F.col("su")).join(end("v"), F.col("v") == F.col("sv"))
    by_simhash = same.unionByName(linked.select(F.col("lu").alias("u"), F.col("lv").alias("v")))

    # every set with one hub of those it shares a key with, then those of a key that are in different groups yet
    hubs = held.groupBy(F.col("fp").alias("u")).agg(F.min("hub").alias("v")).where("u <> v")
    edges = _verified(by_simhash.unionByName(hubs), one, docs)
    found = connected_components(edges)
    now = held.join(found, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "pos", F.coalesce("component", "fp").alias("group"))
    mixed = checkpoint(now.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select(F.col("key").alias("k")))
    left = checkpoint(now.join(mixed, F.col("key") == F.col("k")).select("key", "fp", "n", "pos", "group"))
    return edges.unionByName(_verified(candidate_pairs(left), one, docs))


def candidate_pairs(left: DataFrame) -> DataFrame:
    """u, v: sets of different groups that can be similar and share a key. left: key, fp, n, pos (place of the key in the set's order), group.

    The first key that two sets share has none of what they share before it, so they share at most one and what follows it in the shorter rest. Sets of equal size and
    place are a class, and only classes that leave room for the similarity are brought together: texts that share a frame and no more do not meet, however many they are.
    """
    classes = left.groupBy("key", "n", "pos").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    a, b = (classes.select("key", F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}")) for x in "uv")
    most = F.lit(1) + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) - 1
    room = most * (UNDER + OVER) >= (F.col("nu") + F.col("nv")) * OVER
    fit = checkpoint(a.join(b, "key").where(_sizes_match() & room & (F.col("lu") < F.col("hv"))).select("key", "nu", "pu", "nv", "pv"))
    u, v = (left.select("key", F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("fp").alias(x), F.col("group").alias(f"g{x}")) for x in "uv")
    return fit.join(u, ["key", "nu", "pu"]).join(v, ["key", "nv", "pv"]).where("gu < gv").select("u", "v")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id (nulls last, then by the text's hash), with all its columns."""
    texts = _hashed(docs, id_col, text_col)
    rows = checkpoint(keyed_rows(texts, common_shingles(texts)))
    found = connected_components(links(rows, texts))
    slim = rows.select("_id", "_hash", "_fp")
    groups = slim.select(F.col("_fp").alias("fp")).distinct().join(found, F.col("fp") == F.col("node"), "left")
    return one_of_each(docs, slim, checkpoint(groups.select("fp", F.coalesce("component", "fp").alias("component"))), id_col, text_col)
