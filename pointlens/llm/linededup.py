"""Line dedup by winnowing over line hashes.

A text is its sequence of \\n-split lines with a word, each one hashed. Around every line, the least stretch of consecutive lines that
reaches `min_words` words is a window, once reaching forward from the line and once backward. Of each window the position of
the (first) minimal hash is selected, once however many windows select it. A run of min_words words that two places share
holds a whole window, so both places select the same position of it: selected positions are guaranteed fingerprints.

Positions are joined on their hash. Every two positions of a hash are matched, and a match is extended left and right over
neighbouring line hashes until they differ. In the later place (by id, then position) the windows inside the extended run
are repeated; their lines, with blank lines inside a window, are deleted.

No pair list grows with a group: a hash that over `paired` positions have selected is not paired up. Its positions meet by
a digest of the whole window that selected them instead, and a window repeats if its first occurrence is another one.

Exactly, either way: a line goes if it lies in a run of lines of at least min_words words that equals a run at an earlier place.

Defined cases: a null text stays null; a text without a word stays as it is; ids order ascending with nulls last,
equal ids by the hash of their texts; rows that share id and text count as one document, so none of them repeats the
other; a text may become empty, its row stays; other columns are returned untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint, quoted, text_slices

SLICE_BYTES = 1 << 20
MIN_WORDS = 50
PAIRED = 8  # positions of a hash that are paired up
_ARRAYS = {"lines": pa.int64(), "places": pa.int32(), "start": pa.int32(), "end": pa.int32(), "pick": pa.int32(), "digest": pa.int64()}


def winnow(text: bytes, min_words: int) -> tuple[np.ndarray, ...] | None:
    """Hash and place (blank lines counted) of each line with a word; first line, last line, selected line and digest of each window.

    None if the text has no window.
    """
    places, hashes, ends = [], [], [0]
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            places.append(i)
            hashes.append(xxhash.xxh64_intdigest(line))
            ends.append(ends[-1] + n)
    if ends[-1] < min_words:
        return None
    ends_at = np.array(ends)
    forward = np.searchsorted(ends_at, ends_at[:-1] + min_words)  # one past the last line
    backward = np.searchsorted(ends_at, ends_at[1:] - min_words, side="right") - 1
    n = len(places)
    spans = {(i, int(e)) for i, e in enumerate(forward) if e <= n} | {(int(s), j + 1) for j, s in enumerate(backward) if s >= 0}
    lines = np.array(hashes, np.uint64).view(np.int64)
    raw = lines.tobytes()
    start, end = np.array(sorted(spans)).T
    pick = [hashes.index(min(hashes[s:e]), s, e) for s, e in zip(start, end)]
    digest = np.array([xxhash.xxh64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(start, end)], np.uint64).view(np.int64)
    return lines, np.array(places), start, end - 1, np.array(pick), digest


def winnowed(keyed: DataFrame, min_words: int) -> DataFrame:
    """_id, _hash and the arrays of winnow() for each document that has a window. keyed: _id, _hash, _text."""
    kind = keyed.schema["_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                found = [(i, w) for i, t in enumerate(texts.to_pylist()) if (w := winnow(t, min_words))]
                own = pa.array([i for i, _ in found], pa.int64())
                arrays = [pa.array([w[k] for _, w in found], pa.list_(kind)) for k, kind in enumerate(_ARRAYS.values())]
                yield pa.RecordBatch.from_arrays([part.column("_id").take(own), part.column("_hash").take(own), *arrays], ["_id", "_hash", *_ARRAYS])

    arrays = ", ".join(f"{name} array<{'long' if kind == pa.int64() else 'int'}>" for name, kind in _ARRAYS.items())
    return keyed.select("_id", "_hash", "_text").mapInArrow(each, f"_id {kind}, _hash long, {arrays}")


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items of a and b are equal."""
    at, step, most = 0, 8, min(len(a), len(b))
    while at < most:
        differ = np.flatnonzero(a[at : min(at + step, most)] != b[at : min(at + step, most)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return most


def extend(later: np.ndarray, earlier: np.ndarray, matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first and last line of `later`) that matched positions of the two line sequences grow to. A run is found once, however many of its positions match."""
    runs, reached = [], {}
    for i, j in sorted(matches):
        if i <= reached.get(i - j, -1):
            continue
        left = _agreeing(later[:i][::-1], earlier[:j][::-1])
        right = _agreeing(later[i:], earlier[j:])
        runs.append((i - left, i + right - 1))
        reached[i - j] = i + right - 1
    return runs


def _place(at: str) -> F.Column:
    return F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_hash").alias("hash"), F.col(at).alias("at"))


def _by_extension(documents: DataFrame, positions: DataFrame) -> DataFrame:
    """_id, _hash, low, high: windows (places of their first and last line) inside runs that extended matches repeat."""
    kind = documents.schema["_id"].dataType.simpleString()
    grouped = positions.groupBy("fingerprint").agg(F.array_sort(F.collect_list(_place("at"))).alias("all"))  # `paired` positions at most
    pairs = grouped.select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(slice(all, 1, i), y -> struct(x, y))))")).alias("p")).where("p.x > p.y")
    pairs = pairs.groupBy(F.col("p.x.id").alias("_id"), F.col("p.x.hash").alias("_hash"), F.col("p.y.id").alias("_e_id"), F.col("p.y.hash").alias("_e_hash")).agg(
        F.collect_set(F.struct(F.col("p.x.at").alias("i"), F.col("p.y.at").alias("j"))).alias("matches")
    )
    pairs = checkpoint(pairs)
    sides = [documents.select(F.col("_id").alias(f"{s}id"), F.col("_hash").alias(f"{s}hash"), *[F.col(c).alias(f"{s}{c}") for c in columns]) for s, columns in (("l", ("lines", "places", "start", "end")), ("e", ("lines",)))]
    of_later = F.col("_id").eqNullSafe(F.col("lid")) & (F.col("_hash") == F.col("lhash"))
    of_earlier = F.col("_e_id").eqNullSafe(F.col("eid")) & (F.col("_e_hash") == F.col("ehash"))
    both = pairs.join(sides[0], of_later).join(sides[1], of_earlier).select("_id", "_hash", "matches", "llines", "lplaces", "lstart", "lend", "elines")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, low, high = [], [], []
            for row in range(batch.num_rows):
                lines, places, start, end, other = (batch.column(c)[row].values.to_numpy() for c in ("llines", "lplaces", "lstart", "lend", "elines"))
                matches = batch.column("matches")[row].values
                inside = np.zeros(len(start), bool)
                for a, b in extend(lines, other, list(zip(matches.field("i").to_pylist(), matches.field("j").to_pylist()))):
                    inside |= (start >= a) & (end <= b)
                owner += [row] * int(inside.sum())
                low.append(places[start[inside]])
                high.append(places[end[inside]])
            if owner:
                own = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(own), batch.column("_hash").take(own), pa.array(np.concatenate(low), pa.int32()), pa.array(np.concatenate(high), pa.int32())], ["_id", "_hash", "low", "high"])

    return both.mapInArrow(mark, f"_id {kind}, _hash long, low int, high int")


def _by_window(documents: DataFrame, crowded: DataFrame) -> DataFrame:
    """_id, _hash, low, high: windows selected at a crowded hash that stood earlier."""
    window = "transform(start, (s, k) -> struct(lines[pick[k]] AS fingerprint, digest[k] AS digest, s AS at, places[s] AS low, places[end[k]] AS high))"
    windows = documents.select("_id", "_hash", F.explode(F.expr(window)).alias("w")).select("_id", "_hash", "w.*")
    windows = checkpoint(windows.join(crowded, "fingerprint"))
    firsts = windows.groupBy("fingerprint", "digest").agg(F.min(_place("at")).alias("first"), F.max(_place("at")).alias("last")).where("first < last")
    firsts = checkpoint(firsts.select("fingerprint", "digest", "first"))  # a table of its own, so that Spark can split a passage that many documents share
    return windows.join(firsts, ["fingerprint", "digest"]).where(_place("at") > F.col("first")).select("_id", "_hash", "low", "high")


def fingerprints(documents: DataFrame) -> DataFrame:
    """_id, _hash, at (line), fingerprint: the selected positions of winnowed()."""
    picked = F.explode(F.transform(F.array_distinct("pick"), lambda p: F.struct(p.alias("at"), F.get("lines", p).alias("fingerprint")))).alias("p")
    return documents.select("_id", "_hash", picked).select("_id", "_hash", "p.at", "p.fingerprint")


def repeated_spans(keyed: DataFrame, min_words: int = MIN_WORDS, paired: int = PAIRED) -> DataFrame:
    """_r_id, _r_hash, _spans: the windows of each document that stood earlier. keyed: _id, _hash, _text."""
    documents = checkpoint(winnowed(keyed, min_words))
    positions = fingerprints(documents)
    sizes = checkpoint(positions.groupBy("fingerprint").agg(F.count("*").alias("size")).where("size > 1"))
    few = positions.join(sizes.where(F.col("size") <= paired), "fingerprint").drop("size")
    crowded = sizes.where(F.col("size") > paired).select("fingerprint")
    later = _by_extension(documents, few)
    if not crowded.isEmpty():
        later = later.unionByName(_by_window(documents, crowded))
    per_doc = later.groupBy("_id", "_hash").agg(F.collect_set(F.struct(F.col("low").alias("start"), F.col("high").alias("end"))).alias("_spans"))  # a document's own windows
    return per_doc.select(F.col("_id").alias("_r_id"), F.col("_hash").alias("_r_hash"), "_spans")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """docs with repeated runs deleted from their texts, and n_removed (int), the number of deleted lines."""
    names = [c for c in docs.columns if c != "n_removed"]
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("_text"), F.struct(*map(quoted, names)).alias("_doc")
    )
    spans = checkpoint(repeated_spans(keyed, min_words, paired))
    found = keyed.drop("_text").join(spans, F.col("_id").eqNullSafe(F.col("_r_id")) & (F.col("_hash") == F.col("_r_hash")), "left")
    lines = F.split(F.col(f"_doc.{text_col}"), "\n", -1)
    marked = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s.start, s.end))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked)
    text = F.when(F.col("_spans").isNull(), F.col(f"_doc.{text_col}")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return found.select(
        *[(text if c == text_col else F.col(f"_doc.{quoted(c)}")).alias(c) for c in names],
        F.when(F.col("_spans").isNull(), F.lit(0)).otherwise(F.size(marked)).alias("n_removed"),
    )


#: DuckDB: doc_id, text, n_removed of dedup_lines(documents) for distinct ids that are not null.
ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM split),
worded AS (SELECT *, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n FROM lines),
placed AS (
  SELECT *, row_number() OVER d AS i, sum(n) OVER d - n AS s, sum(n) OVER d AS e, sum(n) OVER d - n + 50 AS reach, sum(n) OVER d - 50 AS back
  FROM worded WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
texts AS (SELECT doc_id, list(line ORDER BY i) AS ls, list(pos ORDER BY i) AS ps FROM placed GROUP BY doc_id),
spans AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM placed a ASOF JOIN placed b ON a.doc_id = b.doc_id AND a.reach <= b.e
  UNION
  SELECT b.doc_id, a.i, b.i FROM placed b ASOF JOIN placed a ON a.doc_id = b.doc_id AND b.back >= a.s),
runs AS (SELECT doc_id, a, ls[a:b] AS run, ps[a] AS low, ps[b] AS high FROM spans JOIN texts USING (doc_id)),
firsts AS (SELECT run, min({'d': doc_id, 'a': a}) AS first FROM runs GROUP BY run HAVING count(*) > 1),
later AS (SELECT DISTINCT doc_id, low, high FROM runs JOIN firsts USING (run) WHERE {'d': doc_id, 'a': a} > first),
gone AS (SELECT doc_id, list(DISTINCT pos) AS p FROM (SELECT doc_id, unnest(range(low, high + 1)) AS pos FROM later) GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN p IS NULL THEN d.text
            ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(p, i)), lambda i: l[i + 1]), chr(10)) END AS text,
       CAST(coalesce(len(p), 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN split USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
