"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Every text is seen as a multinomial over hashed byte trigrams (A-Z lower-cased, trigrams do not cross
documents). Two models are counted over whole tables: `raw` over all documents, `target` over the documents
that trusted labels call good. The score of a document is the mean over its trigrams of
log p_target - log p_raw, so it does not depend on the length; a document is kept if it passes the base rules
and its score reaches `threshold`.

The log ratios are rounded to fixed-point integers, so sums are exact and the verdict of a document does not depend on
batching, partitioning or the order of rows.

Defined cases: a null text counts as empty; a text without a trigram scores 0; an empty corpus yields an empty
result; without any trusted document all ratios are 0 and only the base rules decide. Repeated rows are judged
one by one and count as often as they occur. A document whose id is null is never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import BROADCAST_ROWS, checkpoint, text_slices

SLICE_BYTES = 1 << 20
SCALE = 1 << 20  # fixed point of a log ratio
ID_BITS = 1 << 26

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    buckets: a power of two, size of the hashed n-gram space and of the model that goes to the tasks.
    smoothing: added to every bucket of either model.
    threshold: least mean log ratio (nats per trigram) of a kept document.
    """

    buckets: int = 1 << 16
    smoothing: float = 1.0
    threshold: float = -0.5
    min_words: int = 10
    max_repeat_percent: int = 20


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts of a slice, and where each begins and ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    return raw, at[:-1], at[1:]


def _buckets_of(raw: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the trigram that begins at each byte (two fewer than bytes)."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    b = _LOWER[raw]
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    mixed = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))
    return mixed.astype(np.int64)


def _grams_per_text(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.maximum(end - start - 2, 0)


def _inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n trigram positions lie in one text."""
    inside = np.ones(n, bool)
    for back in (2, 1):
        cut = end - back
        cut = cut[(cut >= 0) & (cut < n)]
        inside[cut] = False
    return inside


def _id_bits(trusted: DataFrame) -> np.ndarray:
    """Which of ID_BITS hash values the ids (`_good`) of trusted have. Its size is fixed, so it can be sent to all tasks at any number of ids."""
    places = trusted.select(F.pmod(F.xxhash64("_good"), F.lit(ID_BITS)).cast("int").alias("place"))
    words = places.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    out = np.zeros(ID_BITS // 64, np.int64)
    found = words.toArrow()  # ID_BITS / 64 rows at most
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _count_flagged(flagged: DataFrame, size: int) -> DataFrame:
    """bucket, raw, target from _text and _trusted in one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_n, target_n = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                raw, start, end = _layout(texts)
                grams = _buckets_of(raw, size)
                inside = _inside(len(grams), start, end)
                raw_n += np.bincount(grams[inside], minlength=size)
                trust = part.column("_trusted").to_numpy(zero_copy_only=False).astype(bool)
                target_n += np.bincount(grams[inside & np.repeat(trust, end - start)[: len(grams)]], minlength=size)
        used = np.flatnonzero(raw_n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw_n[used]), pa.array(target_n[used])], ["bucket", "raw", "target"])

    return flagged.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _count(rows: DataFrame, size: int) -> DataFrame:
    """bucket, n: trigrams of the texts (`_text`) of rows, counted by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, "_text", SLICE_BYTES):
                raw, start, end = _layout(texts)
                grams = _buckets_of(raw, size)
                n += np.bincount(grams[_inside(len(grams), start, end)], minlength=size)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["bucket", "n"])

    return rows.select("_text").mapInArrow(count, "bucket int, n long")


def count_ngrams(docs: DataFrame, trusted: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text", most_sent: int = BROADCAST_ROWS) -> DataFrame:
    """bucket, raw, target: trigram counts over all documents and over those whose id is in `trusted` (one column, id_col).

    Trusted ids of a counted size are sent to the documents. More of them meet only documents whose id has a bit of a trusted one, so no
    other text is shuffled.
    """
    good = checkpoint(trusted.select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("_good")).where("_good IS NOT NULL").distinct())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if good.limit(most_sent + 1).count() <= most_sent:
        flagged = rows.join(F.broadcast(good), F.col("_id") == F.col("_good"), "left").select("_text", F.col("_good").isNotNull().alias("_trusted"))
        return _count_flagged(flagged, rules.buckets)
    bits = docs.sparkSession.sparkContext.broadcast(_id_bits(good))
    raw = _count(rows, rules.buckets).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target"))

    def may_be_trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("_place").to_numpy()
            yield batch.filter(pa.array((bits.value[place >> 6] >> (place & 63)) & 1 == 1))

    kind = docs.schema[id_col].dataType.simpleString()
    placed = rows.where("_id IS NOT NULL").select("_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(ID_BITS)).alias("_place"))
    some = placed.mapInArrow(may_be_trusted, f"_id {kind}, _text string, _place long")
    target = _count(some.join(good, F.col("_id") == F.col("_good"), "left_semi"), rules.buckets).select("bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target"))
    return raw.unionByName(target).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, trusted: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Fixed-point log ratio of every bucket; at most `rules.buckets` rows come to the driver."""
    raw, target = np.zeros(rules.buckets), np.zeros(rules.buckets)
    for row in count_ngrams(docs, trusted, rules, id_col, text_col).toLocalIterator():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.any():
        return np.zeros(rules.buckets, np.int64)
    a = rules.smoothing
    ratio = np.log((target + a) / (target.sum() + a * rules.buckets)) - np.log((raw + a) / (raw.sum() + a * rules.buckets))
    return np.round(ratio * SCALE).astype(np.int64)


def _repeated(words: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a window of five words found twice or more in that text."""
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for text in words for w in text), np.int64)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), counts)
    if len(flat) < 5:
        return np.zeros(len(words), np.int64)
    v = len(ids)
    two, _ = pd.factorize(flat[:-1] * v + flat[1:])
    four, _ = pd.factorize(two[:-2] * (int(two.max()) + 1) + two[2:])
    five, _ = pd.factorize(four[:-1] * v + flat[4:])
    whole = np.flatnonzero(doc[:-4] == doc[4:])  # windows inside one text
    keys, _ = pd.factorize(five[whole] * len(words) + doc[whole])
    twice = whole[np.bincount(keys, minlength=1)[keys] >= 2] if len(whole) else whole
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + 5, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words))


def _duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def _judge(texts: pa.Array, model: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    raw, start, end = _layout(texts)
    space = _SPACE[raw]
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([start, end])], axis=0)[0]
    lines = texts.to_pylist()
    words = [t.split() for t in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    n_repeat = _repeated(words)
    grams = _buckets_of(raw, rules.buckets)
    value = np.where(_inside(len(grams), start, end), model[grams], 0)
    sums = np.concatenate([[0], np.cumsum(value), np.zeros(2, np.int64)])
    sums[len(value) + 1 :] = sums[len(value)]
    n_grams = _grams_per_text(start, end)
    score = np.where(n_grams > 0, (sums[end] - sums[start]) / np.maximum(n_grams, 1) / SCALE, 0.0)
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": total(~space & ((raw & 0xC0) != 0x80)).astype(np.int64),
        "n_symbols": total(_SYMBOL[raw]).astype(np.int64),
        "n_dup_lines": np.fromiter(map(_duplicate_lines, lines), np.int64, len(lines)),
        "n_repeat_words": n_repeat.astype(np.int64),
        "base_failed": failed,
        "kept": ~failed & (score >= rules.threshold),
        "score": score,
    }


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score_documents(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the base figures, base_failed, kept and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted, rules, id_col, text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                found = _judge(texts, model.value, rules)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, found.values())], [id_col, *found])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(judge, f"`{id_col}` {kind}, {_COLUMNS}")


def keep_good(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted, rules, id_col, text_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text_col, SLICE_BYTES):
                yield part.filter(pa.array(_judge(texts, model.value, rules)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


#: DuckDB: score_documents(documents) with labels of quality 1 as trusted, for distinct ids that are not null; the score rounded to six digits.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), '..') AS h FROM t),
single AS (SELECT doc_id, unnest(h) AS x, unnest(range(0, len(h))) AS i FROM bytes),
grams AS (SELECT doc_id, x || lead(x) OVER d || lead(x, 2) OVER d AS g FROM single WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
buckets AS (SELECT doc_id, CAST('0x' || g AS BIGINT) * 2654435761 % 4294967296 // 65536 AS b, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY ALL),
counts AS (SELECT b, sum(n) AS raw, coalesce(sum(n) FILTER (g.doc_id IS NOT NULL), 0) AS target FROM buckets k LEFT JOIN good g ON k.doc_id = g.doc_id GROUP BY b),
sums AS (SELECT sum(raw) AS r, sum(target) AS g FROM counts),
model AS (SELECT b, CASE WHEN g = 0 THEN 0 ELSE CAST(round((ln((target + 1) / (g + 65536)) - ln((raw + 1) / (r + 65536))) * 1048576) AS BIGINT) END AS v FROM counts, sums),
scores AS (SELECT doc_id, CAST(sum(v * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) / 1048576 AS score FROM buckets JOIN model USING (b) GROUP BY doc_id),
listed AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM t),
words AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM listed),
windows AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM listed)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0) AS score
  FROM t JOIN words USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN scores USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score >= -0.5 AS kept, round(score, 6) AS score
FROM base
"""
