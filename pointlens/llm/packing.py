"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. A document's ids, with the end id, are cut into pieces of `capacity` ids and a rest. Pieces are written to a table with the number of their task
   (`part`) and, within it, a running number for each length (`nth`), so that a piece's rank among all pieces of its length is its `nth` plus a sum of counts
   of earlier parts: nothing is sorted, and no length is gathered, however common.
2. The histogram of lengths, of at most `capacity` rows, goes to the driver. A linear program chooses how often to use each pattern (a multiset of
   lengths that fills a sequence exactly), so that as many ids as possible lie in uncut pieces: the simplex method with column
   generation, whose columns are priced by knapsack dynamic programming over the sequence. It ends at the optimum, at a share of ENOUGH of all ids
   left over, or after PIVOTS pivots for each length.
3. Rounded counts give each length a list of rank ranges, a pattern and a slot for each. What they leave over is a stream, again by
   rank ranges, that is cut at every `capacity` ids, and at powers of two within its last sequence. So no sequence needs padding, and only the
   stream's pieces are cut.
4. A piece's rank gives its sequence and its offset by arithmetic, in the tasks that read the pieces.

How far the program gets only decides how many pieces are cut, never whether a piece is packed.

Defined cases: a null text counts as empty (its ids are the end id alone; without an end id it has no piece); null ids stay as they are; repeated rows
are packed each; an empty table gives an empty result; a text of any length is cut like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlens.llm.bpe import BpeModel, Encoder
from pointlens.llm.common import checkpoint, small, text_slices

CAPACITY = 2048
SLICE_BYTES = 1 << 23  # of text that is encoded at once; its different pieces are looked up once
ENOUGH = 0.02  # share of ids left over at which the linear program may end
PIVOTS = 2  # most pivots for each length
COLUMNS = 128  # most new columns of a pricing round
REFRESH = 400  # pivots after which the inverse is computed anew
BATCH_PIECES = 1 << 10


@dataclass
class Pattern:
    lengths: np.ndarray
    counts: np.ndarray
    times: int = 0


def _price(lengths: np.ndarray, cost: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the least cost of lengths that add up to each total (inf if none do), and the place of one of them."""
    least, last = np.full(capacity + 1, np.inf), np.zeros(capacity + 1, np.int64)
    least[0] = 0
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for total in range(int(lengths[0]), capacity + 1):
        ways = least[total - lengths[: fits[total]]] + cost[: fits[total]]
        last[total] = best = ways.argmin()
        least[total] = ways[best]
    return least, last


def _columns(lengths: np.ndarray, duals: np.ndarray, spare: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Patterns that would improve the program, as places of lengths and how often: the cheapest one around each length, with few lengths in common."""
    tilt = 1e-7 / (1 + spare)  # among equal ones, those of which much is left
    cost = duals + tilt
    least, last = _price(lengths, cost, capacity)
    around = cost + least[capacity - lengths]
    found, used = [], np.zeros(len(lengths), bool)
    for first in np.argsort(around, kind="stable"):
        if around[first] >= 1 - 1e-6 or len(found) >= COLUMNS:
            break
        if used[first]:
            continue
        items, left = [first], capacity - lengths[first]
        while left:
            items.append(last[left])
            left -= lengths[last[left]]
        places, counts = np.unique(items, return_counts=True)
        used[places] = True
        found.append((places, counts))
    return found


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """The linear program over patterns, rounded: patterns with how often each is used, never more of a length than its demand.

    lengths: ascending, below capacity. The simplex method starts from the basis of leftovers.
    """
    m = len(lengths)
    if not m:
        return []
    supply = demand * (1 + 1e-7 * np.random.default_rng(1).random(m))  # no ties between ratios
    inverse, value, duals = np.eye(m), supply.astype(float), np.zeros(m)
    basis: list[tuple[np.ndarray, np.ndarray] | None] = [None] * m  # None: what is left over of the length of that place
    owner = np.arange(m)
    all_ids, pivots, since = float(demand @ lengths), 0, 0
    while pivots < PIVOTS * m:
        over = np.zeros(m)
        free = [i for i, b in enumerate(basis) if b is None]
        over[owner[free]] = value[free]
        if over @ lengths <= ENOUGH * all_ids:
            break
        new = _columns(lengths, duals, over, capacity)
        before = pivots
        for places, counts in new:
            gain = 1 - counts @ duals[places]
            if gain <= 1e-9:
                continue
            column = inverse[:, places] @ counts
            rising = np.flatnonzero(column > 1e-7)
            ratios = np.maximum(value[rising], 0) / column[rising]
            tied = rising[ratios <= ratios.min() + 1e-9]
            leaving = tied[column[tied].argmax()]  # the steadiest of those that reach zero
            step = max(value[leaving], 0.0) / column[leaving]
            row = inverse[leaving] / column[leaving]
            value -= step * column
            value[leaving] = step
            touched, across = np.flatnonzero(np.abs(column) > 1e-12), np.flatnonzero(np.abs(row) > 1e-12)
            touched = touched[touched != leaving]
            inverse[np.ix_(touched, across)] -= np.outer(column[touched], row[across])
            inverse[leaving] = row
            duals += gain * row
            basis[leaving] = (places, counts)
            pivots, since = pivots + 1, since + 1
        if pivots == before:
            break
        if since >= REFRESH:
            since = 0
            matrix = np.zeros((m, m))
            for i, b in enumerate(basis):
                if b is None:
                    matrix[owner[i], i] = 1
                else:
                    matrix[b[0], i] = b[1]
            inverse = np.linalg.inv(matrix)
            value, duals = np.maximum(inverse @ supply, 0), np.array([b is not None for b in basis], float) @ inverse
    return _rounded(lengths, demand, [(p, value[i]) for i, p in enumerate(basis) if p is not None])


def _rounded(lengths: np.ndarray, demand: np.ndarray, used: list[tuple[tuple[np.ndarray, np.ndarray], float]]) -> list[Pattern]:
    """Times rounded down, then one more of each pattern for which enough is left, the largest fractions first."""
    left, out = demand.astype(np.int64), []
    for (places, counts), times in sorted(used, key=lambda u: -u[1]):
        whole = int(min(np.floor(times + 1e-6), (left[places] // counts).min()))
        left[places] -= whole * counts
        out.append((places, counts, whole, times - whole))
    for i in np.argsort([-o[3] for o in out], kind="stable"):
        places, counts, whole, part = out[i]
        if part > 1e-6 and (left[places] >= counts).all():
            left[places] -= counts
            out[i] = (places, counts, whole + 1, 0.0)
    return [Pattern(lengths[places], counts, whole) for places, counts, whole, _ in out if whole]


@dataclass
class Plan:
    """Rank ranges by length. A range belongs to a pattern (copies of the length in it, offset of the first one, its first sequence), or to the stream (copies 0,
    offset: place of the first one). Ranges lie in `first` in the order of their keys, length * 2^44 + first rank."""

    capacity: int
    keys: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    sequence: np.ndarray
    stream_sequence: int
    stream: int  # ids in the stream

    SHIFT = 44

    @classmethod
    def make(cls, lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> Plan:
        below = lengths < capacity
        patterns = solve(lengths[below], demand[below], capacity)
        patterns += [Pattern(lengths[~below], np.ones(1, np.int64), int(n)) for n in demand[~below]]
        given = dict.fromkeys(lengths.tolist(), 0)
        ranges, sequence, stream = [], 0, 0
        for p in patterns:
            offset = 0
            for length, count in zip(p.lengths.tolist(), p.counts.tolist()):
                ranges.append((length, given[length], count, offset, sequence))
                given[length] += count * p.times
                offset += count * length
            sequence += p.times
        for length, n in zip(lengths.tolist(), demand.tolist()):
            if n > given[length]:
                ranges.append((length, given[length], 0, stream, sequence))
                stream += (n - given[length]) * length
        ranges.sort()
        a = np.array(ranges, np.int64).reshape(-1, 5)
        return cls(capacity, (a[:, 0] << cls.SHIFT) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4], sequence, stream)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> dict[str, np.ndarray]:
        """For pieces of given lengths and ranks: row (which piece), cut_at and size (of what of it), sequence_id, offset."""
        r = np.searchsorted(self.keys, (lengths << self.SHIFT) + ranks, side="right") - 1
        k, copies = ranks - self.first[r], self.copies[r]
        packed = np.flatnonzero(copies > 0)
        turn, slot = k[packed] // copies[packed], k[packed] % copies[packed]
        out = [(packed, np.zeros(len(packed), np.int64), lengths[packed], self.sequence[r[packed]] + turn, self.offset[r[packed]] + slot * lengths[packed])]
        rest = np.flatnonzero(copies == 0)
        if len(rest):
            out.append(self._cut(rest, self.offset[r[rest]] + k[rest] * lengths[rest], lengths[rest]))
        return dict(zip(("row", "cut_at", "size", "sequence_id", "offset"), (np.concatenate(c) for c in zip(*out))))

    def _cut(self, rows: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """The stream's pieces from `start` on, cut at every capacity and at the powers of two that make up its last sequence."""
        whole, left = divmod(self.stream, self.capacity)
        tail = whole * self.capacity
        ends = tail + np.cumsum([1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], dtype=np.int64)
        bounds = lambda a: np.where(a < tail, a // self.capacity, whole + np.searchsorted(ends, a, side="right"))  # noqa: E731  number of an id's sequence
        begins = np.concatenate([[tail], ends])
        from_ = lambda s: np.where(s < whole, s * self.capacity, begins[np.clip(s - whole, 0, len(begins) - 1)])  # noqa: E731  first id of a sequence
        one, last = bounds(start), bounds(start + lengths - 1)
        times = last - one + 1
        row = np.repeat(np.arange(len(rows)), times)
        number = one[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        low, high = np.maximum(from_(number), start[row]), np.minimum(from_(number + 1), (start + lengths)[row])
        return rows[row], low - start[row], high - low, self.stream_sequence + number, low - from_(number)


def write_pieces(docs: DataFrame, tokenizer: str, path: str, end_id: int | None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs with a byte-level tokenizer file (a path on the driver) and write their pieces to `path`, which any executor can reach."""
    model = docs.sparkSession.sparkContext.broadcast(BpeModel.load(tokenizer))
    tail = np.array([] if end_id is None else [end_id], np.int32)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = None, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, texts in text_slices(batch, "_text", SLICE_BYTES):
                encoder = encoder or Encoder(model.value)
                ids = [np.concatenate([own, tail]) for own in encoder.encode(texts)]
                sizes = np.array([len(i) for i in ids], np.int64)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(ids)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                nth = np.empty(len(doc), np.int64)
                for i, n in enumerate(length.tolist()):
                    nth[i] = seen[n]
                    seen[n] += 1
                for i in range(0, len(doc), BATCH_PIECES):
                    of, at, n = doc[i : i + BATCH_PIECES], start[i : i + BATCH_PIECES], length[i : i + BATCH_PIECES]
                    data = [ids[d][s : s + m].astype("<u4").tobytes() for d, s, m in zip(of.tolist(), at.tolist(), n.tolist())]
                    columns = [rows.column("_id").take(pa.array(of)), pa.array(at), pa.array(n.astype(np.int32)), pa.array(sizes[of]), pa.array(np.full(len(of), part, np.int32)), pa.array(nth[i : i + BATCH_PIECES]), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "start", "length", "doc_tokens", "part", "nth", "ids"])
        encoder = None
        pa.default_memory_pool().release_unused()  # for the tasks of other stages that this worker may get

    schema = f"_id {kind}, start long, length int, doc_tokens long, part int, nth long, ids binary"
    docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, schema).write.option("compression", "zstd").parquet(path)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds cut_at, size, sequence_id and offset to rows of pieces, and splits those that are cut. Their other columns stay as they are."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    table = checkpoint(counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), "_n", F.coalesce(before, F.lit(0)).alias("_before")))
    found = sorted(tuple(r) for r in table.groupBy("_length").agg(F.sum("_n")).collect())  # a row for each length
    plan = Plan.make(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    ranked = pieces.join(small(table), (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("_rank", F.col("_before") + F.col("nth"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = shared.value.place(batch.column("length").to_numpy().astype(np.int64), batch.column("_rank").to_numpy())
                kept = batch.drop_columns(["_rank"]).take(pa.array(got["row"]))
                yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(got[c]) for c in ("cut_at", "size", "sequence_id", "offset")]], [*kept.schema.names, "cut_at", "size", "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.select(*pieces.columns, "_rank").mapInArrow(put, f"{fields}, cut_at long, size long, sequence_id long, offset long")


def _ids_of(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds `ids`, those of the part of a piece that lies in the sequence."""
    stored = pieces.select(F.col("part").alias("_p"), F.col("length").alias("_l"), F.col("nth").alias("_k"), F.col("ids").alias("_ids"))
    met = stored.join(small(placed), (F.col("_p") == F.col("part")) & (F.col("_l") == F.col("length")) & (F.col("_k") == F.col("nth")))
    return met.withColumn("ids", F.substring("_ids", F.col("cut_at") * 4 + 1, F.col("size") * 4)).select(*placed.columns, "ids")


def pack_digest(docs: DataFrame, tokenizer: str, path: str, end_id: int | None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, cut ones for each part: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. Ids are digested where they lie; only the cut pieces' are fetched."""
    spark = docs.sparkSession
    write_pieces(docs, tokenizer, path, end_id, capacity, id_col, text_col)
    pieces = spark.read.parquet(path)
    placed = checkpoint(place(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), capacity))
    whole = F.col("size") == F.col("length")
    cut = _ids_of(placed.where(~whole), pieces).withColumn("crc", F.crc32("ids")).drop("ids")
    out = placed.where(whole).unionByName(cut)
    return out.select(F.col("_id").alias(id_col), (F.col("start") + F.col("cut_at")).alias("start"), F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(spark: SparkSession, path: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array of long, gapless, at most `capacity`) from written pieces: the packed sequences themselves, whose ids are shuffled once."""
    pieces = spark.read.parquet(path)
    placed = checkpoint(place(pieces.drop("ids"), capacity))
    parts = _ids_of(placed, pieces).select("sequence_id", F.struct("offset", "ids").alias("p"))
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype(np.int64) for ps in batch.column("ps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(data, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return joined.mapInArrow(read, "sequence_id long, ids array<long>")
