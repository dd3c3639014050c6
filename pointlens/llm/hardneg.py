"""Hard-negative mining by a two-dimensional block matrix multiply.

Scores are inner products of anchors (a stated set of rows) with all rows. Both sides are cut into blocks of rows, and each block into chunks of
dimensions. A task holds one anchor block and one row block of one chunk (i, j, c) and multiplies them to a partial int64 tile;
a shuffle on (i, j) brings the partial tiles of all chunks together, and their sum is the score tile. The chunks of a tile
are at most MOST_CHUNKS, so a task's memory is bounded by the tile's size, whatever the vectors' length and the table's.

A summed tile is reduced where it arises: to each anchor's best same-label rows, and to those of its other-label entries that a window can
still hold. The positives of an anchor in the whole table score at least as much as those in one tile, so what lies below the
share of the tile's own last positive lies in no window; negative windows are empty. Nothing else is dropped. When the positives of all tiles
are merged, each anchor block's windows go to the block's tiles, a tile gives each window its first k entries,
and a last ranking merges them.

Defined cases: rows take no part if the id, the label or the vector is null or a component is null or not finite; vectors of
different lengths are not comparable and never meet; other rows with the anchor's id are other rows; repeated anchor rows are mined
once each; anchors without a positive, and windows without a row, give no result; ties go to the smaller id, then to one of the
rows with that id; an empty table gives an empty result; other columns are ignored. Scores must fit a long, otherwise an error is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint
from pointlens.llm.topk import _dots, _matrix, _narrow
from pointlens.sources.shared import spread

ANCHOR_ROWS = 128  # of a block; with BLOCK_ROWS a tile of 4 MB
BLOCK_ROWS = 4096
CHUNK_DIMS = 32
MOST_CHUNKS = 8  # of a vector; longer ones get wider chunks
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BLOCK = "_c int, _ids array<long>, _labels array<long>, _numbers array<long>, _data binary, _width int"
_PIECE = "_i int, _j int, _c int, _side int, _ids array<long>, _labels array<long>, _numbers array<long>, _data binary, _width int"
_PARTIAL = "_i int, _j int, _a_ids array<long>, _a_labels array<long>, _a_numbers array<long>, _b_ids array<long>, _b_labels array<long>, _b_numbers array<long>, _tile binary, _bits int"
_REDUCED = "_i int, _j int, pos_at array<int>, pos_anchor array<long>, pos_anchor_id array<long>, pos_number array<long>, pos_id array<long>, pos_score array<long>, neg_at array<int>, neg_id array<long>, neg_number array<long>, neg_score array<long>"


def _array(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """One row that holds an array."""
    return pa.array([np.asarray(values)], pa.list_(kind))


def _blocks(rows: DataFrame, block: str, dim: int, chunk: int) -> DataFrame:
    """A row for each block and chunk of dimensions."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        m = _matrix(table["_vec"], dim)
        n = -(-dim // chunk)
        cut = [_narrow(m[:, c * chunk : (c + 1) * chunk]) for c in range(n)]
        once = lambda name: pa.array([table[name].to_numpy()] + [[]] * (n - 1), pa.list_(pa.int64()))  # noqa: E731  the first chunk carries them
        return pa.table(
            {
                block: pa.array([key[0].as_py()] * n, pa.int32()),
                "_c": pa.array(range(n), pa.int32()),
                "_ids": once("_id"),
                "_labels": once("_label"),
                "_numbers": once("_row"),
                "_data": pa.array([x.tobytes() for x in cut], pa.binary()),
                "_width": pa.array([x.itemsize for x in cut], pa.int32()),
            }
        )

    return rows.groupBy(block).applyInArrow(pack, f"{block} int, {_BLOCK}")


def multiply(side: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The partial int64 tile of two blocks' chunks."""
    return _dots(side.astype(np.int64), other.astype(np.int64))


def first_k(scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id, then by number."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
        return some[np.lexsort((numbers[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((numbers, ids, -scores))[:k]


def reduce_tile(scores: np.ndarray, anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], positives: int, low: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each anchor (a row of scores), places of its best same-label rows, and of the other-label rows that a window may hold."""
    best, open_ = [], []
    for a in range(len(scores)):
        same = rows["labels"] == anchors["labels"][a]
        mine = np.flatnonzero(same & (rows["numbers"] != anchors["numbers"][a]))
        top = mine[first_k(scores[a, mine], rows["ids"][mine], rows["numbers"][mine], positives)]
        least = max(int(scores[a, top[-1]]), 0) if len(top) == positives else 0
        best.append(top)
        open_.append(np.flatnonzero(~same & (scores[a] >= -(-low * least // 100))))
    return best, open_


def in_window(scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray, positive: int, low: int, high: int, k: int) -> np.ndarray:
    """Places of the first k entries with low * positive <= 100 * score <= high * positive."""
    inside = np.flatnonzero((scores >= -(-low * positive // 100)) & (scores <= high * positive // 100))
    return inside[first_k(scores[inside], ids[inside], numbers[inside], k)]


def _partials(pieces: DataFrame, chunk: int, dim: int) -> DataFrame:
    """Partial tiles of all (i, j, c)."""

    long, short = pa.list_(pa.int64()), pa.int32()
    out, kinds = [c.split()[0] for c in _PARTIAL.split(", ")], [short, short, *[long] * 6, pa.binary(), short]

    def product(key: tuple, table: pa.Table) -> pa.Table:
        side = {table["_side"][r].as_py(): r for r in range(table.num_rows)}
        if len(side) < 2:  # no row was dealt to the other block
            return pa.table({name: pa.array([], kind) for name, kind in zip(out, kinds)})
        a, b = side[0], side[1]
        c = key[2].as_py()
        width = min(chunk, dim - c * chunk)
        block = lambda r: np.frombuffer(table["_data"][r].as_py(), f"<i{table['_width'][r].as_py()}").reshape(-1, width)
        tile = _narrow(multiply(block(a), block(b)))
        columns = {"_i": pa.array([key[0].as_py()], pa.int32()), "_j": pa.array([key[1].as_py()], pa.int32())}
        for mark, r in (("a", a), ("b", b)):
            columns |= {f"_{mark}_{name}": _array(table[f"_{name}"][r].values.to_numpy(), pa.int64()) for name in ("ids", "labels", "numbers")}
        return pa.table(columns | {"_tile": pa.array([tile.tobytes()], pa.binary()), "_bits": pa.array([tile.itemsize], pa.int32())})

    return spread(pieces, "_i", "_j", "_c").groupBy("_i", "_j", "_c").applyInArrow(product, _PARTIAL)


def _reduced(partials: DataFrame, positives: int, low: int) -> DataFrame:
    """Each tile's sum over its chunks, reduced to what can matter, as one row."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        head = next(r for r in range(table.num_rows) if len(table["_a_ids"][r].values))
        side = lambda mark: {name: table[f"_{mark}_{name}"][head].values.to_numpy() for name in ("ids", "labels", "numbers")}
        anchors, rows = side("a"), side("b")
        scores = np.zeros((len(anchors["ids"]), len(rows["ids"])), np.int64)
        for r in range(table.num_rows):
            scores += np.frombuffer(table["_tile"][r].as_py(), f"<i{table['_bits'][r].as_py()}").reshape(scores.shape)
        best, rest = reduce_tile(scores, anchors, rows, positives, low)
        flat = lambda places: (np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64))
        (pa_at, p), (na_at, n) = flat(best), flat(rest)
        long, short = pa.int64(), pa.int32()
        values = (
            (pa_at, short), (anchors["numbers"][pa_at], long), (anchors["ids"][pa_at], long), (rows["numbers"][p], long), (rows["ids"][p], long), (scores[pa_at, p], long),
            (na_at, short), (rows["ids"][n], long), (rows["numbers"][n], long), (scores[na_at, n], long),
        )
        names = [c.split()[0] for c in _REDUCED.split(", ")]
        return pa.table([pa.array([key[0].as_py()], short), pa.array([key[1].as_py()], short), *[_array(v, kind) for v, kind in values]], names)

    return spread(partials, "_i", "_j").groupBy("_i", "_j").applyInArrow(add, _REDUCED)


def _windows(reduced: DataFrame, positives: int) -> DataFrame:
    """Each anchor's first positives over all tiles: _i, _at (its place in the block), anchor and positive figures."""
    zipped = F.explode(F.arrays_zip("pos_at", "pos_anchor", "pos_anchor_id", "pos_number", "pos_id", "pos_score")).alias("p")
    flat = reduced.select("_i", zipped).select("_i", "p.*")
    rank = F.row_number().over(Window.partitionBy("pos_anchor").orderBy(F.col("pos_score").desc(), "pos_id", "pos_number"))
    return flat.withColumn("_nth", rank).where(F.col("_nth") <= positives)


def _within(reduced: DataFrame, windows: DataFrame, tiles: int, low: int, high: int, k: int) -> DataFrame:
    """Each tile's first k entries of each window of its anchors."""
    # the windows of a block go to each of its tiles, so that no block's tiles meet in one task
    sent = windows.where("pos_score >= 0").select("_i", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_j"), F.struct("pos_at", "pos_anchor", "pos_anchor_id", "_nth", "pos_id", "pos_score").alias("_w"))
    names = ["pos_anchor", "pos_anchor_id", "_nth", "pos_id", "pos_score"]
    wide = "_i int, _j int, neg_at array<int>, neg_id array<long>, neg_number array<long>, neg_score array<long>"
    both = reduced.select(*[c.split()[0] for c in wide.split(", ")], F.lit(None).cast(sent.schema["_w"].dataType).alias("_w"))
    both = both.unionByName(sent.select("_i", "_j", "_w"), allowMissingColumns=True)

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        tile = next((r for r in range(table.num_rows) if table["_w"][r].as_py() is None), None)
        asked = [w for w in table["_w"].to_pylist() if w is not None]
        out: list[tuple] = []
        if tile is not None:
            at, ids, numbers, scores = (table[c][tile].values.to_numpy() for c in ("neg_at", "neg_id", "neg_number", "neg_score"))
            for w in asked:
                start, end = np.searchsorted(at, [w["pos_at"], w["pos_at"] + 1])
                mine = start + in_window(scores[start:end], ids[start:end], numbers[start:end], w["pos_score"], low, high, k)
                out += [(*[w[c] for c in names], int(ids[m]), int(numbers[m]), int(scores[m])) for m in mine]
        columns = list(zip(*out)) or [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], [*names, "neg_id", "neg_number", "neg_score"])

    schema = "pos_anchor long, pos_anchor_id long, _nth int, pos_id long, pos_score long, neg_id long, neg_number long, neg_score long"
    return spread(both, "_i", "_j").groupBy("_i", "_j").applyInArrow(choose, schema)


def _mine_length(rows: DataFrame, dim: int, n: int, asked: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """rows: _id, _label, _vec, _row, _anchor with vectors of dim components; n rows, of which `asked` are anchors."""
    chunk = max(1, CHUNK_DIMS, -(-dim // MOST_CHUNKS))
    row_blocks, anchor_blocks = -(-n // BLOCK_ROWS), -(-asked // ANCHOR_ROWS)
    place = lambda blocks, salt: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(blocks)).cast("int")
    a = _blocks(rows.where("_anchor").withColumn("_i", place(anchor_blocks, 1)), "_i", dim, chunk)
    b = _blocks(rows.withColumn("_j", place(row_blocks, 2)), "_j", dim, chunk)
    cross = lambda df, column, blocks, side: df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_side", F.lit(side))
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    both = cross(a, "_j", row_blocks, 0).select(columns).unionByName(cross(b, "_i", anchor_blocks, 1).select(columns))
    reduced = checkpoint(_reduced(_partials(both, chunk, dim), positives, low))
    windows = checkpoint(_windows(reduced, positives))
    found = _within(reduced, windows, row_blocks, low, high, negatives)
    rank = F.row_number().over(Window.partitionBy("pos_anchor", "_nth").orderBy(F.col("neg_score").desc(), "neg_id", "neg_number"))
    return (
        found.withColumn("rank", rank)
        .where(F.col("rank") <= negatives)
        .select(F.col("pos_anchor_id").alias("anchor_id"), F.col("pos_id").alias("positive_id"), F.col("rank").cast("int"), F.col("neg_id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("neg_score").alias("negative_score"))
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: for each anchor and positive the first different-label rows of its window.

    Components are floor(scale * x). is_anchor: a condition on `_id`, the id as long; label: an expression over `_id` and `_label`
    (default `_label`). A window holds scores from low to high hundredths of the positive's score.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    named = good.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), whole.alias("_vec"))
    if label is not None:
        named = named.withColumn("_label", label.cast("long"))
    rows = checkpoint(named.withColumn("_anchor", is_anchor).withColumn("_row", F.monotonically_increasing_id()))
    out = vectors.sparkSession.createDataFrame([], RESULT)
    lengths = rows.groupBy(F.size("_vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if("_anchor").alias("asked"), F.max(F.array_max(F.transform("_vec", F.abs))).alias("top")).collect()  # few lengths
    for r in sorted(lengths):
        if r.dim and r.dim * r.top**2 >= 1 << 63:
            raise OverflowError("an inner product could exceed a long")
        if r.asked and r.dim:
            out = out.unionByName(_mine_length(rows.where(F.size("_vec") == r.dim), r.dim, r.n, r.asked, positives, negatives, low, high))
    return out


#: DuckDB: mine(embeddings) for anchors whose id is divisible by 100, with the labels of every seventh id moved on.
ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
scores AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY a.id, b.id, a.label, b.label),
positives AS (SELECT anchor_id, other_id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
