"""Exact top-k search by inner product with M-trees.

Vectors are integers. With M the largest norm of any vector, v becomes (v, sqrt(M^2 - |v|^2)) and a query (q, 0): all images
of vectors have norm M, and d(q, v)^2 = |q|^2 + M^2 - 2 q.v, so the nearest images are the largest inner products and the triangle inequality
holds.

Building: rows are dealt to cells by the nearest of a bounded number of pivots, the routing objects of the root; a cell is one tree, or several
if it has over TREE_ROWS rows, however many of them are equal. A tree is bulk-loaded by one task: leaf pages of objects near a
routing object, each with its covering radius and the distances of its entries to it, and a level of routing nodes
above with the same figures for their pages. A tree keeps its own covering radius around its pivot.

Searching: every query is searched in the tree of its own cell first, which gives it a k-th distance. It then meets only those
trees whose root bound (distance to the pivot less the radius) passes that distance. Inside a tree each query has its own order, the
node or page of least possible distance next, until that passes its own reach, the present k-th distance; queries whose next one is the same are
served together. Of a node's pages only those are compared with a query whose stored distance to the node leaves room (|d(q, node) - d(page, node)| - radius within reach), and
likewise for the entries of a page. Scores are exact integers; a bound only skips what is farther than the k-th by more than rounding
can explain.

Defined cases: rows take no part if the id or the vector is null or a component is null or not finite; vectors of
different lengths are not comparable and never meet; a query row's candidates are all other rows, those with its id among them;
repeated query rows each get their answer; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
Scores must fit a long: a vector whose components are too large for that raises an error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint
from pointlens.sources.shared import spread

TREE_ROWS = 1 << 14
PAGE_ROWS = 128
BLOCK_QUERIES = 1 << 11  # a visit of a page serves all queries of a block whose next one it is, so larger blocks share more visits
DEALT_PRODUCTS = 1 << 22  # distances to pivots that a task holds at once
MOST_PIVOT_BYTES = 1 << 26  # of the pivots, which the driver collects and broadcasts
RESULT = "query_id long, rank int, vec_id long, score long"
_NONE = np.int64(-(1 << 62))
_NO_ROW = np.int64(-1)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """_id, _vec (array of long) and a number _row for every row that takes part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return good.select(F.col(id_col).cast("long").alias("_id"), whole.alias("_vec"), F.monotonically_increasing_id().alias("_row"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows are exact in doubles; raises if a long could not hold one."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top >= 1 << 63:
        raise OverflowError("an inner product could exceed a long")
    return top < 1 << 53


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if _fits(a, b) else a @ b.T


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return dict(z)


def _narrow(rows: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    return rows.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(rows).max(initial=0) <= np.iinfo(t).max))


class Metric:
    """Distances between images of vectors under a common largest squared norm."""

    def __init__(self, top: int):
        self.top = float(top)
        self.slack = 1e-5 * (np.sqrt(self.top) + 1)

    def extra(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (v.astype(np.float64) ** 2).sum(axis=1), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = _dots(a, b) + np.outer(self.extra(a), self.extra(b))
        return np.sqrt(np.maximum(2 * (self.top - dots), 0))

    def to_query(self, q_norms: np.ndarray, dots: np.ndarray) -> np.ndarray:
        """Distances of queries with the given squared norms, by inner products (queries in rows)."""
        return np.sqrt(np.maximum(q_norms.reshape(-1, *[1] * (dots.ndim - 1)) + self.top - 2.0 * dots, 0))

    def reach(self, q_norms: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distance within which an object can still enter the k best, whose last score is kth (_NONE: any)."""
        return np.where(kth > _NONE, self.to_query(q_norms, np.maximum(kth, -(1 << 60))) + self.slack, np.inf)


def _assign(metric: Metric, rows: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Choose routing objects evenly over rows; for each row, the nearest one. Returns their places and the choice."""
    places = np.linspace(0, len(rows) - 1, wanted).astype(np.int64)
    choice = np.concatenate([metric.between(rows[i : i + 4096], rows[places]).argmin(axis=1) for i in range(0, len(rows), 4096)])
    return places, choice


def build_tree(ids: np.ndarray, rows: np.ndarray, top: int, page_rows: int = PAGE_ROWS, numbers: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Bulk-load an M-tree of two levels above its objects. numbers: the row numbers of the objects."""
    metric = Metric(top)
    numbers = np.arange(len(ids)) if numbers is None else numbers
    order = np.lexsort((numbers, ids))
    ids, rows, numbers = ids[order], rows[order], numbers[order]
    places, choice = _assign(metric, rows, max(1, -(-len(rows) // page_rows)))
    pages = []
    for p, place in enumerate(places):
        mine = np.flatnonzero(choice == p)
        if not len(mine):
            continue
        away = metric.between(rows[place : place + 1], rows[mine])[0]
        mine, away = mine[np.argsort(away, kind="stable")], np.sort(away)
        for i in range(0, len(mine), 2 * page_rows):  # equal rows can crowd one routing object
            pages.append((place, mine[i : i + 2 * page_rows], away[i : i + 2 * page_rows]))
    centres = rows[[place for place, _, _ in pages]]
    radius = np.array([away[-1] for _, _, away in pages])
    node_places, node_of = _assign(metric, centres, max(1, int(np.sqrt(len(pages)))))
    parent = metric.between(centres, centres[node_places])[np.arange(len(pages)), node_of]
    node_radius = np.zeros(len(node_places))
    np.maximum.at(node_radius, node_of, parent + radius)
    entry = np.concatenate([mine for _, mine, _ in pages])
    return {
        "ids": ids[entry],
        "numbers": numbers[entry],
        "rows": _narrow(rows[entry]),
        "away": np.concatenate([away for _, _, away in pages]),
        "page_at": np.cumsum([0, *(len(mine) for _, mine, _ in pages)]),
        "centres": centres,
        "radius": radius,
        "node_of": node_of,
        "parent": parent,
        "nodes": centres[node_places],
        "node_radius": node_radius,
    }


class Search:
    """The k best objects of a tree for each of some queries. numbers: their row numbers. kth: scores that an object has to reach (none without it)."""

    def __init__(self, tree: dict[str, np.ndarray], queries: np.ndarray, k: int, top: int, numbers: np.ndarray, kth: np.ndarray | None = None):
        self.tree, self.metric, self.numbers = tree, Metric(top), numbers
        self.queries = queries.astype(np.int64)
        self.centres, self.rows = tree["centres"].astype(np.int64), tree["rows"]
        if _fits(self.queries, self.centres) and _fits(self.queries, self.rows):  # doubles from here on: sums are exact
            self.queries, self.centres, self.rows = (x.astype(np.float64) for x in (self.queries, self.centres, self.rows))
        self.norms = (queries.astype(np.float64) ** 2).sum(axis=1)
        n = len(queries)
        self.best, self.best_ids = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, _NONE) if kth is None else kth
        self.reach = self.metric.reach(self.norms, self.floor)
        self.work = 0  # inner products

    def _products(self, live: np.ndarray, objects: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Inner products of the wanted pairs, _NONE elsewhere; all pairs at once if most are wanted. Objects and queries are of one type."""
        a, b = self.queries[live], objects.astype(self.queries.dtype, copy=False)
        n = np.count_nonzero(wanted)
        if 2 * n > wanted.size:
            self.work += wanted.size
            dots = (a @ b.T).astype(np.int64)
            return dots if n == wanted.size else np.where(wanted, dots, _NONE)
        out = np.full(wanted.shape, _NONE)
        of_query, of_object = np.nonzero(wanted)
        self.work += len(of_query)
        for i in range(0, len(of_query), 1 << 15):
            q, o = of_query[i : i + (1 << 15)], of_object[i : i + (1 << 15)]
            out[q, o] = np.einsum("ij,ij->i", a[q], b[o]).astype(np.int64)
        return out

    def _open_node(self, node: int, live: np.ndarray, bounds: np.ndarray, page_d: np.ndarray) -> None:
        tree, n_nodes = self.tree, len(self.tree["nodes"])
        pages = np.flatnonzero(tree["node_of"] == node)
        # what the stored distance to the node says, before any distance to the page is computed
        wanted = np.abs(self.node_d[live, node][:, None] - tree["parent"][pages]) - tree["radius"][pages] <= self.reach[live][:, None]
        used = np.flatnonzero(wanted.any(axis=0))
        if not len(used):
            return
        pages, wanted = pages[used], wanted[:, used]
        d = self.metric.to_query(self.norms[live], np.where(wanted, self._products(live, self.centres[pages], wanted), 0))
        y, x = np.nonzero(wanted)
        page_d[live[y], pages[x]] = d[y, x]
        bounds[live[y], n_nodes + pages[x]] = d[y, x] - tree["radius"][pages[x]]

    def _visit_page(self, page: int, live: np.ndarray, page_d: np.ndarray) -> None:
        tree = self.tree
        start, end = tree["page_at"][page], tree["page_at"][page + 1]
        wanted = np.abs(page_d[live, page][:, None] - tree["away"][start:end]) <= self.reach[live][:, None]
        wanted &= tree["numbers"][start:end] != self.numbers[live][:, None]
        ids, objects = tree["ids"][start:end], self.rows[start:end]
        used = wanted.any(axis=0)
        if not used.all():
            if not used.any():
                return
            ids, objects, wanted = ids[used], objects[used], wanted[:, used]
        scores = self._products(live, objects, wanted)
        y, x = np.nonzero(scores >= np.maximum(np.maximum(self.best[live, -1], self.floor[live]), _NONE + 1)[:, None])
        if not len(y):
            return
        # what enters, beside the best so far of the same queries; they are sorted by query, score and id, and each query keeps its first k
        mine, of = np.unique(y, return_inverse=True)
        mine, k = live[mine], self.best.shape[1]
        all_of = np.concatenate([np.repeat(np.arange(len(mine)), k), of])
        all_scores = np.concatenate([self.best[mine].ravel(), scores[y, x]])
        all_ids = np.concatenate([self.best_ids[mine].ravel(), ids[x]])
        order = np.lexsort((all_ids, -all_scores, all_of))
        starts = np.arange(len(mine)) * k + np.concatenate([[0], np.cumsum(np.bincount(of))[:-1]])
        first = order[(starts[:, None] + np.arange(k)).ravel()]
        self.best[mine], self.best_ids[mine] = all_scores[first].reshape(-1, k), all_ids[first].reshape(-1, k)
        self.reach[mine] = self.metric.reach(self.norms[mine], np.maximum(self.best[mine, -1], self.floor[mine]))

    def run(self) -> Search:
        tree, n, n_nodes = self.tree, len(self.queries), len(self.tree["nodes"])
        dots = _dots(self.queries, tree["nodes"])
        self.work += dots.size
        self.node_d = self.metric.to_query(self.norms, dots)
        bounds = np.concatenate([self.node_d - tree["node_radius"], np.full((n, len(tree["centres"])), np.inf)], axis=1)  # each query's queue
        page_d = np.full((n, len(tree["centres"])), np.inf)
        live = np.arange(n)
        while len(live):
            nearest = bounds[live].argmin(axis=1)
            least = bounds[live, nearest]
            go = np.isfinite(least) & (least <= self.reach[live])
            live, nearest = live[go], nearest[go]
            bounds[live, nearest] = np.inf
            order = np.argsort(nearest, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(nearest[order])) + 1) if len(order) else []:
                self._visit(int(nearest[group[0]]), live[group], bounds, page_d)
        return self

    def _visit(self, what: int, live: np.ndarray, bounds: np.ndarray, page_d: np.ndarray) -> None:
        n_nodes = len(self.tree["nodes"])
        if what < n_nodes:
            self._open_node(what, live, bounds, page_d)
        else:
            self._visit_page(what - n_nodes, live, page_d)


def search_tree(tree: dict[str, np.ndarray], numbers: np.ndarray, queries: np.ndarray, k: int, top: int, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best objects of a tree for each query (unused places have score _NONE), and how many inner products it took."""
    done = Search(tree, queries, k, top, numbers, kth).run()
    return done.best, done.best_ids, done.work


def _dealt(rows: DataFrame, pivots: np.ndarray, top: int) -> DataFrame:
    """Adds _cell, the nearest pivot, and _away, the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    size = max(1, DEALT_PRODUCTS // max(1, len(pivots)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metric = Metric(top)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                d = metric.between(_matrix(part.column("_vec"), shared.value.shape[1]), shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*part.schema.names, "_cell", "_away"])

    return rows.mapInArrow(deal, "_id long, _vec array<long>, _row long, _cell int, _away double")


def _top_k_of_length(rows: DataFrame, dim: int, n: int, is_query: Column, k: int, counter: Accumulator | None) -> DataFrame:
    """rows: _id, _vec, _row with vectors of dim components; n: how many."""
    spark = rows.sparkSession
    top = int(rows.agg(F.max(F.aggregate("_vec", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x * x).cast("decimal(38,0)")))).first()[0] or 0)
    if top >= 1 << 61:
        raise OverflowError("an inner product could exceed a long")
    wanted = max(1, min(MOST_PIVOT_BYTES // (8 * max(dim, 1)), n // TREE_ROWS))
    chosen = [r._vec for r in rows.orderBy(F.xxhash64("_id", "_row")).limit(wanted).collect()]
    pivots = np.array(chosen, np.int64).reshape(len(chosen), dim)
    dealt = checkpoint(_dealt(rows, pivots, top))
    cells = dealt.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_away").alias("radius"), F.count_if(is_query).alias("asked")).collect()  # a row for each pivot at most
    counts = np.zeros(len(pivots), np.int64)
    radius, asked = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in cells:
        counts[r._cell], radius[r._cell], asked[r._cell] = -(-r.n // TREE_ROWS), r.radius, -(-r.asked // BLOCK_QUERIES)
    if not asked.any():
        return spark.createDataFrame([], RESULT)
    first = np.cumsum(counts) - counts
    layout = spark.createDataFrame([(int(c), int(first[c]), int(counts[c]), int(asked[c])) for c in np.flatnonzero(counts)], "_of int, _first int, _trees int, _blocks int")
    placed = dealt.join(F.broadcast(layout), F.col("_cell") == F.col("_of"))  # a row for each pivot at most
    numbered = placed.withColumn("_tree", (F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_trees"))).cast("int"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree = build_tree(table["_id"].to_numpy(), _matrix(table["_vec"], dim), top, numbers=table["_row"].to_numpy())
        return pa.table({"_tree": pa.array([key[0].as_py()], pa.int32()), "_tree_data": pa.array([_save(**tree)], pa.binary())})

    trees = checkpoint(numbered.groupBy("_tree").applyInArrow(build, "_tree int, _tree_data binary"))

    # a block of queries of one cell, and the first tree of it
    questions = placed.where(is_query).withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks")))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        data = _save(row=table["_row"].to_numpy(), ids=table["_id"].to_numpy(), rows=_narrow(_matrix(table["_vec"], dim)))
        return pa.table({"_home": pa.array([key[0].as_py()], pa.int32()), "_block_data": pa.array([data], pa.binary())})

    packed = questions.groupBy("_first", "_block").applyInArrow(pack, "_home int, _block_data binary")
    spread_trees = spread(trees, "_tree")  # a block takes long for its bytes
    at_home = spread(packed, "_home").join(spread_trees, F.col("_home") == F.col("_tree")).select("_home", "_block_data", "_tree_data")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
        held, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                where = batch.column(0)[i].as_py()
                if where != held:
                    held, tree = where, _load(batch.column("_tree_data")[i].as_py())
                block = _load(batch.column("_block_data")[i].as_py())
                scores, ids, work = search_tree(tree, block["row"], block["rows"], k, top, block.get("kth"))
                if counter is not None:
                    counter.add(work)
                yield where, block, scores, ids

    def found_rows(block: dict, scores: np.ndarray, ids: np.ndarray) -> tuple[list[pa.Array], list[str]]:
        used = scores > _NONE
        per = used.sum(axis=1)
        return [pa.array(np.repeat(block["row"], per)), pa.array(np.repeat(block["ids"], per)), pa.array(ids[used]), pa.array(scores[used])], ["_row", "query_id", "vec_id", "score"]

    def search_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, block, scores, ids in searched(batches):
            data = _save(row=block["row"], ids=block["ids"], rows=block["rows"], kth=scores[:, -1])
            arrays, _ = found_rows(block, scores, ids)
            yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([data], pa.binary()), *[pa.array([a.to_numpy()], pa.list_(pa.int64())) for a in arrays]], ["_home", "_asked", "rows", "queries", "vecs", "scores"])

    home = checkpoint(at_home.mapInArrow(search_home, "_home int, _asked binary, rows array<long>, queries array<long>, vecs array<long>, scores array<long>"))
    shared = spark.sparkContext.broadcast((pivots, radius, np.repeat(np.arange(len(pivots)), counts)))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each other tree whose root bound passes, the queries of a block that it has to answer."""
        metric = Metric(top)
        centres, around, cell_of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, where = _load(batch.column("_asked")[i].as_py()), batch.column("_home")[i].as_py()
                norms = (block["rows"].astype(np.float64) ** 2).sum(axis=1)
                bound = metric.to_query(norms, _dots(block["rows"].astype(np.int64), centres)) - around
                passes = (bound <= metric.reach(norms, block["kth"])[:, None])[:, cell_of]
                passes[:, where] = False
                for tree in np.flatnonzero(passes.any(axis=0)):
                    some = passes[:, tree]
                    data = _save(**{name: a[some] for name, a in block.items()})
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([data], pa.binary())], ["_to", "_block_data"])

    away = checkpoint(home.select("_home", "_asked").mapInArrow(pass_on, "_to int, _block_data binary"))
    meet = spread(away, "_to").join(spread_trees, F.col("_to") == F.col("_tree")).select("_to", "_block_data", "_tree_data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, scores, ids in searched(batches):
            yield pa.RecordBatch.from_arrays(*found_rows(block, scores, ids))

    zipped = F.explode(F.arrays_zip("rows", "queries", "vecs", "scores")).alias("z")
    own = home.select(zipped).select(F.col("z.rows").alias("_row"), F.col("z.queries").alias("query_id"), F.col("z.vecs").alias("vec_id"), F.col("z.scores").alias("score"))
    found = own.unionByName(meet.mapInArrow(search, "_row long, query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", counter: Accumulator | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k largest inner products with other rows.

    Components are floor(scale * x). is_query: a condition on `_id`, the id as long. counter: adds up the inner products that searches compute.
    """
    rows = checkpoint(_rows(vectors, id_col, vector_col, scale))
    lengths = rows.groupBy(F.size("_vec").alias("dim")).count().collect()  # a table's vectors have few lengths
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for dim, n in sorted((r.dim, r["count"]) for r in lengths):
        out = out.unionByName(_top_k_of_length(rows.where(F.size("_vec") == dim), dim, n, is_query, k, counter))
    return out


#: DuckDB: top_k(embeddings) for queries whose vec_id is divisible by 20.
ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
scores AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i WHERE q.id % 20 = 0 AND q.id <> c.id GROUP BY q.id, c.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
