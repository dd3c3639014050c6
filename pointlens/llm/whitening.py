"""Embedding whitening by matrix-free block Lanczos.

Vectors become integers, x = floor(scale * c) + shift, so that n, the sums S and n * x - S are exact. The covariance V is never formed: one
pass of Spark over the rows multiplies it with a block of directions, as sum over rows of z (z' Q) with z = (n * x - S) / n, so a task needs its
rows and d x b numbers, and the driver gets the sum of the tasks' d x b numbers. The driver keeps an orthonormal basis Q of
at most MOST_BASIS directions (or all d of them) and its image V Q:

    reorthogonalisation  a new block is made orthogonal to the whole basis, twice
    breakdown            a direction of which nothing is left then is replaced by a seeded random one, orthogonal to all
    convergence          the residuals |V u - e u| of all wanted pairs are at most TOLERANCE * e_1, or at most STALLED * e_1 and no longer halved in
                         three passes, as sums over very many rows have rounding of their own
    restart              a full basis is cut down to its best Ritz vectors, and the last residual block goes on from there
    proof                converged pairs are kept only after a further random block from the complement has converged to the same ones, as a
                         Krylov space can miss further copies of an eigenvalue; a basis that spans all d directions needs no proof

Every row's deviation is the sum over dimensions of (n * x - S)^2; all deviations add up to n^3 times the trace of V, which gives explained shares.

Defined cases: rows are dropped if the vector is null or empty or a component is null or not finite; a null id stays as it is;
vectors of different lengths are fitted apart, each with its own n; repeated rows count and are returned each; components without
variance (e at most NO_VARIANCE * e_1) have no whitened value and are not returned, so a single row, equal rows and an empty table give an
empty result; other columns are ignored. A deviation that a long cannot hold raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import checkpoint

MOST_BASIS = 256
BLOCK = 16  # directions of a pass
BLOCK_ROWS = 1 << 12
TOLERANCE = 1e-13
STALLED = 1e-10
NO_VARIANCE = 1e-12
MOST_PASSES = 2000
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows_of(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """x of each stored block, and the ids."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield np.frombuffer(batch.column(0)[r].as_py(), "<i8").reshape(-1, dim), batch.column(1)[r].values


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long") + F.lit(shift))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite).select(F.col(id_col).cast("long").alias("_id"), whole.alias("_x"))


def _packed(rows: DataFrame) -> DataFrame:
    """_dim, and blocks of rows of that length: matrix (_x) and ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                lengths = part.column("_x").value_lengths().to_numpy()
                for dim in np.unique(lengths):
                    mine = part.filter(pa.array(lengths == dim))
                    data = mine.column("_x").flatten().to_numpy().astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([data], pa.binary()), pa.array([mine.column("_id").to_pylist()], pa.list_(pa.int64()))], ["_dim", "_x", "_ids"])

    return rows.mapInArrow(pack, "_dim int, _x binary, _ids array<long>")


class Fit:
    """Rows of one length with their n and S; sums over all rows come from passes of Spark."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks, dim
        self.n, self.sums = 0, np.zeros(dim, np.int64)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, top = 0, np.zeros(dim, np.int64), 0
            for x, _ in _rows_of(batches, dim):
                n, total, top = n + len(x), total + x.sum(axis=0), max(top, int(np.abs(x).max(initial=0)))
                if top * n >= 1 << 62:
                    raise OverflowError("sums of components exceed a long")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total), pa.array([top] * dim, pa.int64())], ["d", "n", "s", "top"])

        found = blocks.mapInArrow(sums, "d int, n long, s long, top long").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("top")).collect()  # a row for each dimension
        for r in found:
            self.n, self.sums[r.d] = r.n, r.s
        if found and self.n * found[0].top >= 1 << 62:
            raise OverflowError("n * x exceeds a long")

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """The function x -> n * x - S, exact, for tasks."""
        n, sums = self.n, self.sums
        return lambda x: n * x - sums

    def total(self, part: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
        """The sum over all blocks of part(n * x - S), a matrix of rows x columns. A task sends one matrix, and Spark adds them up by row."""
        dim, centre = self.dim, self.centre()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((rows, columns))
            for x, _ in _rows_of(batches, dim):
                out += part(centre(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in out.T]], ["_r", *[f"_{c}" for c in range(columns)]])

        schema = ", ".join(["_r int", *[f"_{c} double" for c in range(columns)]])
        summed = self.blocks.mapInArrow(add, schema).groupBy("_r").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in range(columns)])
        out = np.zeros((rows, columns))
        for r in summed.collect():  # a row for each dimension at most
            out[r[0]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        n = self.n
        shared = self.blocks.sparkSession.sparkContext.broadcast(q)

        def part(z: np.ndarray) -> np.ndarray:
            z = z / n
            return z.T @ (z @ shared.value)

        return self.total(part, *q.shape) / n

    def deviations(self) -> int:
        """The sum of all rows' deviations, exact."""
        dim, centre = self.dim, self.centre()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, _ in _rows_of(batches, dim):
                yield pa.RecordBatch.from_arrays([pa.array(deviation(centre(x)))], ["v"])

        return int(self.blocks.mapInArrow(add, "v long").agg(F.sum(F.col("v").cast("decimal(38,0)"))).first()[0] or 0)


def deviation(z: np.ndarray) -> np.ndarray:
    """Sum of squares of each row of integers, exact."""
    if int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] >= 1 << 63:
        raise OverflowError("a deviation could exceed a long")
    return (z * z).sum(axis=1)


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, floor: float) -> np.ndarray:
    """Orthonormal columns that are orthogonal to the basis; those of which at most `floor` is left are replaced by random ones."""
    out = basis
    for column in block.T[: basis.shape[0] - basis.shape[1]]:
        while True:
            before = column
            for _ in range(2):
                column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size > floor and size > 1e-10 * np.linalg.norm(before):
                break
            column, floor = rng.normal(size=len(column)), 0.0  # breakdown
        column = column / size
        column -= out @ (out.T @ column)
        out = np.concatenate([out, (column / np.linalg.norm(column))[:, None]], axis=1)
    return out[:, basis.shape[1] :]


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, most_basis: int = MOST_BASIS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric operator, falling, and unit eigenvectors in columns."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    most_basis = min(dim, max(most_basis, 2 * (wanted + block)))
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh = _orthogonal(rng.normal(size=(dim, min(block, dim))), basis, rng, 0.0)
    proven, since, course = None, 0, [np.inf] * 3
    for _ in range(MOST_PASSES):
        basis, image, since = np.concatenate([basis, fresh], axis=1), np.concatenate([image, times(fresh)], axis=1), since + 1
        projected = basis.T @ image
        values, inner = np.linalg.eigh((projected + projected.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        vectors = basis @ inner[:, :wanted]
        top = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == dim:
            break
        residual = np.linalg.norm(image @ inner[:, :wanted] - vectors * values[:wanted], axis=0).max()
        course.append(residual)
        limit = STALLED * top if residual > course[-4] / 2 else TOLERANCE * top
        left = image[:, -fresh.shape[1] :]
        if basis.shape[1] >= wanted and residual <= limit:
            if proven is not None and since > 2 and np.abs(values[:wanted] - proven).max() <= 1e-9 * top:
                break
            if proven is None or since > 2:
                proven, since = values[:wanted].copy(), 0
                left = rng.normal(size=left.shape)  # a random block of the complement has to find nothing new
        if basis.shape[1] + block > most_basis < dim:
            keep = min(wanted + block, basis.shape[1])
            left = left - basis @ (basis.T @ left)
            basis, image = basis @ inner[:, :keep], image @ inner[:, :keep]
            basis, r = np.linalg.qr(basis)  # rounding only
            image = np.linalg.solve(r.T, image.T).T
        fresh = _orthogonal(left, basis, rng, 1e-12 * top)
    else:
        raise RuntimeError("the components did not converge")
    vectors, _ = np.linalg.qr(vectors)
    return values[:wanted], vectors * np.sign((vectors * (basis @ inner[:, :wanted])).sum(axis=0))


def _whiten_length(blocks: DataFrame, dim: int, components: int) -> DataFrame:
    spark = blocks.sparkSession
    fit = Fit(blocks, dim)
    total = fit.deviations()
    if not total:
        return spark.createDataFrame([], RESULT)
    n, trace = fit.n, total / fit.n**3
    values, vectors = block_lanczos(fit.times, dim, components)
    used = values > NO_VARIANCE * values[0]
    values, vectors = values[used], vectors[:, used]
    k = len(values)
    weights = vectors / np.sqrt(values)
    shared = spark.sparkContext.broadcast(weights)

    def moments(z: np.ndarray) -> np.ndarray:
        y = (z / n) @ shared.value
        return np.concatenate([y.T @ y, y.sum(axis=0)[None]])

    found = fit.total(moments, k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained, centre = values / trace, fit.centre()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _rows_of(batches, dim):
            z = centre(x)
            y = (z / n) @ shared.value
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviation(z), k)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return blocks.mapInArrow(out, RESULT)


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every row that takes part."""
    blocks = checkpoint(_packed(_integers(vectors, id_col, vector_col, scale, shift)))
    lengths = sorted(r[0] for r in blocks.select("_dim").distinct().collect())  # few
    parts = [_whiten_length(blocks.where(F.col("_dim") == d).select("_x", "_ids"), d, components) for d in lengths]
    return reduce(DataFrame.unionByName, parts, vectors.sparkSession.createDataFrame([], RESULT))
