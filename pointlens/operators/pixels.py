"""Points in the pixels of a map view: projection, spacing, and greedy selection by distance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.functions.columns import mercator_x, mercator_y
from pointlens.sources.points import with_coordinates
from pointlens.sources.shared import checkpoint, shared_dir, sized, spread

#: Marker radius and stroke width in pixels.
MARKERS = {"country": (3.2, 0.6), "state": (4.2, 0.6), "county": (4.2, 0.6)}
#: What a country view shows, in degrees: west, south, east, north.
COUNTRY_BOUNDS = (-125.0, 24.0, -66.0, 49.8)
TASK_ROWS = 200_000
TILE = 64  # distances
TILE_ROWS = 100_000  # points of a tile that a task decides on


@dataclass(frozen=True)
class Viewport:
    """Width, height and padding (top, right, bottom, left) in pixels."""

    width: int = 1248
    height: int = 896
    padding: tuple[int, int, int, int] = (28, 28, 28, 28)

    @classmethod
    def of(cls, zoom: str) -> Viewport:
        return cls(padding=(28 if zoom == "country" else 34 if zoom == "county" else 32,) * 4)

    @classmethod
    def parse(cls, width: object, height: object, padding: object = None, default: Viewport | None = None) -> Viewport | None:
        """A view from request values: rounded, at least one pixel wide and high; None if a side is no positive number."""
        default = default or cls()
        try:
            w, h = float(width), float(height)  # type: ignore[arg-type]
            pads = [float(x) for x in padding.split(",")] if isinstance(padding, str) else [*map(float, padding or ())]  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return None
        if not (math.isfinite(w) and math.isfinite(h) and w > 0 and h > 0):
            return None
        pad = tuple(max(0, round(x)) for x in pads) if len(pads) == 4 else default.padding
        return cls(max(1, round(w)), max(1, round(h)), pad)  # type: ignore[arg-type]

    @property
    def profile(self) -> str:
        return f"w{self.width}_h{self.height}_p" + "-".join(map(str, self.padding))


def marker_spacing(zoom: str) -> float:
    """Distance of two markers' centres from which they do not overlap."""
    radius, stroke = MARKERS[zoom]
    return 2 * (radius + stroke / 2)


def fit_pixels(points: DataFrame, view: Viewport, *by: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Adds px, py: Mercator, scaled alike on both axes so that the extent of each scope (or the given bounds) fits the view, centred.

    An axis without extent is widened by half a degree on either side.
    """
    placed = with_coordinates(points)
    if bounds is None:
        box = placed.groupBy(*by).agg(F.min("lng").alias("_w"), F.min("lat").alias("_s"), F.max("lng").alias("_e"), F.max("lat").alias("_n"))
    else:
        box = placed.sparkSession.range(1).select(*[F.lit(float(v)).alias(c) for v, c in zip(bounds, ("_w", "_s", "_e", "_n"))])
    for low, high in (("_w", "_e"), ("_s", "_n")):
        thin = F.col(high) - F.col(low) < 1e-12
        box = box.withColumns({low: F.when(thin, F.col(low) - 0.5).otherwise(F.col(low)), high: F.when(thin, F.col(high) + 0.5).otherwise(F.col(high))})
    top, right, bottom, left = view.padding
    wide, high = max(1, view.width - left - right), max(1, view.height - top - bottom)
    box = box.withColumns({"_x0": mercator_x("_w"), "_x1": mercator_x("_e"), "_y0": mercator_y("_s"), "_y1": mercator_y("_n")})
    scale = F.least(F.lit(float(wide)) / (F.col("_x1") - F.col("_x0")), F.lit(float(high)) / (F.col("_y1") - F.col("_y0")))
    box = box.withColumn("_scale", scale).select(*(by if bounds is None else ()), "_x0", "_x1", "_y0", "_y1", "_scale")
    joined = placed.join(sized(box), list(by)) if by and bounds is None else placed.join(F.broadcast(box))  # one row
    px = left + (wide - (F.col("_x1") - F.col("_x0")) * F.col("_scale")) / 2 + (mercator_x("lng") - F.col("_x0")) * F.col("_scale")
    py = top + (high - (F.col("_y1") - F.col("_y0")) * F.col("_scale")) / 2 + (F.col("_y1") - mercator_y("lat")) * F.col("_scale")
    return joined.withColumns({"px": px, "py": py}).drop("_x0", "_x1", "_y0", "_y1", "_scale")


def min_distance(points: DataFrame, x: str = "px", y: str = "py") -> float:
    """Least distance of any two points, 0 for fewer than two.

    Points are compared inside 3 by 3 cells only. The cells shrink while one of them holds so many points that a closer pair must
    be in it, and grow if no pair is found, so neither pairs nor rounds get out of hand.
    """
    rows = checkpoint(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 2 or not rows.groupBy("x", "y").count().where("count > 1").isEmpty():
        return 0.0
    side = max(math.sqrt((x1 - x0) * (y1 - y0) / n), max(x1 - x0, y1 - y0) / n)
    while True:
        cell = [F.floor((F.col(c) - low) / side).cast("long").alias(f"c{c}") for c, low in (("x", x0), ("y", y0))]
        celled = rows.select("x", "y", *cell)
        crowd = celled.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if crowd > 64:
            side /= 4  # 65 points in a cell: two of them are closer than a quarter of its side
            continue
        around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        near = celled.select(F.col("x").alias("ox"), F.col("y").alias("oy"), around.alias("at")).select("ox", "oy", "at.cx", "at.cy")
        ahead = (F.col("x") < F.col("ox")) | ((F.col("x") == F.col("ox")) & (F.col("y") < F.col("oy")))
        d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
        least = celled.join(near, ["cx", "cy"]).where(ahead).agg(F.min(d2)).first()[0]
        if least is not None and least <= side * side:
            return math.sqrt(least)
        side *= 2


def thin_in_memory(x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
    """Places of the points that are kept, in order: a point goes if one kept before is nearer than the distance."""
    if distance <= 0:
        return np.arange(len(x))
    bound = distance * distance
    bound -= max(1e-15, bound * 1e-12)
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    kept = []
    columns, rows = np.floor(x / distance).astype(np.int64).tolist(), np.floor(y / distance).astype(np.int64).tolist()
    for i, (a, b, c, r) in enumerate(zip(x.tolist(), y.tolist(), columns, rows)):
        near = (p for dc in (-1, 0, 1) for dr in (-1, 0, 1) for p in cells.get((c + dc, r + dr), ()))
        if all((a - p) ** 2 + (b - q) ** 2 >= bound for p, q in near):
            kept.append(i)
            cells.setdefault((c, r), []).append((a, b))
    return np.array(kept, np.int64)


def thin_region(x: np.ndarray, y: np.ndarray, distance: float, box: tuple[float, float, float, float]) -> np.ndarray:
    """For the points of a region, in order: 1 kept, 0 dropped, -1 open, as points outside (or open ones) could decide. box: west, east, south, north."""
    bound = distance * distance
    bound -= max(1e-15, bound * 1e-12)
    cells: dict[tuple[int, int], tuple[list[tuple[float, float]], list[tuple[float, float]]]] = {}
    out = np.empty(len(x), np.int8)
    columns, rows = np.floor(x / distance).astype(np.int64).tolist(), np.floor(y / distance).astype(np.int64).tolist()
    seen = ((x - box[0] > distance) & (box[1] - x > distance) & (y - box[2] > distance) & (box[3] - y > distance)).tolist()
    for i, (a, b, c, r, whole) in enumerate(zip(x.tolist(), y.tolist(), columns, rows, seen)):
        near = [cells[k] for k in ((c + dc, r + dr) for dc in (-1, 0, 1) for dr in (-1, 0, 1)) if k in cells]
        if any((a - p) ** 2 + (b - q) ** 2 < bound for kept, _ in near for p, q in kept):
            out[i] = 0
            continue
        sure = whole and not any((a - p) ** 2 + (b - q) ** 2 < bound for _, open_ in near for p, q in open_)
        out[i] = 1 if sure else -1
        cells.setdefault((c, r), ([], []))[0 if sure else 1].append((a, b))
    return out


def _thinner(side: float, shift: float, halo: float, distance: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def decide(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o", kind="stable")
        west, south = (k * side + shift - halo for k in key)
        state = thin_region(f["x"].to_numpy(), f["y"].to_numpy(), distance, (west, west + side + 2 * halo, south, south + side + 2 * halo))
        return f.assign(kept=state == 1)[state >= 0][["o", "x", "y", "kept"]]

    return decide


def thin_distributed(points: DataFrame, distance: float, order: str = "row_pos", x: str = "px", y: str = "py", tile: int = TILE, tile_rows: int = TILE_ROWS, rounds: list | None = None) -> DataFrame:
    """`order` of the kept points of one scope, with the result of thin_in_memory() but by all tasks together.

    Tiles some distances wide, with two distances around them, decide in order until a point depends on one that the tile cannot see or has left open.
    What is kept drops its neighbours everywhere, and further rounds, whose tiles lie elsewhere, go on: rounds follow chains of
    tiles, not of points. Where tiles would hold too many points, a round decides cell by cell instead: of 3 by 3 cells the first open point is kept.
    rounds: gets an entry for each round.
    """
    rows = points.select(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if distance <= 0:
        return rows.select(F.col("o").alias(order))
    spark, path, turn = points.sparkSession, shared_dir(points.sparkSession), 0
    bound = distance * distance - max(1e-15, distance * distance * 1e-12)
    kind = rows.schema["o"].dataType.simpleString()
    left = checkpoint(rows)
    rows.limit(0).select("o").write.parquet(path)
    cell = lambda c, side=distance, shift=0.0: F.floor((F.col(c) - shift) / side)
    around = lambda: F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while not left.isEmpty():
        side = distance * tile
        while side > 4 * distance and left.groupBy(cell("x", side), cell("y", side)).count().agg(F.max("count")).first()[0] > tile_rows:
            side /= 2
        shift, halo = side / 2 * (turn % 2), 2 * distance
        if side > 4 * distance:
            reach = lambda c: F.explode(F.sequence(cell(c, side, shift + halo * (1 + 1e-9)), cell(c, side, shift - halo * (1 + 1e-9))))
            regions = left.withColumn("cx", reach("x")).withColumn("cy", reach("y"))
            schema = f"o {kind}, x double, y double, kept boolean"
            decide = _thinner(side, shift, halo, distance)
            decided = checkpoint(spread(regions, "cx", "cy").groupBy("cx", "cy").applyInPandas(decide, schema).distinct())  # as one task or another sees them
        else:
            celled = left.withColumns({"cx": cell("x"), "cy": cell("y")})
            first = celled.groupBy("cx", "cy").agg(F.min_by(F.struct("o", "x", "y"), "o").alias("p")).select("cx", "cy", "p.*")
            lowest = first.select(around().alias("at"), "o").groupBy("at.cx", "at.cy").agg(F.min("o").alias("least"))
            decided = checkpoint(first.join(lowest, ["cx", "cy"]).where("o = least").select("o", "x", "y", F.lit(True).alias("kept")))
        winners = decided.where("kept")
        winners.select("o").write.mode("append").parquet(path)
        shade = winners.select(F.col("x").alias("kx"), F.col("y").alias("ky"), around().alias("at")).select("kx", "ky", "at.cx", "at.cy")
        near = (F.col("x") - F.col("kx")) ** 2 + (F.col("y") - F.col("ky")) ** 2 < bound
        gone = left.withColumns({"cx": cell("x"), "cy": cell("y")}).join(shade, ["cx", "cy"]).where(near).select("o")
        left = checkpoint(left.join(decided.select("o").unionByName(gone), "o", "left_anti"))
        turn += 1
        if rounds is not None:
            rounds.append(side)
    return spark.read.schema(f"o {kind}").parquet(path).select(F.col("o").alias(order))


def thin(points: DataFrame, distance: float, *by: str, order: str = "row_pos", x: str = "px", y: str = "py", task_rows: int = TASK_ROWS) -> DataFrame:
    """by..., `order` of the kept points of each scope. Scopes of over task_rows points are thinned by all tasks together."""
    scopes = list(by) or ["_all"]
    rows = points if by else points.withColumn("_all", F.lit(0))
    rows = rows.select(*scopes, order, x, y)
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.iloc[thin_in_memory(group[x].to_numpy(float), group[y].to_numpy(float), distance)][[*scopes, order]]

    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in [*scopes, order])
    large = rows.groupBy(*scopes).count().where(F.col("count") > task_rows).collect()  # as many as scopes of such a size exist
    small, out = rows, []
    for row in large:
        same = F.lit(True)
        for c in scopes:
            same = same & F.col(c).eqNullSafe(F.lit(row[c]))
        small = small.where(~same)
        own = thin_distributed(rows.where(same), distance, order, x, y)
        out.append(own.select(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in scopes], order))
    kept = spread(small, *scopes).groupBy(*scopes).applyInPandas(keep, schema)
    for own in out:
        kept = kept.unionByName(own)
    return kept.select(*by, order)


def pixel_sample(points: DataFrame, zoom: str, view: Viewport | None = None, *by: str) -> DataFrame:
    """Points whose markers do not overlap those of points before them, by row_pos: the points with px, py."""
    placed = fit_pixels(points, view or Viewport.of(zoom), *by, bounds=COUNTRY_BOUNDS if zoom == "country" else None)
    kept = thin(placed, marker_spacing(zoom), *by)
    return placed.join(kept, [*by, "row_pos"], "left_semi")
