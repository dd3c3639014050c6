"""Distance baselines: how close the points of a source scope's sample are on screen, carried over to other scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.functions.columns import equivalent_percentage, n_keep
from pointlens.operators.fps import fps_order
from pointlens.operators.pixels import COUNTRY_BOUNDS, Viewport, fit_pixels, marker_spacing, min_distance, thin
from pointlens.operators.sampling import fps_prefixes
from pointlens.operators.scope import Scope, in_scope
from pointlens.operators.topology import METRICS, diagrams, with_distances
from pointlens.sources.points import with_coordinates


@dataclass(frozen=True)
class Baseline:
    key: str
    label: str
    source: Scope
    percentage: int


_SOURCE_COUNTY = Scope("county", "NC", "Mecklenburg")
BASELINES = {
    b.key: b
    for b in (
        Baseline("country_1pct_distance", "Country 1% spacing", Scope(), 1),
        *(Baseline(f"county_{p}pct_distance", f"County {p}% spacing", _SOURCE_COUNTY, p) for p in (5, 10, 20)),
    )
}
DEFAULT = "country_1pct_distance"


def baseline(key: object) -> Baseline:
    """The named baseline, the default one for an unknown name."""
    return BASELINES.get(str(key), BASELINES[DEFAULT])


def in_pixels(points: DataFrame, zoom: str) -> DataFrame:
    return fit_pixels(points, Viewport.of(zoom), bounds=COUNTRY_BOUNDS if zoom == "country" else None)


def _prefix(points: DataFrame, percentage: int) -> DataFrame:
    placed = with_coordinates(points)
    n = placed.agg(F.count("*").alias("n"))
    stepped = placed.join(F.broadcast(n)).withColumn("_steps", n_keep("n", F.lit(percentage)))  # one row
    return fps_prefixes(placed, fps_order(stepped, steps_col="_steps"), [percentage])


def source_spacing(points: DataFrame, chosen: Baseline) -> float:
    """Least distance in pixels between two points of the source scope's sample."""
    source = in_scope(points, chosen.source)
    projected = in_pixels(source, chosen.source.zoom)
    kept = _prefix(source, chosen.percentage).select("row_pos")
    return min_distance(projected.join(kept, "row_pos", "left_semi"))


def applied_spacing(spacing: float, zoom: str) -> float:
    return max(spacing, marker_spacing(zoom))


def baseline_sample(points: DataFrame, scope: Scope, chosen: Baseline, spacing: float | None = None) -> DataFrame:
    """Points of a scope at the baseline: for the source scope its sample itself, else the farthest-point order thinned to the applied spacing."""
    own = in_scope(points, scope)
    if scope == chosen.source:
        return _prefix(own, chosen.percentage).drop("n_keep", "percentage")
    spacing = source_spacing(points, chosen) if spacing is None else spacing
    ranked = in_pixels(own, scope.zoom).join(fps_order(own), "row_pos")
    kept = thin(ranked, applied_spacing(spacing, scope.zoom), order="fps_rank")
    return ranked.join(kept, "fps_rank", "left_semi").drop("px", "py")


def baseline_entry(points: DataFrame, scope: Scope, chosen: Baseline, spacing: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row: the baseline's figures on a scope, with the four distances between its sample and all points.

    known: n_points and the distances, if they are kept already (a curve's row).
    """
    spacing = source_spacing(points, chosen) if spacing is None else spacing
    own = with_coordinates(in_scope(points, scope)).withColumn("_all", F.lit(0))
    if known is not None:
        measured = known.select("n_points", *METRICS).join(F.broadcast(own.agg(F.count("*").cast("int").alias("n_source_points"))))  # one row each
    else:
        sample = baseline_sample(points, scope, chosen, spacing).withColumn("_all", F.lit(0))
        whole = diagrams(own, "_all").select("_all", F.col("n_points").alias("n_source_points"), F.col("h0").alias("ref_h0"), F.col("h1").alias("ref_h1"))
        measured = with_distances(diagrams(sample, "_all").join(whole, "_all"))
    return measured.select(
        F.lit(chosen.key).alias("baseline_key"),
        F.lit(chosen.label).alias("baseline_label"),
        *[F.lit(v).alias(c) for c, v in (("zoom", scope.zoom), ("state", scope.state), ("county", scope.county))],
        F.lit(float(spacing)).alias("baseline_source_min_pixel_distance"),
        F.lit(float(applied_spacing(spacing, scope.zoom))).alias("applied_min_pixel_distance"),
        "n_source_points",
        "n_points",
        equivalent_percentage("n_points", "n_source_points").alias("equivalent_percentage"),
        *METRICS,
    )
