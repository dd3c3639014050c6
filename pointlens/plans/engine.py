"""The facade: samples and analyses of scopes by method, labels, status, building and export."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.functions.columns import normalized, route_key, scope_label, threshold_text
from pointlens.operators import curves, density, geometry, statistics
from pointlens.operators.fps import fps_order
from pointlens.operators.pixels import Viewport, pixel_sample
from pointlens.operators.sampling import PERCENTAGES, configured, keyed_sample, random_sample
from pointlens.operators.scope import Scope, all_scopes, by_zoom, counts, county_labels, coverage, in_scope
from pointlens.operators.topology import METRICS, diagrams, with_distances
from pointlens.plans.baselines import BASELINES, baseline, baseline_entry, baseline_sample
from pointlens.sources import store
from pointlens.sources.boundaries import resolve
from pointlens.sources.points import frame_signature, with_coordinates
from pointlens.sources.shared import checkpoint, children, exists, remove

STAGE = 16  # percentages that are staged together
METHODS = ("all", "pixel", "random", "fps_threshold")
PROPERTIES = ("statistical", "density", "topological")
CURVE = ", ".join(
    ["percentage int", "n_points int", "h0 array<struct<birth: double, death: double>>", "h1 array<struct<birth: double, death: double>>"]
    + [f"{m} double" for m in METRICS]
    + [f"{c} string" for c in store.SCOPE]
)
ORDER = ", ".join(["row_pos long", "fps_rank long"] + [f"{c} string" for c in store.SCOPE])
MANIFEST = "zoom string, state string, county string, n_rows long, first_id string, last_id string, content_hash decimal(38,0), written_at timestamp"


class MissingCurve(LookupError):
    """The scope's error curve has to be built first."""


@dataclass
class Engine:
    """points: id, lat, lng, state, county, row_pos (and more). path: folder of curves and manifest, on storage that all executors reach."""

    points: DataFrame
    path: str
    default_threshold: float = 0.5
    keyed_draws: bool = False  # random samples by digests, which no task draws, instead of NumPy's generator
    providers: tuple = ()  # functions from a region id to ring points, asked in order
    _entries: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.points.sparkSession

    # curves ------------------------------------------------------------------------------------------------------------

    def _curve(self, scope: Scope) -> DataFrame:
        found = store.read_or_empty(self.spark, f"{self.path}/curves", CURVE)
        rows = store.of_scope(found, scope.zoom, scope.state, scope.county).drop(*store.SCOPE)
        return curves.available(rows, rows.limit(0), scope.zoom)

    def _signature(self, scope: Scope) -> DataFrame:
        own = in_scope(self.points, scope).withColumns({"zoom": F.lit(scope.zoom), "state": F.lit(scope.state), "county": F.lit(scope.county)})
        return frame_signature(own, *store.SCOPE)

    def _digest(self, scope: Scope) -> str:
        """A folder name that changes with a scope's points."""
        found = self._signature(scope).first()
        return sha256(repr((scope, found and tuple(found))).encode()).hexdigest()[:32]

    def _is_valid(self, scope: Scope, table: str) -> bool:
        """Whether a kept table of a scope is of its present points."""
        kept = store.latest(store.read_or_empty(self.spark, f"{self.path}/{table}_manifest", MANIFEST), *store.SCOPE)
        return not store.valid(kept, self._signature(scope), *store.SCOPE).isEmpty()

    def order(self, scope: Scope) -> DataFrame:
        """row_pos, fps_rank of all points of a scope. It is computed once and kept while the points stay the same; a build that was stopped goes on after its last round."""
        own = with_coordinates(in_scope(self.points, scope))
        if not self._is_valid(scope, "orders"):
            names = {c: F.lit(v) for c, v in zip(store.SCOPE, (scope.zoom, scope.state, scope.county))}
            work = f"{self.path}/orders_work/{self._digest(scope)}"
            store.write_curve(fps_order(own, path=work).withColumns(names), f"{self.path}/orders")
            store.append(self._signature(scope), f"{self.path}/orders_manifest")
            remove(self.spark, work)
        found = store.read_or_empty(self.spark, f"{self.path}/orders", ORDER)
        return store.of_scope(found, scope.zoom, scope.state, scope.county).select("row_pos", "fps_rank")

    def build(self, scope: Scope, most: int = 100) -> None:
        """Compute and keep a scope's curve up to a percentage: only the percentages that are not there yet, all if its points have changed.

        Finished percentages are staged, so that a build that was stopped goes on with the others, and published together.
        """
        wanted = set(configured(scope.zoom, most))
        kept = self._curve(scope) if self._is_valid(scope, "curves") else None
        missing = sorted(wanted - ({r.percentage for r in kept.select("percentage").collect()} if kept is not None else set()))  # a hundred at most
        if not missing:
            return
        names = {c: F.lit(v) for c, v in zip(store.SCOPE, (scope.zoom, scope.state, scope.county))}
        stage = f"{self.path}/curves_staging/{self._digest(scope)}"
        for batch in self._unstaged(stage, missing):
            own = in_scope(self.points, scope).withColumns(names)
            if not exists(self.spark, f"{stage}/whole/_SUCCESS"):
                curves.whole_diagrams(own, *store.SCOPE).write.mode("overwrite").parquet(f"{stage}/whole")
            whole = self.spark.read.parquet(f"{stage}/whole")
            rows = curves.error_curve(own, scope.zoom, *store.SCOPE, percentages=batch, order=self.order(scope).withColumns(names), whole=whole)
            rows.write.mode("overwrite").parquet(f"{stage}/rows-{batch[0]}-{batch[-1]}")
        fresh = self.spark.read.schema(CURVE).parquet(*self._staged(stage))
        if kept is not None:
            fresh = checkpoint(curves.overlay(kept.withColumns(names), fresh, *store.SCOPE))  # its old folder is replaced
        store.write_curve(fresh, f"{self.path}/curves")  # readers see the old curve or the new one
        store.append(self._signature(scope), f"{self.path}/curves_manifest")
        remove(self.spark, stage)

    def _staged(self, stage: str) -> list[str]:
        """Folders of a build that hold finished percentages."""
        return [f"{stage}/{name}" for name in children(self.spark, stage) if name.startswith("rows-") and exists(self.spark, f"{stage}/{name}/_SUCCESS")]

    def _unstaged(self, stage: str, wanted: list[int]) -> Iterator[list[int]]:
        """The percentages that a build that was stopped has not finished, a few at a time."""
        found = self._staged(stage)
        done = {r.percentage for r in self.spark.read.schema(CURVE).parquet(*found).select("percentage").collect()} if found else set()  # a hundred at most
        left = [p for p in wanted if p not in done]
        return (left[i : i + STAGE] for i in range(0, len(left), STAGE))

    def staged(self, scope: Scope) -> int:
        """Percentages of a scope that a build under way has finished."""
        found = self._staged(f"{self.path}/curves_staging/{self._digest(scope)}")
        return self.spark.read.schema(CURVE).parquet(*found).count() if found else 0

    def ensure(self, scope: Scope, most: int = 100) -> DataFrame:
        """The scope's curve up to a percentage, built as far as it is missing."""
        self.build(scope, most)
        return self._curve(scope).where(F.col("percentage") <= most)

    def changes(self, table: str = "curves") -> DataFrame:
        """zoom, state, county, change of every scope with points or a kept table: new (nothing is kept), same, changed, or gone (no points are left).

        All scopes' signatures come from one reading of the points and are compared with the latest ones of the manifest.
        """
        kept = store.latest(store.read_or_empty(self.spark, f"{self.path}/{table}_manifest", MANIFEST), *store.SCOPE)
        figures = ("n_rows", "first_id", "last_id", "content_hash")
        before = kept.select(*store.SCOPE, F.struct(*figures).alias("_before"))
        now = frame_signature(by_zoom(self.points), *store.SCOPE).select(*store.SCOPE, F.struct(*figures).alias("_now"))
        change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_before") == F.col("_now"), "same").otherwise("changed")
        return now.join(before, list(store.SCOPE), "full").select(*store.SCOPE, change.alias("change"))

    def refresh(self) -> list[Scope]:
        """Build the kept curves of changed scopes again, as far as they went, and no others."""
        stale = [Scope(r.zoom, r.state, r.county) for r in self.changes().where("change = 'changed'").orderBy(*store.SCOPE).collect()]  # of those that were built
        for scope in stale:
            self.build(scope, self._curve(scope).agg(F.max("percentage")).first()[0] or 100)
        return stale

    def status(self, scope: Scope) -> DataFrame:
        """One row: what is there of a scope's curve."""
        own = counts(in_scope(self.points, scope)).select("exact_count")
        curve = self._curve(scope).agg(F.count("*").alias("row_count"), F.array_sort(F.collect_set("percentage")).alias("percentages"))
        expected = PERCENTAGES[scope.zoom]
        names = [F.lit(v).alias(c) for c, v in zip(store.SCOPE, (scope.zoom, scope.state, scope.county))]
        return own.join(F.broadcast(curve)).select(
            *names,
            scope_label(*[F.lit(v) for v in (scope.zoom, scope.state, scope.county)]).alias("scope_label"),
            (F.col("row_count") > 0).alias("available"),
            (F.size(F.array_except(F.array(*[F.lit(p) for p in expected]), "percentages")) == 0).alias("complete"),
            "exact_count",
            "row_count",
            F.lit(len(expected)).alias("expected_row_count"),
            "percentages",
        )

    # boundaries --------------------------------------------------------------------------------------------------------

    def boundary(self, scope: Scope) -> DataFrame:
        """Ring points of a county or state from the providers, else the padded hull of its points."""
        region = f"{scope.state}::{scope.county}" if scope.zoom == "county" else scope.state
        return resolve(self.providers, region, in_scope(self.points, scope))

    def _points(self, scope: Scope) -> DataFrame:
        """A scope's points; those of a county only inside its boundary, if a provider knows it."""
        own = in_scope(self.points, scope)
        if scope.zoom != "county" or not self.providers:
            return own
        rings = self.boundary(scope)
        return geometry.inside(own, geometry.edges_of_rings(rings), f"{scope.state}::{scope.county}")

    # samples -----------------------------------------------------------------------------------------------------------

    def selection(self, scope: Scope, threshold: float | None = None, baseline_key: object = None, metric: str = "bottleneck_h0") -> DataFrame:
        """One row: the percentage that a threshold chooses, its metrics and their normalised values. baseline_key: a percentage or a distance baseline's name."""
        threshold = self.default_threshold if threshold is None else threshold
        curve = self._curve(scope)
        if curve.isEmpty():
            raise MissingCurve(f"no curve of {scope}")
        if str(baseline_key or "1").isdigit():
            base = curves.baseline_row(curve, int(str(baseline_key or "1")), scope.zoom)
            return curves.select_by_threshold(curves.normalize(curve, base), threshold, metric)
        base = self.entry(scope, baseline_key).withColumn("percentage", F.lit(None).cast("int"))
        return curves.select_by_distance_baseline(curves.normalize(curve, base), threshold, metric)

    def entry(self, scope: Scope, baseline_key: object) -> DataFrame:
        chosen = baseline(baseline_key)
        if (scope, chosen.key) not in self._entries:
            own = self._curve(scope).where(F.col("percentage") == chosen.percentage) if scope == chosen.source and self._is_valid(scope, "curves") else None
            known = None if own is None or own.isEmpty() else own  # the source's own sample is a row of its curve
            self._entries[scope, chosen.key] = baseline_entry(self.points, scope, chosen, known=known)
        return self._entries[scope, chosen.key]

    def sample(self, scope: Scope, method: str = "pixel", retain: int = 50, threshold: float | None = None, baseline_key: object = None, view: Viewport | None = None) -> DataFrame:
        """The points that a method shows of a scope."""
        own = with_coordinates(self._points(scope))
        if method == "all":
            return own
        if method == "pixel":
            return pixel_sample(own, scope.zoom, view).drop("px", "py")
        if method == "random":
            by = {"country": (), "state": ("state",), "county": ("state", "county")}[scope.zoom]
            return (keyed_sample if self.keyed_draws else random_sample)(own, scope.zoom, retain, *by).drop("draw_rank")
        if method != "fps_threshold":
            raise ValueError(f"unknown method {method!r}")
        chosen = self.selection(scope, threshold, baseline_key).select("percentage", "n_points").first()
        if chosen is None:
            return own
        if not str(baseline_key or "1").isdigit():
            # the baseline's own sample, if its error against itself is within the threshold and it is no larger
            base = self.entry(scope, baseline_key).select("n_points", "bottleneck_h0").first()
            itself = 0.0 if base.bottleneck_h0 <= 0 else 1.0
            if itself <= max(0.0, self.default_threshold if threshold is None else threshold) and base.n_points <= chosen.n_points:
                return baseline_sample(self.points, scope, baseline(baseline_key)).drop("fps_rank")
        if scope.zoom == "county" and self.providers:  # only points inside the boundary are ordered
            stepped = own.withColumn("_steps", F.lit(chosen.n_points))
            ranks = fps_order(stepped, steps_col="_steps")
        else:
            ranks = self.order(scope).where(F.col("fps_rank") < chosen.n_points)
        return own.join(ranks, "row_pos").where(F.col("fps_rank") < chosen.n_points).drop("fps_rank")

    # analyses ----------------------------------------------------------------------------------------------------------

    def analyze(self, scope: Scope, method: str = "pixel", what: str = "topological", **how) -> DataFrame:
        """What the sample of a method lost: one row for statistical, one for topological, the cells of the grid for density."""
        whole, reduced = self._points(scope), self.sample(scope, method, **how)
        if what == "statistical":
            return statistics.compare(whole, reduced)
        if what == "density":
            return density.difference(whole, reduced)
        if what != "topological":
            raise ValueError(f"unknown property {what!r}")
        pairs = self._diagrams(reduced).join(self._whole_diagrams(scope, whole), "_all").withColumn("original", F.struct("ref_h0", "ref_h1")).withColumn("reduced", F.struct("h0", "h1"))
        found = with_distances(pairs).withColumnRenamed("n_points", "n_displayed")
        return self._with_blocks(found, scope, how.get("baseline_key")).drop("_all")

    @staticmethod
    def _diagrams(points: DataFrame) -> DataFrame:
        return diagrams(with_coordinates(points).withColumn("_all", F.lit(0)), "_all")

    def _whole_diagrams(self, scope: Scope, whole: DataFrame) -> DataFrame:
        """Diagrams of all points of a scope: those of its curve's row of 100 %, if it is there."""
        if not (scope.zoom == "county" and self.providers) and self._is_valid(scope, "curves"):
            row = self._curve(scope).where("percentage = 100")
            if not row.isEmpty():
                return row.select(F.lit(0).alias("_all"), F.col("h0").alias("ref_h0"), F.col("h1").alias("ref_h1"), F.col("n_points").alias("n_exact"))
        return self._diagrams(whole).select("_all", F.col("h0").alias("ref_h0"), F.col("h1").alias("ref_h1"), F.col("n_points").alias("n_exact"))

    def _with_blocks(self, found: DataFrame, scope: Scope, baseline_key: object) -> DataFrame:
        """Adds baseline, current and normalized, structs of the four metrics; without a curve, baseline and normalized are null."""
        metrics = lambda values: F.struct(*[v.alias(m) for m, v in zip(METRICS, values)])
        found = found.withColumn("current", metrics([F.col(m) for m in METRICS]))
        key = str(baseline_key or "1")
        curve = self._curve(scope)
        base = curve.limit(0) if curve.isEmpty() else curves.baseline_row(curve, int(key), scope.zoom) if key.isdigit() else self.entry(scope, key)
        blocks = base.select(F.lit(0).alias("_of"), metrics([F.col(m) for m in METRICS]).alias("baseline"))
        joined = found.join(F.broadcast(blocks), F.col("_all") == F.col("_of"), "left").drop("_of")  # one row
        share = metrics([normalized(m, F.col(f"baseline.{m}")) for m in METRICS])
        return joined.withColumn("normalized", F.when(F.col("baseline").isNotNull(), share))

    # the rest of the surface -------------------------------------------------------------------------------------------

    def labels(self, state: str, min_count: int = 2, limit: int = 160) -> DataFrame:
        return county_labels(self.points.where(F.col("state") == state), min_count, limit).orderBy("rank")

    def meta(self) -> DataFrame:
        """state, counties with curves, of the kept scopes."""
        return coverage(store.read_or_empty(self.spark, f"{self.path}/curves_manifest", MANIFEST))

    def routes(self, thresholds: tuple[float, ...] = (0.25, 0.5, 0.75), percentages: tuple[int, ...] = (3, 4, 26, 50)) -> DataFrame:
        """zoom, state, county, method, parameters and route of every data query over all scopes."""
        variant = "array<struct<method: string, retain_pct: string, error_threshold: string, topology_baseline_pct: string>>"
        plain = [("all", None, None, None), ("pixel", None, None, None)]
        drawn = [("random", str(p), None, None) for p in percentages]
        chosen = [("fps_threshold", None, f"{t:.2f}", key) for t in thresholds for key in BASELINES]
        queries = F.array(*[F.struct(*[F.lit(x).cast("string") for x in q]) for q in plain + drawn + chosen]).cast(variant)
        each = all_scopes(self.points).select("*", F.explode(queries).alias("q")).select(*store.SCOPE, "q.*")
        base = [(c, F.col(c)) for c in ("zoom", "method", "state", "county")]
        route = (
            F.when(F.col("method") == "random", route_key("/api/data", [*base, ("retain_pct", F.col("retain_pct"))]))
            .when(F.col("method") == "fps_threshold", route_key("/api/data", [*base, ("error_threshold", threshold_text("error_threshold")), ("topology_baseline_pct", F.col("topology_baseline_pct"))]))
            .otherwise(route_key("/api/data", base))
        )
        return each.withColumn("route", route)

    def export(self, path: str, payloads: DataFrame) -> None:
        """Write snapshots (route and payload columns) to a new folder."""
        store.export_snapshots(store.snapshots(payloads, "route", F.struct(*[c for c in payloads.columns if c != "route"])), path)
