"""Scopes: country, state, county; filters, counts, labels and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlens.sources.points import with_coordinates

ZOOMS = ("country", "state", "county")
LEVELS = {"country": (), "state": ("state",), "county": ("state", "county")}


@dataclass(frozen=True)
class Scope:
    zoom: str = "country"
    state: str = ""
    county: str = ""

    def __post_init__(self) -> None:
        if self.zoom not in ZOOMS:
            raise ValueError(f"unknown zoom {self.zoom!r}")
        if self.zoom != "country" and not self.state.strip() or self.zoom == "county" and not self.county.strip():
            raise ValueError(f"a {self.zoom} scope needs its names")

    @property
    def condition(self) -> Column:
        names = {"state": self.state, "county": self.county}
        out = F.lit(True)
        for level in LEVELS[self.zoom]:
            out = out & (F.col(level) == names[level])
        return out


def in_scope(points: DataFrame, scope: Scope) -> DataFrame:
    """Points of a scope; names are compared exactly. The condition reaches the scan and prunes partitions."""
    return points.where(scope.condition)


def all_scopes(points: DataFrame) -> DataFrame:
    """zoom, state, county of the country, of every state and of every county with points."""
    blank = F.lit("")
    named = points.select("state", "county").distinct()
    states = named.where("state IS NOT NULL").select("state").distinct().select(F.lit("state").alias("zoom"), "state", blank.alias("county"))
    counties = named.where("state IS NOT NULL AND county IS NOT NULL").select(F.lit("county").alias("zoom"), "state", "county")
    country = points.sparkSession.range(1).select(F.lit("country").alias("zoom"), blank.alias("state"), blank.alias("county"))
    return country.unionByName(states).unionByName(counties)


def by_zoom(points: DataFrame, zooms: tuple[str, ...] = ZOOMS) -> DataFrame:
    """Each point once for every scope it is in, with zoom, and state and county of the scope (blank above its level)."""
    blank = F.lit("")
    forms = {
        "country": F.struct(F.lit("country").alias("zoom"), blank.alias("state"), blank.alias("county")),
        "state": F.when(F.col("state").isNotNull(), F.struct(F.lit("state").alias("zoom"), F.col("state").alias("state"), blank.alias("county"))),
        "county": F.when(F.col("state").isNotNull() & F.col("county").isNotNull(), F.struct(F.lit("county").alias("zoom"), F.col("state").alias("state"), F.col("county").alias("county"))),
    }
    scopes = F.explode(F.array_compact(F.array(*[forms[z] for z in zooms])))
    return points.withColumn("_scope", scopes).drop("state", "county").select("*", "_scope.*").drop("_scope")


def states(points: DataFrame) -> DataFrame:
    return points.select("state").where("state IS NOT NULL").distinct()


def counts(points: DataFrame, *by: str) -> DataFrame:
    """exact_count leaves out rows without coordinates, as the data endpoint does; all_count does not, as analyses do."""
    there = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")
    return points.groupBy(*by).agg(F.count_if(there).alias("exact_count"), F.count("*").alias("all_count"))


def county_labels(points: DataFrame, min_count: int = 2, limit: int = 160) -> DataFrame:
    """Of each state the counties with most points: state, county, lat, lng (means), n; rank orders them."""
    placed = with_coordinates(points).where("state IS NOT NULL AND county IS NOT NULL")
    means = placed.groupBy("state", "county").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count("id").alias("n"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.col("n").desc(), "county"))
    return means.where(F.col("n") >= min_count).withColumn("rank", rank).where(F.col("rank") <= limit)


def coverage(scopes: DataFrame) -> DataFrame:
    """state, counties (sorted) over the scopes that a manifest holds (zoom, state, county)."""
    known = scopes.where("zoom <> 'country' AND state <> ''")
    return known.groupBy("state").agg(F.sort_array(F.collect_set(F.when((F.col("zoom") == "county") & (F.col("county") != ""), F.col("county")))).alias("counties"))


def method_coverage(scopes: DataFrame, percentages: tuple[int, ...] = (3, 4, 26, 50)) -> DataFrame:
    """method, states, counties (map of states to their counties), retain_percentages (of random samples only): one row for each method."""
    known = coverage(scopes)
    whole = known.agg(F.sort_array(F.collect_list("state")).alias("states"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "counties")))).alias("counties"))
    methods = F.explode(F.array(*[F.lit(m) for m in ("all", "pixel", "fps_threshold", "random")]))
    each = whole.select(methods.alias("method"), "states", "counties")
    return each.withColumn("retain_percentages", F.when(F.col("method") == "random", F.array(*[F.lit(p) for p in percentages])))


def coverage_status(scopes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scopes with `available`: whether the manifest holds a row of them."""
    have = manifest.select("zoom", "state", "county").distinct().withColumn("_there", F.lit(True))
    return scopes.join(have, ["zoom", "state", "county"], "left").select("zoom", "state", "county", F.coalesce("_there", F.lit(False)).alias("available"))
