"""The registered queries of the geographic engine over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.functions import columns as C
from pointlens.functions import states as S
from pointlens.operators import curves, density, geometry, pixels, sampling, scope, statistics, topology
from pointlens.operators.fps import fps_order
from pointlens.operators.pixels import Viewport
from pointlens.plans import baselines
from pointlens.sources import store
from pointlens.sources.points import frame_signature, trim_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Point views over the tables -------------------------------------------------------------------------------------------


def _formula(df: DataFrame, key: str, state: Column, county: Column) -> DataFrame:
    k = F.col(key)
    lat = (F.lit(24000) + (k * k * 7919 + k * 31) % 25801).cast("double") / 1000
    lng = ((k * k * 104729 + k * 17) % 59001 - 125000).cast("double") / 1000
    return df.select(k.cast("string").alias("id"), lat.alias("lat"), lng.alias("lng"), state.alias("state"), county.alias("county"), k.alias("row_pos"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _formula(events, "event_id", F.col("event_type"), (F.col("user_id") % 10).cast("string"))


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return v.select(
        F.col("vec_id").cast("string").alias("id"), at(0).alias("lat"), at(1).alias("lng"), F.col("label").cast("string").alias("state"),
        (F.col("vec_id") % 4).cast("string").alias("county"), F.col("vec_id").alias("row_pos"),
    )


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _formula(customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey), "c_custkey", F.col("n_name"), F.col("c_mktsegment"))  # nation has 25 rows


def _view(name: str) -> str:
    """DuckDB: a point view as a common table expression called p."""
    formula = """CAST(24000 + ({k} * {k} * 7919 + {k} * 31) % 25801 AS DOUBLE) / 1000 AS lat,
       CAST(({k} * {k} * 104729 + {k} * 17) % 59001 - 125000 AS DOUBLE) / 1000 AS lng"""
    views = {
        "events": f"SELECT CAST(event_id AS VARCHAR) AS id, {formula.format(k='event_id')}, event_type AS state, CAST(user_id % 10 AS VARCHAR) AS county, event_id AS row_pos FROM events",
        "vectors": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lng, CAST(label AS VARCHAR) AS state, CAST(vec_id % 4 AS VARCHAR) AS county, vec_id AS row_pos FROM embeddings",
        "customers": f"SELECT CAST(c_custkey AS VARCHAR) AS id, {formula.format(k='c_custkey')}, n_name AS state, c_mktsegment AS county, c_custkey AS row_pos FROM customer JOIN nation ON c_nationkey = n_nationkey",
    }
    return f"p AS ({views[name]})"


# Scopes, counts, labels ------------------------------------------------------------------------------------------------


@query(f"WITH {_view('events')} SELECT * FROM p")
def scope_country(spark, sf_dir):
    return trim_sample(scope.in_scope(event_points(spark, sf_dir), scope.Scope()))


@query(f"WITH {_view('events')} SELECT * FROM p WHERE state = 'click'")
def scope_state(spark, sf_dir):
    return trim_sample(scope.in_scope(event_points(spark, sf_dir), scope.Scope("state", "click")))


@query(f"WITH {_view('customers')} SELECT * FROM p WHERE state = 'NATION_7' AND county = 'BUILDING'")
def scope_county(spark, sf_dir):
    return trim_sample(scope.in_scope(customer_points(spark, sf_dir), scope.Scope("county", "NATION_7", "BUILDING")))


@query(f"WITH {_view('events')} SELECT DISTINCT state FROM p WHERE state IS NOT NULL")
def available_states(spark, sf_dir):
    return scope.states(event_points(spark, sf_dir))


@query(f"""WITH {_view('events')} SELECT 'country' AS zoom, '' AS state, '' AS county UNION ALL SELECT DISTINCT 'state', state, '' FROM p
UNION ALL SELECT DISTINCT 'county', state, county FROM p""")
def all_scopes(spark, sf_dir):
    return scope.all_scopes(event_points(spark, sf_dir))


@query(f"WITH {_view('events')} SELECT state, county, count(*) FILTER (row_pos % 7 <> 0) AS exact_count, count(*) AS all_count FROM p GROUP BY state, county")
def exact_counts(spark, sf_dir):
    holed = event_points(spark, sf_dir).withColumn("lat", F.when(F.col("row_pos") % 7 != 0, F.col("lat")))
    return scope.counts(holed, "state", "county")


_LABELS = """, c AS (SELECT state, county, avg(lat) AS lat, avg(lng) AS lng, count(id) AS n FROM p GROUP BY state, county),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, county) AS rank FROM c WHERE n >= 2)
SELECT state, county, round(lat, 6) AS lat, round(lng, 6) AS lng, n, rank FROM r WHERE rank <= 160"""


@query(f"WITH {_view('events')}{_LABELS}")
def county_labels(spark, sf_dir):
    return scope.county_labels(event_points(spark, sf_dir)).withColumns({"lat": r6("lat"), "lng": r6("lng")})


@query(f"WITH {_view('customers')}{_LABELS}")
def county_labels_customers(spark, sf_dir):
    return scope.county_labels(customer_points(spark, sf_dir)).withColumns({"lat": r6("lat"), "lng": r6("lng")})


@query(f"WITH {_view('customers')} SELECT state, string_agg(DISTINCT county, ',' ORDER BY county) AS counties FROM p GROUP BY state")
def coverage(spark, sf_dir):
    kept = scope.all_scopes(customer_points(spark, sf_dir))
    return scope.coverage(kept).withColumn("counties", F.array_join("counties", ","))


@query(f"""WITH {_view('events')}, s AS (SELECT 'country' AS zoom, '' AS state, '' AS county UNION ALL SELECT DISTINCT 'state', state, '' FROM p
UNION ALL SELECT DISTINCT 'county', state, county FROM p) SELECT *, zoom = 'county' AND county < '5' AS available FROM s""")
def coverage_status(spark, sf_dir):
    found = scope.all_scopes(event_points(spark, sf_dir))
    return scope.coverage_status(found, found.where("zoom = 'county' AND county < '5'"))


@query(f"WITH {_view('events')} SELECT state, count(*) AS n_rows, arg_min(id, row_pos) AS first_id, arg_max(id, row_pos) AS last_id FROM p GROUP BY state")
def frame_signatures(spark, sf_dir):
    return frame_signature(event_points(spark, sf_dir), "state").drop("content_hash")


@query(f"""WITH {_view('customers')}, s AS (SELECT string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM p), m AS (SELECT unnest(['all', 'pixel', 'fps_threshold', 'random']) AS method)
SELECT method, states, CASE WHEN method = 'random' THEN '3,4,26,50' END AS retain_percentages FROM s, m""")
def method_coverage(spark, sf_dir):
    found = scope.method_coverage(scope.all_scopes(customer_points(spark, sf_dir)))
    return found.select("method", F.array_join("states", ",").alias("states"), F.array_join("retain_percentages", ",").alias("retain_percentages"))


@query(f"WITH {_view('events')}, s AS (SELECT 'country' AS zoom, '' AS state, '' AS county UNION ALL SELECT DISTINCT 'state', state, '' FROM p UNION ALL SELECT DISTINCT 'county', state, county FROM p) SELECT zoom, state, county, CASE zoom WHEN 'country' THEN 'country' WHEN 'state' THEN state ELSE county || ', ' || state END AS label, (SELECT count(*) FROM p WHERE (s.zoom = 'country' OR p.state = s.state) AND (s.zoom <> 'county' OR p.county = s.county)) AS n FROM s")
def scope_counts(spark, sf_dir):
    """Every scope's points in one pass."""
    points = scope.by_zoom(event_points(spark, sf_dir))
    return points.groupBy("zoom", "state", "county").agg(F.count("*").alias("n")).withColumn("label", C.scope_label("zoom", "state", "county"))


# Statistics and density ------------------------------------------------------------------------------------------------

_SUMMARY = "round(avg(lat), 6) AS mean_lat, round(avg(lng), 6) AS mean_lng, round(stddev_pop(lat), 6) AS std_lat, round(stddev_pop(lng), 6) AS std_lng, round(CASE WHEN count(*) >= 2 THEN corr(lat, lng) END, 6) AS correlation, count(*) AS n"
_ERRORS = ", ".join(f"round(abs(a.{m} - b.{m}), 5) AS error_{m}" for m in statistics.MEASURES)
_RAW = "avg(lat) AS mean_lat, avg(lng) AS mean_lng, stddev_pop(lat) AS std_lat, stddev_pop(lng) AS std_lng, CASE WHEN count(*) >= 2 THEN corr(lat, lng) END AS correlation, count(*) AS n"


def _errors(compared: DataFrame, *by: str) -> DataFrame:
    return compared.select(*by, "n_exact", "n_displayed", *[F.round(f"error_{m}", 5).alias(f"error_{m}") for m in statistics.MEASURES])


@query(f"WITH {_view('events')} SELECT state, {_SUMMARY} FROM p GROUP BY state")
def stat_summary(spark, sf_dir):
    found = statistics.summary(event_points(spark, sf_dir), "state")
    return found.withColumns({m: r6(m) for m in statistics.MEASURES})


@query(f"""WITH {_view('events')}, a AS (SELECT state, {_RAW} FROM p GROUP BY state), b AS (SELECT state, {_RAW} FROM p WHERE row_pos % 10 = 0 GROUP BY state)
SELECT a.state, a.n AS n_exact, coalesce(b.n, 0) AS n_displayed, {_ERRORS} FROM a LEFT JOIN b USING (state)""")
def stat_compare(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return _errors(statistics.compare(points, points.where("row_pos % 10 = 0"), "state"), "state")


@query(f"""WITH {_view('events')}, a AS (SELECT state, {_RAW} FROM p GROUP BY state), b AS (SELECT state, {_RAW} FROM p WHERE row_pos % 10 = 0 GROUP BY state),
e AS (SELECT a.state, {', '.join(f"abs(a.{m} - b.{m}) AS {m}" for m in statistics.MEASURES)} FROM a JOIN b USING (state)),
l AS (UNPIVOT e ON {', '.join(statistics.MEASURES)} INTO NAME measure VALUE difference)
SELECT state, arg_max(measure, difference) AS largest, round(max(difference), 5) AS largest_difference, arg_min(measure, difference) AS smallest, round(min(difference), 5) AS smallest_difference FROM l GROUP BY state""")
def stat_rank(spark, sf_dir):
    points = event_points(spark, sf_dir)
    ranked = statistics.ranked_errors(statistics.compare(points, points.where("row_pos % 10 = 0"), "state"), "state")
    return ranked.withColumns({c: F.round(c, 5) for c in ("largest_difference", "smallest_difference")})


_GRID = """, x AS (SELECT min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM p),
g AS (SELECT CAST(least(floor((lat - a) / (b - a) * 50), 49) AS INTEGER) AS lat_bin, CAST(least(floor((lng - c) / (d - c) * 50), 49) AS INTEGER) AS lng_bin, row_pos FROM p, x),
f AS (SELECT lat_bin, lng_bin, count(*) / (SELECT count(*) FROM g) AS original FROM g GROUP BY ALL),
s AS (SELECT lat_bin, lng_bin, count(*) / (SELECT count(*) FROM g WHERE row_pos % 10 = 0) AS reduced FROM g WHERE row_pos % 10 = 0 GROUP BY ALL),
t AS (SELECT lat_bin, lng_bin, coalesce(original, 0) AS original, coalesce(reduced, 0) AS reduced, coalesce(original, 0) - coalesce(reduced, 0) AS d FROM f FULL JOIN s USING (lat_bin, lng_bin))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_points(spark, sf_dir)
    return density.difference(points, points.where("row_pos % 10 = 0"))


@query(f"WITH {_view('events')}{_GRID} SELECT lat_bin, lng_bin, round(original, 6) AS mass FROM f")
def density_grid(spark, sf_dir):
    points = event_points(spark, sf_dir)
    return density.grid(points, density.extent(points)).withColumn("mass", r6("mass"))


@query(f"WITH {_view('events')}{_GRID} SELECT lat_bin, lng_bin, round(original, 6) AS original, round(reduced, 6) AS reduced, round(d, 6) AS difference FROM t")
def density_diff(spark, sf_dir):
    return _cells(spark, sf_dir).withColumns({c: r6(c) for c in ("original", "reduced", "difference")})


@query(f"""WITH {_view('events')}{_GRID}, m AS (SELECT greatest(max(abs(d)), 1e-12) AS top FROM t)
SELECT round(sqrt(sum(d * d)), 6) AS l2_norm, round(max(abs(d)), 6) AS linf_distance, round(greatest(0, least(1, 1 - sum(abs(d)) / 2)), 6) AS overlap,
round(coalesce(sum(d) FILTER (d > 0), 0), 6) AS positive_mass, round(coalesce(sum(-d) FILTER (d < 0), 0), 6) AS negative_mass,
count(*) FILTER (abs(d) >= 0.1 * top AND d <> 0) AS high_change_cells FROM t, m""")
def density_overlap(spark, sf_dir):
    found = density.metrics(_cells(spark, sf_dir))
    return found.select(*[r6(c).alias(c) for c in found.columns[:-1]], "high_change_cells")


@query(f"""WITH {_view('events')}, x AS (SELECT min(lat) AS a, max(lat) AS b FROM p), i AS (SELECT unnest(range(0, 51)) AS i)
SELECT i AS edge, round(a + (b - a) * i / 50, 6) AS lat_edge FROM x, i""")
def density_edges(spark, sf_dir):
    found = density.edges(density.extent(event_points(spark, sf_dir)))
    return found.select(F.posexplode("lat_edges").alias("edge", "lat_edge")).withColumn("lat_edge", r6("lat_edge"))


@query(f"WITH {_view('events')}{_GRID}, i AS (SELECT unnest(range(0, 50)) AS a), j AS (SELECT unnest(range(0, 50)) AS b) SELECT a AS lat_bin, b AS lng_bin, round(coalesce(d, 0), 6) AS v FROM i CROSS JOIN j LEFT JOIN t ON a = lat_bin AND b = lng_bin")
def density_matrix(spark, sf_dir):
    rows = density.matrix(_cells(spark, sf_dir), "difference").select(F.posexplode("difference").alias("lat_bin", "row"))
    return rows.select("lat_bin", F.posexplode("row").alias("lng_bin", "v")).withColumn("v", r6("v"))


# Boundaries ------------------------------------------------------------------------------------------------------------

#: A polygon, one with a hole, and one of two parts: region, polygon, ring, corners.
_REGIONS = [
    ("plain", 0, 0, [(-120.5, 30.25), (-90.25, 28.5), (-85.75, 45.25), (-118.25, 47.75)]),
    ("hole", 0, 0, [(-110.5, 26.25), (-70.25, 26.5), (-70.75, 48.25), (-110.25, 48.75)]),
    ("hole", 0, 1, [(-100.5, 32.25), (-80.25, 32.5), (-90.75, 44.25)]),
    ("parts", 0, 0, [(-124.5, 40.25), (-110.25, 41.5), (-115.75, 48.25)]),
    ("parts", 1, 0, [(-80.5, 25.25), (-70.25, 27.5), (-75.75, 38.25), (-79.25, 33.75)]),
]


def region_rings(spark: SparkSession) -> DataFrame:
    rows = [(region, poly, ring, i, x, y) for region, poly, ring, corners in _REGIONS for i, (x, y) in enumerate(corners)]
    return spark.createDataFrame(rows, geometry.RINGS)


def _edge_values() -> str:
    rows = []
    for region, poly, ring, corners in _REGIONS:
        rows += [f"('{region}', {poly}, {ring}, {a}, {b}, {c}, {d})" for (a, b), (c, d) in zip([corners[-1], *corners], corners)]
    return ", ".join(rows)


_EDGES = f"e AS (SELECT region, poly, ring, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM (VALUES {_edge_values()}) v(region, poly, ring, px, py, cx, cy))"


@query(f"""WITH {_view('events')}, {_EDGES},
h AS (SELECT row_pos, region, poly, ring, count(*) % 2 = 1 AS odd FROM p JOIN e ON (py > lat) <> (cy > lat) AND lng < (cx - px) * (lat - py) / (CASE WHEN cy = py THEN 1e-12 ELSE cy - py END) + px GROUP BY ALL),
q AS (SELECT row_pos, region, poly FROM h WHERE odd GROUP BY ALL HAVING bool_or(ring = 0) AND NOT bool_or(ring > 0))
SELECT DISTINCT row_pos, region FROM q""")
def point_in_polygon(spark, sf_dir):
    return geometry.containment(event_points(spark, sf_dir), geometry.edges_of_rings(region_rings(spark)))


#: Corners of a region around its place (ring 1: a hole, where the key is divisible by 3): ring, pos, dx, dy.
_SHAPE = [(0, 0, 0.0, 0.0), (0, 1, 3.0, 0.25), (0, 2, 2.5, 2.75), (0, 3, -0.5, 2.25), (1, 0, 1.0, 0.75), (1, 1, 2.0, 1.0), (1, 2, 1.25, 1.75)]


def supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each supplier: a four-sided ring at its place, some with a hole."""
    placed = _formula(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", F.lit(None).cast("string"), F.lit(None).cast("string"))
    shape = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(i).alias("pos"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for r, i, x, y in _SHAPE])
    corners = placed.withColumn("c", F.explode(shape)).where("c.ring = 0 OR row_pos % 3 = 0")
    return corners.select(F.col("id").alias("region"), F.lit(0).alias("poly"), "c.ring", "c.pos", (F.col("lng") + F.col("c.dx")).alias("lng"), (F.col("lat") + F.col("c.dy")).alias("lat"))


_RINGS = f"""o AS (SELECT ring, pos, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy FROM (VALUES {', '.join(map(str, _SHAPE))}) v(ring, pos, dx, dy)),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS region, s_suppkey AS k, CAST(24000 + (s_suppkey * s_suppkey * 7919 + s_suppkey * 31) % 25801 AS DOUBLE) / 1000 AS lat,
  CAST((s_suppkey * s_suppkey * 104729 + s_suppkey * 17) % 59001 - 125000 AS DOUBLE) / 1000 AS lng FROM supplier),
rp AS (SELECT region, 0 AS poly, ring, pos, lng + dx AS lng, lat + dy AS lat FROM s, o WHERE ring = 0 OR k % 3 = 0),
e AS (SELECT region, poly, ring, coalesce(lag(lng) OVER w, last_value(lng) OVER u) AS px, coalesce(lag(lat) OVER w, last_value(lat) OVER u) AS py, lng AS cx, lat AS cy FROM rp
  WINDOW w AS (PARTITION BY region, poly, ring ORDER BY pos), u AS (PARTITION BY region, poly, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {_view('events')}, {_RINGS},
h AS (SELECT row_pos, region, poly, ring, count(*) % 2 = 1 AS odd FROM p JOIN e ON (py > p.lat) <> (cy > p.lat) AND p.lng < (cx - px) * (p.lat - py) / (CASE WHEN cy = py THEN 1e-12 ELSE cy - py END) + px GROUP BY ALL)
SELECT row_pos, region FROM h WHERE odd GROUP BY row_pos, region, poly HAVING bool_or(ring = 0) AND NOT bool_or(ring > 0)""")
def point_in_region(spark, sf_dir):
    """Every event in every supplier's region, by the cell cover of all regions."""
    return geometry.containment(event_points(spark, sf_dir), geometry.edges_of_rings(supplier_rings(spark, sf_dir)))


@query(f"WITH {_RINGS} SELECT region, min(cx) AS west, min(cy) AS south, max(cx) AS east, max(cy) AS north FROM e GROUP BY region")
def boundary_bounds(spark, sf_dir):
    return geometry.bounds(supplier_rings(spark, sf_dir))


@query(f"""WITH {_view('events')}, b AS (SELECT state, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM p GROUP BY state),
c AS (SELECT *, greatest((e - w) * 0.08, 0.01) AS dx, greatest((n - s) * 0.08, 0.01) AS dy FROM b)
SELECT state, unnest(range(0, 5)) AS corner, round(unnest([w - dx, e + dx, e + dx, w - dx, w - dx]), 6) AS lng, round(unnest([s - dy, s - dy, n + dy, n + dy, s - dy]), 6) AS lat FROM c""")
def bbox_feature(spark, sf_dir):
    box = geometry.point_bounds(event_points(spark, sf_dir), "state")
    ring = geometry.padded_box(*[F.col(c) for c in ("west", "south", "east", "north")])
    return box.select("state", F.posexplode(ring).alias("corner", "p")).select("state", "corner", r6("p.lng").alias("lng"), r6("p.lat").alias("lat"))


@query(f"""WITH {_RINGS}, c AS (SELECT *, avg(cx) OVER w AS mx, avg(cy) OVER w AS my, greatest((max(cx) OVER w - min(cx) OVER w) * 0.04, 0.005) AS sx, greatest((max(cy) OVER w - min(cy) OVER w) * 0.04, 0.005) AS sy FROM e WINDOW w AS (PARTITION BY region, poly, ring)),
d AS (SELECT *, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS norm FROM c)
SELECT region, poly, ring, round(cx + (cx - mx) / norm * sx, 6) AS lng, round(cy + (cy - my) / norm * sy, 6) AS lat FROM d""")
def pad_ring(spark, sf_dir):
    rings = supplier_rings(spark, sf_dir).groupBy("region", "poly", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))), lambda x: F.struct(x.lng.alias("lng"), x.lat.alias("lat"))).alias("p"))
    moved = rings.select("region", "poly", "ring", F.explode(geometry.padded_ring(F.col("p"))).alias("q"))
    return moved.select("region", "poly", "ring", r6("q.lng").alias("lng"), r6("q.lat").alias("lat"))


def _hull_sql(view: str, *by: str) -> str:
    """DuckDB: corners of each scope's hull. An edge has all other points on its left; the lower chain runs to the east, the upper one back."""
    keys, same = ", ".join(by), " AND ".join(f"a.{c} = b.{c}" for c in by)
    return f"""{_view(view)}, u AS (SELECT DISTINCT {keys}, lng, lat FROM p), i AS (SELECT *, row_number() OVER (ORDER BY lng, lat) AS i FROM u),
h AS (SELECT {', '.join(f'a.{c}' for c in by)}, a.lng, a.lat, b.lng > a.lng AS lower FROM i a JOIN i b ON {same} AND a.i <> b.i
  WHERE NOT EXISTS (SELECT 1 FROM i c WHERE {' AND '.join(f'a.{c} = c.{c}' for c in by)} AND c.i <> a.i AND c.i <> b.i AND (b.lng - a.lng) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lng - a.lng) <= 0)),
corners AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY lower DESC, CASE WHEN lower THEN lng ELSE -lng END) - 1 AS INTEGER) AS corner, lng, lat FROM h)"""


@query(f"WITH {_hull_sql('vectors', 'state')} SELECT * FROM corners")
def convex_hull(spark, sf_dir):
    return geometry.convex_hulls(vector_points(spark, sf_dir), "state")


@query(f"""WITH {_hull_sql('vectors', 'state', 'county')},
c AS (SELECT *, count(*) OVER w AS n, avg(lng) OVER w AS mx, avg(lat) OVER w AS my, greatest((max(lng) OVER w - min(lng) OVER w) * 0.04, 0.005) AS sx, greatest((max(lat) OVER w - min(lat) OVER w) * 0.04, 0.005) AS sy FROM corners WINDOW w AS (PARTITION BY state, county)),
d AS (SELECT *, sqrt((lng - mx) * (lng - mx) + (lat - my) * (lat - my)) AS norm FROM c WHERE n >= 3),
m AS (SELECT state, county, corner, CAST(n AS INTEGER) AS n, round(lng + (lng - mx) / norm * sx, 6) AS lng, round(lat + (lat - my) / norm * sy, 6) AS lat FROM d)
SELECT state, county, 'convex-hull' AS source, corner, lng, lat FROM m UNION ALL SELECT state, county, 'convex-hull', n, lng, lat FROM m WHERE corner = 0""")
def fallback_boundary(spark, sf_dir):
    rings = geometry.fallback_rings(vector_points(spark, sf_dir), "state", "county").where("source = 'convex-hull'")
    corners = rings.select("state", "county", "source", F.posexplode("ring").alias("corner", "p"))
    return corners.select("state", "county", "source", "corner", r6("p.lng").alias("lng"), r6("p.lat").alias("lat"))


@query(f"""WITH {_view('vectors')}, g AS (SELECT state, CAST(row_pos % 211 AS VARCHAR) AS county, lng, lat FROM p),
b AS (SELECT state, county, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM g GROUP BY state, county HAVING count(DISTINCT (lng, lat)) < 3),
c AS (SELECT *, greatest((e - w) * 0.08, 0.01) AS dx, greatest((n - s) * 0.08, 0.01) AS dy FROM b)
SELECT state, county, 'bbox' AS source, CAST(unnest(range(0, 5)) AS INTEGER) AS corner, round(unnest([w - dx, e + dx, e + dx, w - dx, w - dx]), 6) AS lng, round(unnest([s - dy, s - dy, n + dy, n + dy, s - dy]), 6) AS lat FROM c""")
def fallback_box(spark, sf_dir):
    """Boundaries of scopes whose points have no hull."""
    sparse = vector_points(spark, sf_dir).withColumn("county", (F.col("row_pos") % 211).cast("string"))
    corners = geometry.fallback_rings(sparse, "state", "county").where("source = 'bbox'").select("state", "county", "source", F.posexplode("ring").alias("corner", "p"))
    return corners.select("state", "county", "source", "corner", r6("p.lng").alias("lng"), r6("p.lat").alias("lat"))


#: A row of unit squares, one for each supplier's key k, whose sides are arcs: left (3k), bottom (3k + 1) and top (3k + 2); the right side is the next square's left one.
_STEPS = [(0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 0, 0), (1, 1, 1, 0), (2, 0, 1, 1), (2, 1, -1, 0)]
_SIDES = [(0, 0, 1), (1, 1, 0), (2, 0, 2)]  # part, square after its own, arc; the left side is the last part, backwards


def supplier_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arc, pos, dx, dy: quantised steps of all squares' arcs."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.explode(F.array("s_suppkey", F.col("s_suppkey") + 1)).alias("k")).distinct()
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "pos", "dx", "dy"), step)]) for step in _STEPS])
    each = keys.withColumn("s", F.explode(steps))
    first = F.when(F.col("s.pos") == 0, F.col("k")).otherwise(0)
    return each.select((F.col("k") * 3 + F.col("s.a")).alias("arc"), "s.pos", (F.col("s.dx") + first).alias("dx"), "s.dy")


_ARC_SQL = f"""k AS (SELECT DISTINCT unnest([s_suppkey, s_suppkey + 1]) AS k FROM supplier), t AS (SELECT * FROM (VALUES {', '.join(map(str, _STEPS))}) v(a, pos, dx, dy)),
a AS (SELECT k * 3 + a AS arc, pos, dx + CASE WHEN pos = 0 THEN k ELSE 0 END AS dx, dy FROM k, t)"""


@query(f"""WITH {_view('events')}, {_EDGES},
h AS (SELECT row_pos, poly, ring, count(*) % 2 = 1 AS odd FROM p JOIN e ON region = 'hole' AND (py > lat) <> (cy > lat) AND lng < (cx - px) * (lat - py) / (CASE WHEN cy = py THEN 1e-12 ELSE cy - py END) + px GROUP BY ALL),
q AS (SELECT row_pos FROM h WHERE odd GROUP BY row_pos, poly HAVING bool_or(ring = 0) AND NOT bool_or(ring > 0))
SELECT row_pos, id FROM p WHERE row_pos IN (SELECT row_pos FROM q)""")
def clip_to_boundary(spark, sf_dir):
    return geometry.inside(event_points(spark, sf_dir), geometry.edges_of_rings(region_rings(spark)), "hole").select("row_pos", "id")


@query(f"WITH {_view('events')} SELECT state, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM p GROUP BY state")
def point_bounds(spark, sf_dir):
    return geometry.point_bounds(event_points(spark, sf_dir), "state")


@query(f"""WITH {_ARC_SQL}
SELECT arc, pos, round(sum(dx) OVER w * CAST(0.25 AS DOUBLE) - 100, 6) AS lng, round(sum(dy) OVER w * CAST(0.5 AS DOUBLE) + 20, 6) AS lat FROM a WINDOW w AS (PARTITION BY arc ORDER BY pos)""")
def topojson_decode(spark, sf_dir):
    return geometry.decode_arcs(supplier_arcs(spark, sf_dir), (0.25, 0.5), (-100.0, 20.0)).withColumns({"lng": r6("lng"), "lat": r6("lat")})


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS region, CAST(unnest(range(0, 5)) AS INTEGER) AS pos, CAST(s_suppkey + unnest([0, 1, 1, 0, 0]) AS INTEGER) AS lng, unnest([0, 0, 1, 1, 0]) AS lat FROM supplier""")
def topojson_rings(spark, sf_dir):
    sides = F.array(*[F.struct(F.lit(part).alias("part"), ((F.col("s_suppkey") + n) * 3 + a).alias("arc")) for part, n, a in _SIDES], F.struct(F.lit(3).alias("part"), (-F.col("s_suppkey") * 3 - 1).alias("arc")))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(sides).alias("u"))
    uses = keys.select(F.col("s_suppkey").cast("string").alias("region"), F.lit(0).alias("poly"), F.lit(0).alias("ring"), "u.part", "u.arc")
    rings = geometry.stitch_rings(uses, geometry.decode_arcs(supplier_arcs(spark, sf_dir), (1.0, 1.0), (0.0, 0.0)))
    return rings.select("region", "pos", F.col("lng").cast("int").alias("lng"), F.col("lat").cast("int").alias("lat"))


# Pixels ----------------------------------------------------------------------------------------------------------------

_MERCATOR = "ln(tan(pi() / 4 + radians(greatest(least({0}, 85.05112878), -85.05112878)) / 2))"


@query(f"WITH {_view('events')} SELECT row_pos, round(radians(lng), 6) AS x, round({_MERCATOR.format('lat')}, 6) AS y FROM p")
def mercator_xy(spark, sf_dir):
    return event_points(spark, sf_dir).select("row_pos", r6(C.mercator_x("lng")).alias("x"), r6(C.mercator_y("lat")).alias("y"))


@query(f"""WITH {_view('events')}, b AS (SELECT state, radians(min(lng)) AS x0, radians(max(lng)) AS x1, {_MERCATOR.format('min(lat)')} AS y0, {_MERCATOR.format('max(lat)')} AS y1 FROM p GROUP BY state),
c AS (SELECT *, least(1184 / (x1 - x0), 832 / (y1 - y0)) AS s FROM b)
SELECT row_pos, round(32 + (1184 - (x1 - x0) * s) / 2 + (radians(lng) - x0) * s, 4) AS px, round(32 + (832 - (y1 - y0) * s) / 2 + (y1 - {_MERCATOR.format('lat')}) * s, 4) AS py FROM p JOIN c USING (state)""")
def fit_pixels(spark, sf_dir):
    placed = pixels.fit_pixels(event_points(spark, sf_dir), Viewport.of("state"), "state")
    return placed.select("row_pos", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(f"WITH {_view('vectors')}, q AS (SELECT lat, lng, row_pos FROM p) SELECT round(min(sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng))), 9) AS spacing FROM q a JOIN q b ON a.row_pos < b.row_pos")
def min_pairwise(spark, sf_dir):
    found = pixels.min_distance(vector_points(spark, sf_dir), "lng", "lat")
    return spark.range(1).select(F.round(F.lit(found), 9).alias("spacing"))


def _thin_sql(points: str, distance: float) -> str:
    """DuckDB: greedy thinning of `points` (state, row_pos, x, y) by rounds: a point is decided once all points before it that are too near are."""
    bound = distance * distance - max(1e-15, distance * distance * 1e-12)
    return f"""q AS ({points}),
e AS MATERIALIZED (SELECT a.state, a.row_pos AS late, b.row_pos AS early FROM q a JOIN q b ON a.state = b.state AND b.row_pos < a.row_pos AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < CAST({bound!r} AS DOUBLE)),
w AS (
  SELECT 0 AS step, state, row_pos, CAST(NULL AS BOOLEAN) AS kept FROM q
  UNION ALL
  SELECT step + 1, w.state, w.row_pos, CASE WHEN kept IS NOT NULL THEN kept WHEN any_kept THEN false WHEN any_open THEN NULL ELSE true END
  FROM w LEFT JOIN (SELECT e.state, late, bool_or(coalesce(o.kept, false)) AS any_kept, bool_or(o.kept IS NULL) AS any_open FROM e JOIN w o ON o.state = e.state AND o.row_pos = early GROUP BY e.state, late) s
    ON s.state = w.state AND late = w.row_pos
  WHERE (SELECT count(*) FROM w WHERE kept IS NULL) > 0)
SELECT state, row_pos FROM w WHERE kept AND step = (SELECT max(step) FROM w)"""


@query(f"WITH RECURSIVE {_view('vectors')}, {_thin_sql('SELECT state, row_pos, lng AS x, lat AS y FROM p', 0.05)}")
def thin_by_distance(spark, sf_dir):
    return pixels.thin(vector_points(spark, sf_dir), 0.05, "state", order="row_pos", x="lng", y="lat")


_PIXELS = f"""b AS (SELECT state, radians(min(lng)) AS x0, radians(max(lng)) AS x1, {_MERCATOR.format('min(lat)')} AS y0, {_MERCATOR.format('max(lat)')} AS y1 FROM p GROUP BY state),
c AS (SELECT *, least(1184 / (x1 - x0), 832 / (y1 - y0)) AS s FROM b),
f AS (SELECT state, row_pos, 32 + (1184 - (x1 - x0) * s) / 2 + (radians(lng) - x0) * s AS x, 32 + (832 - (y1 - y0) * s) / 2 + (y1 - {_MERCATOR.format('lat')}) * s AS y FROM p JOIN c USING (state))"""


@query(f"WITH RECURSIVE {_view('events')}, {_PIXELS}, {_thin_sql('SELECT * FROM f', pixels.marker_spacing('state'))}")
def pixel_occupancy(spark, sf_dir):
    return pixels.pixel_sample(event_points(spark, sf_dir), "state", None, "state").select("state", "row_pos")


# Samples ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_view('events')}, s AS (SELECT state, county, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT unnest(range(1, 101)) AS percentage)
SELECT state, county, n, percentage, CAST(least(n, greatest(1, round_even(n * (percentage / 100::DOUBLE), 0))) AS BIGINT) AS n_keep FROM s, q WHERE percentage <= 30 OR percentage % 2 = 0""")
def retain_sizes(spark, sf_dir):
    sizes = event_points(spark, sf_dir).groupBy("state", "county").agg(F.count("*").alias("n"))
    return sampling.retain_sizes(sizes, sampling.configured("state")).withColumn("n_keep", F.col("n_keep").cast("long"))


_FPS = f"""{_view('vectors')}, centre AS (SELECT state, avg(lat) AS a, avg(lng) AS b FROM p GROUP BY state),
w AS (
  SELECT 0 AS step, state, row_pos, lat, lng, CAST('inf' AS DOUBLE) AS d2, first AS now, first AS done
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY (lat - a) * (lat - a) + (lng - b) * (lng - b) DESC, row_pos) = 1 AS first FROM p JOIN centre USING (state))
  UNION ALL
  SELECT step + 1, state, row_pos, lat, lng, nd, NOT done AND next, done OR next
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY done, nd DESC, row_pos) = 1 AS next
        FROM (SELECT w.step, w.state, w.row_pos, w.lat, w.lng, w.done, least(w.d2, (w.lat - k.lat) * (w.lat - k.lat) + (w.lng - k.lng) * (w.lng - k.lng)) AS nd
              FROM w JOIN (SELECT state, lat, lng FROM w WHERE now) k ON k.state = w.state))),
ranks AS (SELECT state, row_pos, CAST(step AS BIGINT) AS fps_rank FROM w WHERE now)"""
_SIZES = "sizes AS (SELECT state, count(*) AS n FROM p GROUP BY state), wanted AS (SELECT unnest([{0}]) AS percentage), keep AS (SELECT state, percentage, CAST(least(n, greatest(1, round_even(n * (percentage / 100::DOUBLE), 0))) AS INTEGER) AS n_keep FROM sizes, wanted)"


@query(f"WITH RECURSIVE {_FPS} SELECT state, row_pos FROM ranks WHERE fps_rank = 0")
def fps_first(spark, sf_dir):
    return fps_order(vector_points(spark, sf_dir).withColumn("_steps", F.lit(1)), "state", steps_col="_steps").select("state", "row_pos")


@query(f"WITH RECURSIVE {_FPS} SELECT * FROM ranks")
def fps_ranks(spark, sf_dir):
    return fps_order(vector_points(spark, sf_dir), "state")


@query(f"WITH RECURSIVE {_FPS}, {_SIZES.format('1, 5, 10, 20, 50, 100')} SELECT state, percentage, n_keep, row_pos, fps_rank FROM ranks JOIN keep USING (state) WHERE fps_rank < n_keep")
def fps_samples(spark, sf_dir):
    points = vector_points(spark, sf_dir)
    samples = sampling.fps_prefixes(points, fps_order(points, "state"), [1, 5, 10, 20, 50, 100], "state")
    return samples.select("state", "percentage", F.col("n_keep").cast("int").alias("n_keep"), "row_pos", "fps_rank")


@query(f"""WITH {_view('customers')}, s AS (SELECT DISTINCT state, county FROM p), q AS (SELECT unnest([3, 4, 26, 50]) AS percentage)
SELECT state, county, percentage, CAST('0x' || substr(sha256('{{"county": "' || county || '", "method": "random", "retain_percentage": ' || percentage || ', "state": "' || state || '", "zoom": "county"}}'), 1, 8) AS BIGINT) AS seed FROM s, q""")
def random_seeds(spark, sf_dir):
    scopes = customer_points(spark, sf_dir).select("state", "county").distinct()
    each = scopes.withColumn("percentage", F.explode(F.array(*[F.lit(p) for p in (3, 4, 26, 50)])))
    return each.withColumn("seed", C.random_seed(F.lit("county"), F.col("state"), F.col("county"), F.col("percentage")))


@query()
def random_sample(spark, sf_dir):
    return sampling.random_sample(event_points(spark, sf_dir), "state", 26, "state").select("state", "row_pos", "draw_rank")


@query(f"""WITH {_view('events')}, n AS (SELECT state, count(*) AS n FROM p GROUP BY state),
k AS (SELECT state, n, CAST(least(n, greatest(1, round_even(n * (26 / 100::DOUBLE), 0))) AS BIGINT) AS k,
  CAST('0x' || substr(sha256('{{"county": "", "method": "random", "retain_percentage": 26, "state": "' || state || '", "zoom": "state"}}'), 1, 8) AS BIGINT) AS seed FROM n),
r AS (SELECT state, row_pos, k, row_number() OVER (PARTITION BY state ORDER BY md5(seed || ':' || row_pos), row_pos) - 1 AS draw_rank FROM p JOIN k USING (state))
SELECT state, row_pos, draw_rank FROM r WHERE draw_rank < k""")
def keyed_sample(spark, sf_dir):
    return sampling.keyed_sample(event_points(spark, sf_dir), "state", 26, "state").select("state", "row_pos", "draw_rank")


# Topology and curves ---------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_view('vectors')}, v AS (SELECT DISTINCT state, lat, lng FROM p), i AS (SELECT row_number() OVER (PARTITION BY state ORDER BY lat, lng) AS i, * FROM v),
w AS (
  SELECT 0 AS step, state, i, lat, lng, CAST('inf' AS DOUBLE) AS d2, i = 1 AS now, i = 1 AS done, CAST(0 AS DOUBLE) AS edge FROM i
  UNION ALL
  SELECT step + 1, state, i, lat, lng, nd, next AND NOT done, done OR next, nd
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY done, nd, i) = 1 AS next
        FROM (SELECT w.step, w.state, w.i, w.lat, w.lng, w.done, least(w.d2, (w.lat - k.lat) * (w.lat - k.lat) + (w.lng - k.lng) * (w.lng - k.lng)) AS nd
              FROM w JOIN (SELECT state, lat, lng FROM w WHERE now) k ON k.state = w.state)))
SELECT state, round(edge / 4, 9) AS death FROM w WHERE now AND step > 0""")
def h0_deaths(spark, sf_dir):
    found = topology.diagram_rows(topology.diagrams(vector_points(spark, sf_dir), "state"), "state")
    return found.where("family = 'H0'").select("state", F.round("death", 9).alias("death"))


@query()
def h1_pairs(spark, sf_dir):
    return topology.diagram_rows(topology.diagrams(vector_points(spark, sf_dir), "state"), "state").where("family = 'H1'")


@query()
def diagram_axes(spark, sf_dir):
    return topology.axis_range(topology.diagram_rows(topology.diagrams(vector_points(spark, sf_dir), "state"), "state"))


@query()
def error_curve(spark, sf_dir):
    return curves.error_curve(vector_points(spark, sf_dir), "state", "state", with_diagrams=False)


@query()
def threshold_selection(spark, sf_dir):
    curve = curves.threshold_rows(vector_points(spark, sf_dir), "state", "state", baseline=5, threshold=0.5)
    return curves.select_by_threshold(curves.normalize(curve, curves.baseline_row(curve, 5, "state", "state"), "state"), 0.5, "bottleneck_h0", "state")


@query()
def distance_baseline(spark, sf_dir):
    points = vector_points(spark, sf_dir)
    return baselines.baseline_entry(points, scope.Scope("state", "3"), baselines.BASELINES["country_1pct_distance"])


def _table_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve of every state of the events: how far the means of a growing sample are from those of all points, in the columns of an error curve."""
    parts = event_points(spark, sf_dir).groupBy(F.col("state").alias("scope"), (F.col("row_pos") % 100).alias("u")).agg(F.count("*").alias("c"), F.sum("lat").alias("a"), F.sum("lng").alias("b"))
    whole = parts.groupBy("scope").agg((F.sum("a") / F.sum("c")).alias("_a"), (F.sum("b") / F.sum("c")).alias("_b"))
    each = parts.withColumn("percentage", F.explode(F.array(*[F.lit(p) for p in sampling.configured("state")]))).where("u < percentage")
    means = each.groupBy("scope", "percentage").agg(F.sum("c").cast("int").alias("n_points"), (F.sum("a") / F.sum("c")).alias("a"), (F.sum("b") / F.sum("c")).alias("b")).join(whole, "scope")
    means = means.withColumns({"x": r6(F.abs(F.col("a") - F.col("_a"))), "y": r6(F.abs(F.col("b") - F.col("_b")))})
    h1 = F.when(F.col("percentage") % 3 == 0, F.lit(0.0)).otherwise(F.col("y"))
    return means.select("scope", "percentage", "n_points", F.col("x").alias("bottleneck_h0"), F.col("y").alias("bottleneck_h1"), (F.col("x") + F.col("y")).alias("wasserstein_h0"), h1.alias("wasserstein_h1"))


_CURVE_SQL = f"""{_view('events')}, ka AS (SELECT state AS scope, row_pos % 100 AS u, count(*) AS c, sum(lat) AS a, sum(lng) AS b FROM p GROUP BY ALL),
kq AS (SELECT percentage FROM (SELECT unnest(range(1, 101)) AS percentage) WHERE percentage <= 30 OR percentage % 2 = 0), kt AS (SELECT scope, sum(a) / sum(c) AS ta, sum(b) / sum(c) AS tb FROM ka GROUP BY scope),
km AS (SELECT scope, percentage, CAST(sum(c) AS INTEGER) AS n_points, round(abs(sum(a) / sum(c) - any_value(ta)), 6) AS x, round(abs(sum(b) / sum(c) - any_value(tb)), 6) AS y FROM ka JOIN kq ON u < percentage JOIN kt USING (scope) GROUP BY scope, percentage),
k AS (SELECT scope, CAST(percentage AS INTEGER) AS percentage, n_points, x AS bottleneck_h0, y AS bottleneck_h1, x + y AS wasserstein_h0, CASE WHEN percentage % 3 = 0 THEN 0 ELSE y END AS wasserstein_h1 FROM km)"""
_NORMAL = f"""{_CURVE_SQL}, m AS (SELECT k.*, b.percentage AS baseline_percentage, b.n_points AS baseline_points, {', '.join(f"CASE WHEN b.{x} <= 0 THEN CASE WHEN k.{x} <= 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE k.{x} / b.{x} END AS normalized_{x}" for x in topology.METRICS)}
FROM k JOIN k b ON b.scope = k.scope AND b.percentage = 2)"""


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _table_curve(spark, sf_dir)
    return curves.normalize(curve, curves.baseline_row(curve, 2, "state", "scope"), "scope")


@query(f"WITH {_NORMAL} SELECT scope, percentage, {', '.join(f'CASE WHEN isfinite(normalized_{x}) THEN round(normalized_{x}, 6) END AS normalized_{x}' for x in topology.METRICS)} FROM m")
def normalize_metrics(spark, sf_dir):
    finite = lambda c: F.when(F.abs(F.col(c)) != float("inf"), r6(c)).alias(c)
    return _normal(spark, sf_dir).select("scope", "percentage", *[finite(f"normalized_{m}") for m in topology.METRICS])


@query(f"""WITH {_NORMAL}, c AS (SELECT scope, coalesce(min(percentage) FILTER (normalized_bottleneck_h0 <= 0.6), max(percentage)) AS percentage FROM m WHERE percentage >= baseline_percentage GROUP BY scope)
SELECT scope, percentage, n_points, bottleneck_h0, normalized_bottleneck_h0 <= 0.6 AS within FROM c JOIN m USING (scope, percentage)""")
def select_threshold(spark, sf_dir):
    return curves.select_by_threshold(_normal(spark, sf_dir), 0.6, "bottleneck_h0", "scope").select("scope", "percentage", "n_points", "bottleneck_h0", "within")


@query(f"""WITH {_NORMAL}, c AS (SELECT scope, coalesce(min(percentage) FILTER (normalized_wasserstein_h0 <= 0.5), max(percentage)) AS percentage FROM m WHERE n_points >= baseline_points GROUP BY scope)
SELECT scope, percentage, n_points, wasserstein_h0, normalized_wasserstein_h0 <= 0.5 AS within FROM c JOIN m USING (scope, percentage)""")
def select_distance_baseline(spark, sf_dir):
    return curves.select_by_distance_baseline(_normal(spark, sf_dir), 0.5, "wasserstein_h0", "scope").select("scope", "percentage", "n_points", "wasserstein_h0", "within")


@query(f"""WITH {_CURVE_SQL}, q AS (SELECT unnest([1, 3, 7, 60]) AS requested)
SELECT requested, scope, coalesce(max(percentage) FILTER (percentage <= requested), min(percentage)) AS below, coalesce(min(percentage) FILTER (percentage >= requested), max(percentage)) AS above FROM k, q GROUP BY ALL""")
def nearest_percentage(spark, sf_dir):
    curve, out = _table_curve(spark, sf_dir), None
    for p in (1, 3, 7, 60):
        below = curves.nearest_percentage(curve, p, True, "scope").withColumnRenamed("percentage", "below")
        row = below.join(curves.nearest_percentage(curve, p, False, "scope").withColumnRenamed("percentage", "above"), "scope").withColumn("requested", F.lit(p))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_CURVE_SQL}, n AS (SELECT scope, percentage, n_points + 1 AS n_points, bottleneck_h0 FROM k WHERE percentage % 5 = 0)
SELECT scope, percentage, coalesce(n.n_points, k.n_points) AS n_points FROM k LEFT JOIN n USING (scope, percentage)""")
def curve_overlay(spark, sf_dir):
    curve = _table_curve(spark, sf_dir)
    partial = curve.where("percentage % 5 = 0").withColumn("n_points", F.col("n_points") + 1)
    return curves.overlay(curve, partial, "scope").select("scope", "percentage", "n_points")


@query(f"""WITH {_CURVE_SQL}, part_k AS (SELECT * FROM k WHERE percentage % 4 <> 3 OR scope = 'view'), q AS (SELECT unnest(range(1, 11)) AS p),
m AS (SELECT s.scope, list(p ORDER BY p) FILTER (part_k.percentage IS NULL) AS l FROM (SELECT DISTINCT scope FROM part_k) s CROSS JOIN q LEFT JOIN part_k ON part_k.scope = s.scope AND part_k.percentage = p GROUP BY s.scope)
SELECT scope, (SELECT count(*) FROM part_k WHERE part_k.scope = m.scope) AS row_count, coalesce(array_to_string(l, ','), '') AS missing, l IS NULL AS complete FROM m""")
def curve_missing(spark, sf_dir):
    found = curves.completeness(_table_curve(spark, sf_dir).where("percentage % 4 <> 3 OR scope = 'view'"), "state", "scope", most=10)
    return found.withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {_CURVE_SQL} SELECT scope, percentage, round(n_points / CAST(100000 AS DOUBLE) * 100, 6) AS equivalent, CASE WHEN bottleneck_h1 <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS itself, CAST(round(100.0 * percentage / 65) AS INTEGER) AS progress FROM k WHERE percentage <= 60")
def curve_figures(spark, sf_dir):
    total = F.lit(100000)
    return _table_curve(spark, sf_dir).where("percentage <= 60").select(
        "scope", "percentage", r6(C.equivalent_percentage("n_points", total)).alias("equivalent"), C.normalized_against_itself("bottleneck_h1").alias("itself"), C.progress("percentage", F.lit(65)).alias("progress")
    )


# Names, keys, lookups --------------------------------------------------------------------------------------------------

_COUNTY_FORMS = ["St. {} County", " {} Parish ", "{}", "{} Municipality", "{}  City and Borough", "{}  Census Area", "De {}:x/y"]
_COUNTY_NAMES = "CASE row_pos % 7 " + " ".join(f"WHEN {i} THEN replace('{form}', '{{}}', county)" for i, form in enumerate(_COUNTY_FORMS)) + " END"


@query(f"""WITH {_view('customers')}, c AS (SELECT DISTINCT {_COUNTY_NAMES} AS county FROM p), l AS (SELECT county, lower(trim(county)) AS low FROM c),
d AS (SELECT county, CASE WHEN low LIKE '% county' THEN left(low, -7) WHEN low LIKE '% parish' THEN left(low, -7) WHEN low LIKE '% borough' THEN left(low, -8)
  WHEN low LIKE '% census area' THEN left(low, -12) WHEN low LIKE '% municipality' THEN left(low, -13) ELSE low END AS cut FROM l)
SELECT county, trim(regexp_replace(replace(cut, '.', ' '), '\\s+', ' ', 'g')) AS normal, translate(county, '\\/: ', '____') AS safe FROM d""")
def normalize_county(spark, sf_dir):
    names = customer_points(spark, sf_dir).select(F.expr(_COUNTY_NAMES).alias("county")).distinct()
    return names.select("county", C.normalize_county("county").alias("normal"), C.safe_name("county").alias("safe"))


_CODES = [r[1] for r in S.ROWS]
#: Every other state of the table stands for a nation; a segment's number is that of its first letter.
_STATES = "st AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in S.ROWS) + f") v(fips, code, name)), pl AS (SELECT DISTINCT {_CODES!r}[2 * c_nationkey + 1] AS state, c_mktsegment AS segment FROM customer)"
_ATLAS = "atl AS (SELECT DISTINCT fips || lpad(CAST(2 * (ascii(segment) - 64) + 1 AS VARCHAR), 3, '0') AS fips, segment || ' County' AS name, lower(segment) AS low FROM pl JOIN st ON code = state WHERE ascii(segment) <> 72)"


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state (a code), segment: where customers are."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.get(codes, 2 * F.col("c_nationkey")).alias("state"), F.col("c_mktsegment").alias("segment")).distinct()


def customer_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fips (without leading zeros), name of counties: a county for each state and segment, but one segment that no atlas has."""
    placed = customer_places(spark, sf_dir).where(F.ascii("segment") != 72).join(F.broadcast(S.state_table(spark)), F.col("state") == F.col("code"))  # 52 rows
    number = F.lpad((2 * (F.ascii("segment") - 64) + 1).cast("string"), 3, "0")
    return placed.select(F.concat("fips", number).cast("int").cast("string").alias("fips"), F.concat("segment", F.lit(" County")).alias("name")).distinct()


@query(f"WITH {_STATES} SELECT fips, code, name FROM st WHERE code IN (SELECT state FROM pl)")
def fips_lookup(spark, sf_dir):
    return S.available_states(spark, customer_places(spark, sf_dir))


@query(f"""WITH {_STATES}, {_ATLAS}, wanted AS (SELECT DISTINCT state, unnest([segment, ' ' || lower(segment) || ' Parish', segment || ' City']) AS county, lower(segment) AS low FROM pl)
SELECT state, county, min(atl.fips) AS fips, arg_min(atl.name, atl.fips) AS name FROM wanted JOIN st ON code = state JOIN atl ON atl.fips[1:2] = st.fips AND atl.low = wanted.low WHERE county NOT LIKE '% City' GROUP BY state, county""")
def county_match(spark, sf_dir):
    names = F.array("segment", F.concat(F.lit(" "), F.lower("segment"), F.lit(" Parish")), F.concat("segment", F.lit(" City")))
    wanted = customer_places(spark, sf_dir).select("state", F.explode(names).alias("county")).distinct()
    return S.match_counties(wanted, customer_atlas(spark, sf_dir))


@query(f"WITH {_STATES}, {_ATLAS} SELECT fips[1:2] AS state_fips, string_agg(fips, ',' ORDER BY fips) AS counties FROM atl GROUP BY fips[1:2]")
def counties_by_state(spark, sf_dir):
    return S.counties_by_state(customer_atlas(spark, sf_dir)).withColumn("counties", F.array_join("counties", ","))


@query(f"""WITH {_view('customers')}, s AS (SELECT DISTINCT state, county FROM p), r AS (SELECT *, '/api/labels/counties?state=' || replace(state, ' ', '+') || '&county=' || county AS route FROM s)
SELECT state, county, route, substr(sha1(route), 1, 16) AS name, state || '::' || county AS region, 'county:' || upper(state) || ':' || lower(county) AS job FROM r""")
def route_keys(spark, sf_dir):
    rows = customer_points(spark, sf_dir).select("state", "county").distinct()
    rows = rows.withColumn("route", C.route_key("/api/labels/counties", [("state", F.col("state")), ("county", F.col("county"))]))
    return rows.select("state", "county", "route", C.route_digest("route").alias("name"), C.region_id("state", "county").alias("region"), C.job_key(F.lit("county"), "state", "county").alias("job"))


@query(f"""WITH {_STATES}, w AS (SELECT DISTINCT state, name, unnest([segment, segment || ' County']) AS county FROM (SELECT state, segment FROM pl UNION ALL SELECT unnest(['LA', 'AK']), segment FROM pl) JOIN st ON code = state)
SELECT state, county, array_to_string([county || ', ' || name || ', United States'] || CASE WHEN county LIKE '% County' THEN [] ELSE [county || ' County, ' || name || ', United States'] END
  || CASE WHEN state = 'LA' AND county NOT LIKE '% County' THEN [county || ' Parish, ' || name || ', United States'] ELSE [] END
  || CASE WHEN state = 'AK' AND county NOT LIKE '% County' THEN [county || ' Borough, ' || name || ', United States', county || ' Census Area, ' || name || ', United States'] ELSE [] END, '|') AS queries FROM w""")
def county_queries(spark, sf_dir):
    places = customer_places(spark, sf_dir)
    more = places.select(F.explode(F.array(F.lit("LA"), F.lit("AK"))).alias("state"), "segment")  # states with names of their own for counties
    rows = places.unionByName(more).join(F.broadcast(S.state_table(spark)), F.col("state") == F.col("code"))  # 52 rows
    named = rows.select("state", "name", F.explode(F.array("segment", F.concat("segment", F.lit(" County")))).alias("county")).distinct()
    return named.select("state", "county", F.array_join(C.county_queries("state", "name", "county"), "|").alias("queries"))


@query(f"""WITH {_view('customers')}, s AS (SELECT DISTINCT state, county FROM p), r AS (SELECT '/api/data?zoom=county&method=pixel&state=' || state || '&county=' || county AS route, state, county FROM s)
SELECT substr(sha1(route), 1, 16) AS name, route, '{{"state":"' || state || '","path":"<data>/' || county || '"}}' AS payload FROM r""")
def route_snapshots(spark, sf_dir):
    rows = customer_points(spark, sf_dir).select("state", "county").distinct()
    route = C.route_key("/api/data", [("zoom", F.lit("county")), ("method", F.lit("pixel")), ("state", F.col("state")), ("county", F.col("county"))])
    rows = rows.select("state", F.concat(F.lit("/home/me/"), "county").alias("path"), route.alias("route"), F.lit("x").alias("cache_path"))
    return store.snapshots(store.sanitized(rows, "/home/me"), "route", F.struct("state", "path"))


@query(f"""WITH {_view('events')}, x AS (SELECT min(lat) AS a, max(lat) AS b FROM p), i AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin)
SELECT bin, round((a + (b - a) * bin / 50 + a + (b - a) * (bin + 1) / 50) / 2, 6) AS centre FROM x, i""")
def density_centres(spark, sf_dir):
    found = density.edges(density.extent(event_points(spark, sf_dir)))
    return found.select(F.posexplode(C.bin_centres(F.col("lat_edges"))).alias("bin", "centre")).withColumn("centre", r6("centre"))


@query(f"WITH {_CURVE_SQL} SELECT scope, percentage, CASE WHEN percentage = 2 THEN n_points + 7 ELSE n_points END AS n_points FROM k")
def curve_available(spark, sf_dir):
    curve = _table_curve(spark, sf_dir)
    partial = curve.where("percentage = 2").withColumn("n_points", F.col("n_points") + 7)
    return curves.available(curve.unionByName(curve.where("percentage = 5").withColumn("percentage", F.lit(31))), partial, "state", "scope").select("scope", "percentage", "n_points")


@query(f"""WITH {_view('events')} SELECT row_pos, abs(lat - b) <= greatest(1e-12 * greatest(abs(lat), abs(b)), 1e-15) AS close, CASE row_pos % 3 WHEN 0 THEN lng ELSE 0 END AS finite
FROM (SELECT *, CASE WHEN row_pos % 2 = 0 THEN lat ELSE lat + 0.001 END AS b FROM p)""")
def number_checks(spark, sf_dir):
    odd = F.when(F.col("row_pos") % 3 == 0, F.col("lng")).when(F.col("row_pos") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    other = F.when(F.col("row_pos") % 2 == 0, F.col("lat")).otherwise(F.col("lat") + 0.001)
    rows = event_points(spark, sf_dir).select("row_pos", "lat", other.alias("b"), odd.alias("c"))
    return rows.select("row_pos", C.is_close("lat", "b").alias("close"), C.finite("c").alias("finite"))


# The flagship ----------------------------------------------------------------------------------------------------------


def _prefix_errors(points: DataFrame, percentage: int = 10) -> DataFrame:
    samples = sampling.fps_prefixes(points, fps_order(points, "state"), [percentage], "state")
    return statistics.compare(points, samples, "state")


@query(f"""WITH RECURSIVE {_FPS}, {_SIZES.format('10')}, sample AS (SELECT p.* FROM p JOIN ranks USING (state, row_pos) JOIN keep USING (state) WHERE fps_rank < n_keep),
a AS (SELECT state, {_RAW} FROM p GROUP BY state), b AS (SELECT state, {_RAW} FROM sample GROUP BY state)
SELECT a.state, a.n AS n_exact, coalesce(b.n, 0) AS n_displayed, {_ERRORS} FROM a LEFT JOIN b USING (state)""")
def fps_compare(spark, sf_dir):
    """Each state's 10 % farthest-point sample against all of its points."""
    return _errors(_prefix_errors(vector_points(spark, sf_dir)), "state")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fps_compare(spark, sf_dir)
