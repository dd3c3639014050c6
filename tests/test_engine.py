import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlens.functions import columns as C
from pointlens.operators import curves, geometry, pixels, sampling, topology
from pointlens.operators import fps
from pointlens.operators.pixels import Viewport
from pointlens.operators.spanning import spanning_tree
from pointlens.operators.scope import Scope, county_labels, in_scope, method_coverage
from pointlens.plans.engine import Engine, MissingCurve
from pointlens.plans.registry import ORACLE_SQL, QUERIES, event_points, vector_points
from pointlens.sources import points as P
from pointlens.sources import boundaries, store
from pointlens.streaming import refresh

POINT = "id string, lat double, lng double, state string, county string, row_pos long"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def slow_fps(points):
    points = np.asarray(points, float)
    centre = points.mean(axis=0)
    order = [max(range(len(points)), key=lambda i: (((points[i] - centre) ** 2).sum(), -i))]
    while len(order) < len(points):
        d = [min(((points[i] - points[j]) ** 2).sum() for j in order) if i not in order else -1.0 for i in range(len(points))]
        order.append(max(range(len(points)), key=lambda i: (d[i], -i)))
    return order


def cloud(spark, n, seed=0, whole=False):
    rng = random.Random(seed)
    at = (lambda: float(rng.randrange(12))) if whole else rng.random
    rows = [(f"A-{i}", at(), at(), "S", "C", i) for i in range(n)]
    return spark.createDataFrame(rows, POINT).repartition(3), np.array([r[1:3] for r in rows])


@pytest.mark.parametrize("whole", [False, True])
def test_fps_order_by_one_task_and_by_all(spark, whole):
    points, array = cloud(spark, 70, 1, whole)
    want = slow_fps(array)
    small = [r.row_pos for r in fps.fps_order(points, "state").orderBy("fps_rank").collect()]
    large = [r.row_pos for r in fps.fps_order(points, "state", task_rows=10).orderBy("fps_rank").collect()]
    few = [r.row_pos for r in fps.order_distributed(points, 70, candidates=4).orderBy("fps_rank").collect()]
    assert small == large == few == want


def test_fps_order_raises_at_its_limit(spark, monkeypatch):
    monkeypatch.setattr(fps, "FINISH_ROWS", 0)
    points, _ = cloud(spark, 70, 1)
    with pytest.raises(RuntimeError, match="of 70 points"):
        fps.order_distributed(points, 70, candidates=1, most_rounds=3)
    assert fps.order_distributed(points, 3, candidates=1, most_rounds=3).count() == 3


def test_fps_order_of_a_hot_coordinate(spark):
    """A third of the rows at one place take no round each."""
    points, array = cloud(spark, 40, 4)
    rows = [(f"A-{i}", *array[i % 40 if i < 40 else 7].tolist(), "S", "C", i) for i in range(160)]
    hot = spark.createDataFrame(rows, POINT).repartition(3)
    found = [r.row_pos for r in fps.order_distributed(hot, 160, candidates=8, most_rounds=60).orderBy("fps_rank").collect()]
    assert found == slow_fps([r[1:3] for r in rows])
    assert found == [r.row_pos for r in fps.fps_order(hot, "state", task_rows=100, steps_col=None).orderBy("fps_rank").collect()]


def test_fps_order_above_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(fps, "TASK_ROWS", 50)
    points, array = cloud(spark, 90, 6)
    assert [r.row_pos for r in fps.fps_order(points, "state", task_rows=fps.TASK_ROWS).orderBy("fps_rank").collect()] == slow_fps(array)


def test_fps_prefixes_are_nested(spark, sf_dir):
    rows = QUERIES["fps_samples"](spark, sf_dir).collect()
    for state in {r.state for r in rows}:
        sets = [{r.row_pos for r in rows if r.state == state and r.percentage == p} for p in (1, 5, 10, 20, 50, 100)]
        assert all(a <= b for a, b in zip(sets, sets[1:])) and all(sets)


def test_retain_sizes_round_half_to_even(spark):
    cases = {(59619, 1): 596, (716, 5): 36, (716, 10): 72, (716, 20): 143, (250, 1): 2, (350, 1): 4, (3, 1): 1}
    rows = spark.createDataFrame([(n, p) for n, p in cases], "n long, p int").select("n", "p", C.n_keep("n", "p").alias("k")).collect()
    assert {(r.n, r.p): r.k for r in rows} == cases


def test_random_draws(spark):
    seeds = spark.createDataFrame([("AZ", 3), ("UT", 3)], "s string, p int").select("s", C.random_seed(F.lit("state"), F.col("s"), F.lit(""), F.col("p")).alias("seed")).collect()
    seed = {r.s: r.seed for r in seeds}
    assert seed["AZ"] == 1076615311
    assert sampling.draw(429, 13, seed["AZ"])[:5].tolist() == [250, 90, 322, 40, 356]
    assert sampling.draw(132, 4, seed["UT"]).tolist() == [14, 79, 2, 107]
    points = spark.createDataFrame([(f"A-{i}", 30.0 + i, -100.0, "AZ", "c", 10 * i) for i in range(429)], POINT).repartition(5)
    drawn = sampling.random_sample(points, "state", 3, "state").orderBy("draw_rank").collect()
    assert [r.row_pos // 10 for r in drawn[:5]] == [250, 90, 322, 40, 356] and len(drawn) == 13


def test_thinning_by_one_task_and_by_all(spark):
    for whole in (False, True):
        points, array = cloud(spark, 150, 2, whole)
        t = 3.0 if whole else 0.15
        kept = []
        for i, p in enumerate(array):
            if all(((p - array[j]) ** 2).sum() >= t * t - max(1e-15, t * t * 1e-12) for j in kept):
                kept.append(i)
        run = lambda **k: sorted(r.row_pos for r in pixels.thin(points, t, "state", x="lat", y="lng", **k).collect())
        assert run() == run(task_rows=5) == kept


def test_min_distance(spark):
    for n in (0, 1, 2, 60, 400):
        points, array = cloud(spark, n, n + 1)
        d = [np.hypot(*(a - b)) for i, a in enumerate(array) for b in array[:i]]
        assert pixels.min_distance(points, "lat", "lng") == pytest.approx(min(d, default=0.0))
    crowd = spark.createDataFrame([(1e-3 * i, 0.0) for i in range(200)] + [(50.0, 80.0)], "x double, y double")
    assert pixels.min_distance(crowd, "x", "y") == pytest.approx(1e-3)
    assert pixels.min_distance(crowd.union(crowd), "x", "y") == 0.0


def test_viewports_and_spacing():
    assert Viewport.parse("1248.4", 895.6, "28,28,28,28") == Viewport() and Viewport.parse(0, 5) is None and Viewport.parse("x", 5) is None
    assert Viewport.parse(0.2, 5, [1, 2]) == Viewport(1, 5, (28,) * 4) and Viewport().profile == "w1248_h896_p28-28-28-28"
    assert pixels.marker_spacing("country") == 7.0 and pixels.marker_spacing("county") == 9.0


def test_diagrams_of_known_samples():
    triangle = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 3.0]])
    assert topology.h0_deaths(triangle).tolist() == [2.25, 4.0]
    assert topology.h1_pairs(triangle).tolist() == []  # the right angle's loop closes at once
    square = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])
    assert topology.h1_pairs(square).tolist() == [[1.0, 2.0]]
    ring = np.array([[np.cos(a), np.sin(a)] for a in np.arange(12) * np.pi / 6 + 0.1])
    (birth, death), = topology.h1_pairs(ring)
    assert birth == pytest.approx((2 * np.sin(np.pi / 12)) ** 2 / 4) and death == pytest.approx(1.0)
    assert len(topology.h1_pairs(np.vstack([ring, ring]))) == 1
    line = np.array([[float(i), 2.0 * i] for i in range(6)])
    assert topology.h1_pairs(line).shape == (0, 2) and len(topology.h0_deaths(line)) == 5


@pytest.mark.parametrize("tile_rows", [12, 60, 1000])
def test_spanning_tree_by_all_tasks(spark, tile_rows):
    rng = np.random.default_rng(7)
    for p in (rng.random((150, 2)), np.vstack([rng.random((60, 2)), rng.random((60, 2)) + 50, [[300.0, 300.0]]]), rng.integers(0, 8, (90, 2)).astype(float), np.ones((5, 2))):
        points = spark.createDataFrame([tuple(map(float, q)) for q in p], "lat double, lng double").repartition(3)
        found = sorted(r.d2 / 4 for r in spanning_tree(points, tile_rows).collect())
        assert found == pytest.approx(topology.h0_deaths(p).tolist())


def test_diagrams_of_large_groups(spark, sf_dir):
    points = vector_points(spark, sf_dir)
    order = lambda df: sorted((r.state, r.n_points, [tuple(x) for x in r.h0], [tuple(x) for x in r.h1]) for r in df.collect())
    some = points.where("state IN ('1', '2')")
    by_one, by_all = order(topology.diagrams(some, "state")), order(topology.diagrams(some, "state", task_rows=20))
    assert len(by_one) == 2
    for a, b in zip(by_one, by_all):
        assert a[:2] == b[:2] and a[3] == b[3] and np.allclose(a[2], b[2])


def test_triangulations_are_delaunay():
    rng = np.random.default_rng(2)
    for n in (4, 9, 40):
        for p in (rng.random((n, 2)), np.unique(rng.integers(0, 6, (n, 2)).astype(float), axis=0)):
            for t in topology.delaunay(p):
                a, b, c = (tuple(p[i]) for i in t)
                if topology.orientation(a, b, c) < 0:
                    b, c = c, b
                assert all(topology.in_circle(a, b, c, tuple(q)) <= 0 for q in p)


def test_diagram_distances():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (np.sort(rng.random((rng.integers(0, 4), 2)), axis=1) for _ in "ab")
        n, m = len(a), len(b)
        cost = np.zeros((n + m, n + m))  # points and places on the diagonal
        cost[:n, :m] = [[np.abs(x - y).max() for y in b] for x in a] if m and n else 0
        cost[:n, m:], cost[n:, :m] = ((a[:, 1] - a[:, 0]) / 2)[:, None], (b[:, 1] - b[:, 0]) / 2
        each = [[cost[i, j] for i, j in enumerate(q)] for q in itertools.permutations(range(len(cost)))]
        assert topology.bottleneck(a, b) == pytest.approx(min(max(x, default=0.0) for x in each))
        assert topology.wasserstein(a, b) == pytest.approx(min(sum(x) for x in each))
        a0, b0 = (np.column_stack([np.zeros(len(x)), x[:, 1]]) for x in (a, b))
        found = topology.diagram_distances(a0, a, b0, b)
        assert found["bottleneck_h0"] == pytest.approx(topology.bottleneck(a0, b0)) and found["wasserstein_h0"] == pytest.approx(topology.wasserstein(a0, b0))
        assert found["bottleneck_h1"] <= found["wasserstein_h1"] + 1e-12


def test_curve_ends_at_zero(spark, sf_dir):
    rows = QUERIES["error_curve"](spark, sf_dir).collect()
    assert all(r[m] == 0 for r in rows if r.percentage == 100 for m in topology.METRICS)
    assert all(r.bottleneck_h0 <= r.wasserstein_h0 + 1e-12 for r in rows)


def test_registered_curves_have_all_percentages(spark, sf_dir):
    found = {}
    for r in QUERIES["error_curve"](spark, sf_dir).select("state", "percentage").collect():
        found.setdefault(r.state, []).append(r.percentage)
    assert found and all(sorted(p) == sampling.configured("state") for p in found.values())


def test_selection_takes_the_first_row_within(spark):
    rows = [(2, 5, 1.0), (5, 9, 0.4), (10, 20, 0.9), (20, 40, 0.2)]
    curve = spark.createDataFrame([(p, n, v, 0.0, v, 0.0) for p, n, v in rows], "percentage int, n_points int, " + ", ".join(f"{m} double" for m in topology.METRICS))
    normal = curves.normalize(curve, curves.baseline_row(curve, 2, "state"))
    pick = lambda t: curves.select_by_threshold(normal, t).select("percentage", "within").first()
    assert tuple(pick(0.5)) == (5, True) and tuple(pick(0.3)) == (20, True) and tuple(pick(0.0)) == (20, False)
    assert curves.select_by_threshold(normal.limit(0), 0.5).collect() == []
    assert curves.select_by_distance_baseline(normal, 0.5).first().percentage == 5


def test_hulls_by_property(spark, sf_dir):
    rows, points = QUERIES["convex_hull"](spark, sf_dir).orderBy("state", "corner").collect(), vector_points(spark, sf_dir).collect()
    for state in {r.state for r in rows}:
        ring = [(r.lng, r.lat) for r in rows if r.state == state]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            assert all((bx - ax) * (p.lat - ay) - (by - ay) * (p.lng - ax) >= -1e-12 for p in points if p.state == state)


def test_features_and_boundaries(spark, tmp_path):
    outer = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    hole = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
    features = spark.createDataFrame([("a", "Polygon", json.dumps([outer, hole])), ("b", "MultiPolygon", json.dumps([[hole], [[[20.0, 20.0], [22.0, 20.0], [21.0, 22.0]]]])), ("c", "Point", "[1, 2]")], "region string, type string, coordinates string")
    edges = geometry.edges_of_rings(geometry.rings_of_features(features))
    points = spark.createDataFrame([("1", 5.0, 5.0, 1), ("2", 1.0, 1.0, 2), ("3", 21.0, 21.0, 3), ("4", None, 1.0, 4)], "id string, lat double, lng double, row_pos long")
    assert {(r.row_pos, r.region) for r in geometry.containment(points, edges).collect()} == {(1, "b"), (2, "a"), (3, "b")}
    assert geometry.inside(points, edges, "a").count() == 1 and geometry.inside(points, edges, "c").count() == 4
    assert geometry.empty_ring(spark).first().ring[0].lng == pytest.approx(-124 - 58 * 0.08)


def test_topologies_providers_and_clipping(spark, tmp_path):
    arcs = [[[0, 0], [4, 0], [0, 4]], [[4, 4], [-4, 0], [0, -4]], [[4, 0], [4, 0], [0, 4], [-4, 0]]]
    shapes = [{"type": "Polygon", "id": "01001", "properties": {"name": "West"}, "arcs": [[0, 1]]}, {"type": "MultiPolygon", "id": "01003", "properties": {"name": "East"}, "arcs": [[[2, -1]]]}]
    shapes[1]["arcs"] = [[[2]]]
    (tmp_path / "t.json").write_text(json.dumps({"type": "Topology", "transform": {"scale": [0.5, 0.25], "translate": [-100, 30]}, "objects": {"counties": {"type": "GeometryCollection", "geometries": shapes}}, "arcs": arcs}))
    rings, names = boundaries.read_topology(spark, str(tmp_path / "t.json"), "counties")
    found = {r.region: [(x.lng, x.lat) for x in sorted(rings.where(F.col("region") == r.region).collect(), key=lambda x: x.pos)] for r in rings.select("region").distinct().collect()}
    assert found["01001"] == [(-100, 30), (-98, 30), (-98, 31), (-100, 31), (-100, 30)]
    assert found["01003"] == [(-98, 30), (-96, 30), (-96, 31), (-98, 31), (-98, 30)]
    assert {(r.fips, r.name) for r in names.collect()} == {("01001", "West"), ("01003", "East")}
    points = spark.createDataFrame([("1", 30.5, -99.0, "AL", "West", 1), ("2", 30.5, -97.0, "AL", "West", 2), ("3", 30.6, -98.5, "AL", "West", 3)], POINT)
    west = rings.where("region = '01001'").withColumn("region", F.lit("AL::West"))
    clipped, scope = Engine(points, str(tmp_path / "s"), providers=(lambda region: None, boundaries.table_provider(west))), Scope("county", "AL", "West")
    assert sorted(r.row_pos for r in clipped.sample(scope, "all").collect()) == [1, 3] and clipped.boundary(scope).count() == 5
    plain = Engine(points, str(tmp_path / "s"))
    assert plain.sample(scope, "all").count() == 3 and plain.boundary(scope).count() == 4  # the padded triangle, closed
    answers = spark.createDataFrame([(0, "node", "Point"), (1, "way", "Polygon"), (2, "relation", "MultiPolygon")], "pos int, osm_type string, type string")
    assert boundaries.best_answer(answers).first().pos == 2 and boundaries.best_answer(answers.where("pos < 2")).first().pos == 1
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}))
    assert boundaries.read_features(spark, str(tmp_path / "f.geojson"), "x").count() == 4


def test_coverage_by_method(spark):
    rows = [("country", "", ""), ("state", "UT", ""), ("county", "UT", "b"), ("county", "UT", "a"), ("state", "NE", "")]
    found = {r.method: r for r in method_coverage(spark.createDataFrame(rows, "zoom string, state string, county string")).collect()}
    assert set(found) == {"all", "pixel", "random", "fps_threshold"} and found["all"].states == ["NE", "UT"] and found["all"].counties == {"NE": [], "UT": ["a", "b"]}
    assert found["random"].retain_percentages == [3, 4, 26, 50] and found["all"].retain_percentages is None


def test_reading_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,Start_Lat,Start_Lng,State,County,City,Extra\nA-2,40.5,-100.25,NE,Lincoln,X,1\nA-1,,-100.0,NE,Lincoln,Y,2\n")
    points = P.with_row_pos(P.read_points(spark, str(tmp_path / "p.csv")))
    assert points.columns == ["id", "lat", "lng", "state", "county", "city", "row_pos"]
    assert [(r.id, r.row_pos) for r in points.orderBy("row_pos").collect()] == [("A-1", 0), ("A-2", 1)] and P.with_coordinates(points).count() == 1
    with pytest.raises(KeyError):
        P.trim_sample(points.drop("lat"))
    files = P.file_signature(spark.read.csv(str(tmp_path / "p.csv"))).first()
    assert files.size_bytes == (tmp_path / "p.csv").stat().st_size


def test_row_positions_are_dense_over_many_partitions(spark):
    rows = P.with_row_pos(spark.range(1000).selectExpr("cast(id * 7919 % 1000 AS string) AS id").repartition(9), "id").collect()
    assert [r.row_pos for r in sorted(rows, key=lambda r: r.id)] == list(range(1000))


def test_tolerant_reading(spark, tmp_path):
    assert store.read_or_empty(spark, str(tmp_path / "none"), "a int").collect() == []
    (tmp_path / "bad.json").write_text('{"a": ')
    (tmp_path / "good.json").write_text('{"a": 3}')
    for name, value in (("bad", 7), ("good", 3), ("none", 7)):
        assert store.read_json_or_default(spark, str(tmp_path / f"{name}.json"), "a int", {"a": 7}).first().a == value


def test_engine_end_to_end(spark, sf_dir, tmp_path):
    points = vector_points(spark, sf_dir).where("state IN ('3', '4')")
    engine, state = Engine(points, str(tmp_path / "store")), Scope("state", "3")
    n = in_scope(points, state).count()
    with pytest.raises(MissingCurve):
        engine.sample(state, "fps_threshold")
    assert not engine.status(state).first().available
    engine.build(state, most=30)
    status = engine.status(state).first()
    assert status.available and not status.complete and status.row_count == 30 and status.exact_count == n
    written = store.read_or_empty(spark, f"{tmp_path}/store/curves_manifest", "zoom string").count()
    engine.build(state, most=30)  # nothing changed, nothing is written
    assert store.read_or_empty(spark, f"{tmp_path}/store/curves_manifest", "zoom string").count() == written
    chosen = engine.selection(state, 0.5, 1).first()
    assert engine.sample(state, "fps_threshold", threshold=0.5, baseline_key=1).count() == chosen.n_points
    assert engine.sample(state, "fps_threshold", threshold=0.5, baseline_key="country_1pct_distance").count() >= 1
    assert engine.sample(state, "all").count() == n and 1 <= engine.sample(state, "pixel").count() <= n
    assert engine.sample(state, "random", retain=26).count() == max(1, round(n * 0.26))
    assert engine.analyze(state, "random", "statistical", retain=50).first().n_exact == n
    assert engine.analyze(state, "all", "topological").first().bottleneck_h0 == 0
    assert engine.analyze(state, "all", "density").agg(F.max(F.abs("difference"))).first()[0] == 0
    assert [r.state for r in engine.meta().collect()] == ["3"] and engine.labels("3").count() == 4
    with pytest.raises(ValueError):
        engine.sample(state, "best")
    routes = engine.routes()
    assert routes.count() == (1 + 2 + 8) * (2 + 4 + 12) and routes.select("route").distinct().count() == routes.count()
    engine.export(str(tmp_path / "out"), routes.where("zoom = 'country'").select("route", "method"))
    assert len(list((tmp_path / "out/api").glob("name=*"))) == 18
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        engine.export(str(tmp_path / "out"), routes.select("route", "method"))


def test_curves_grow_and_orders_and_diagrams_are_kept(spark, sf_dir, tmp_path, monkeypatch):
    from pointlens.plans import engine as facade

    points, state = vector_points(spark, sf_dir).where("state IN ('3', '4')"), Scope("state", "3")
    engine = Engine(points, str(tmp_path / "store"))
    asked = []
    computed = curves.error_curve
    monkeypatch.setattr(facade.curves, "error_curve", lambda *a, **k: asked.append(k["percentages"]) or computed(*a, **k))
    assert engine.ensure(state, 3).count() == 3 and engine.ensure(state, 5).count() == 5
    assert asked == [[1, 2, 3], [4, 5]]  # what is there is not computed again
    engine.build(state)
    assert engine.status(state).first().complete
    assert engine.ensure(state, 30).count() == 30 and len(sum(asked, [])) == len(set(sum(asked, [])))  # in batches, none twice
    whole = computed(in_scope(points, state), "state", percentages=[2, 5, 100]).orderBy("percentage").collect()
    kept = engine.ensure(state).where("percentage IN (2, 5, 100)").orderBy("percentage").collect()
    assert [(r.percentage, r.n_points, r.bottleneck_h0) for r in kept] == [(r.percentage, r.n_points, r.bottleneck_h0) for r in whole]
    monkeypatch.setattr(facade, "fps_order", None)  # the kept order serves samples
    row = engine.analyze(state, "fps_threshold", "topological", threshold=0.5, baseline_key=5).first()
    assert row.current.bottleneck_h0 == row.bottleneck_h0 and row.baseline.bottleneck_h0 == kept[1].bottleneck_h0
    assert row.normalized.bottleneck_h0 == pytest.approx(row.current.bottleneck_h0 / row.baseline.bottleneck_h0)
    changed = Engine(points.where("row_pos > 10"), str(tmp_path / "store"))
    assert not changed._is_valid(state, "orders") and not changed._is_valid(state, "curves")


def test_sanitized_payloads(spark):
    rows = spark.createDataFrame([("/home/me/x/a.csv", "/home/me/x", 1)], "sample_path string, cache_path string, n int")
    assert [tuple(r) for r in store.sanitized(rows, "/home/me").collect()] == [("<data>/x/a.csv", 1)]


def test_stream_refresh(spark, sf_dir, tmp_path):
    points = event_points(spark, sf_dir)
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.refresh(stream, str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
    found = {(r.state, r.county): (r.n, r.lat) for r in refresh.current_counts(spark.read.parquet(str(tmp_path / "counts"))).where("zoom = 'county'").collect()}
    labels = {(r.state, r.county): (r.n, pytest.approx(r.lat)) for r in county_labels(points, 1).collect()}
    assert found == labels


def test_samples_by_scope(spark, tmp_path):
    rows = [("country", "", "", 1, "a"), ("state", "UT", "", 1, "b"), ("state", "UT", "", 2, "c"), ("county", "UT", "x", 1, "d")]
    store.write_samples(spark.createDataFrame(rows, "zoom string, state string, county string, percentage int, id string"), str(tmp_path / "s"))
    pick = lambda *a, **k: sorted(r.id for r in store.read_samples(spark, str(tmp_path / "s"), *a, **k).collect())
    assert pick("country") == ["a"] and pick("state", "UT") == ["b", "c"] and pick("state", "UT", percentage=2) == ["c"] and pick("county", "UT", "x") == ["d"]
