"""What has to be built again when points change."""

import pytest
from pyspark.sql import functions as F

from pointlens.operators.scope import Scope
from pointlens.plans.engine import Engine
from pointlens.sources.store import read_or_empty


@pytest.fixture
def points(spark):
    rows = [(f"A-{i}", (i * 37 % 23) / 7, (i * 53 % 29) / 5, "ST"[i % 2], "C", i) for i in range(24)]
    return spark.createDataFrame(rows, "id string, lat double, lng double, state string, county string, row_pos long")


def test_only_changed_scopes_are_built_again(spark, points, tmp_path):
    engine = Engine(points, str(tmp_path))
    scopes = [Scope(), Scope("state", "S"), Scope("state", "T"), Scope("county", "T", "C")]
    assert {r.change for r in engine.changes().collect()} == {"new"}
    for scope in scopes:
        engine.build(scope, 2)
    assert engine.refresh() == []
    found = {(r.zoom, r.state, r.county): r.change for r in engine.changes().collect()}
    assert found == {("country", "", ""): "same", ("state", "S", ""): "same", ("state", "T", ""): "same", ("county", "T", "C"): "same", ("county", "S", "C"): "new"}
    written = lambda: {(r.zoom, r.state): r["count"] for r in read_or_empty(spark, f"{tmp_path}/curves_manifest", "zoom string, state string").groupBy("zoom", "state").count().collect()}
    before = written()
    moved = Engine(points.withColumn("lat", F.when(F.col("row_pos") == 4, 9.5).otherwise(F.col("lat"))), str(tmp_path))  # a point of S
    assert moved.refresh() == [Scope(), Scope("state", "S")]
    after = written()
    assert {k: after[k] - before[k] for k in after} == {("country", ""): 1, ("state", "S"): 1, ("state", "T"): 0, ("county", "T"): 0}
    assert moved.refresh() == [] and moved.status(Scope("state", "S")).first().row_count == 2
    left = Engine(points.where("state = 'S'"), str(tmp_path)).changes().where("change = 'gone'").collect()
    assert {(r.zoom, r.state) for r in left} == {("state", "T"), ("county", "T")}
