"""Draws by digests, without a task that draws."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pointlens.functions.columns import random_seed
from pointlens.operators import sampling
from pointlens.plans.registry import ORACLE_SQL, QUERIES

POINT = "lat double, lng double, state string, county string, row_pos long"


def test_query_is_its_sql(same_as_sql):
    same_as_sql(QUERIES["keyed_sample"], ORACLE_SQL["keyed_sample"])


@pytest.mark.parametrize("bin_rows", [1, 7, 50_000])
@pytest.mark.parametrize("percentage", [3, 50, 100])
def test_smallest_digests_of_each_scope(spark, bin_rows, percentage):
    rows = [(1.0, 2.0, "AB"[i % 3 > 0], "c", i) for i in range(300)] + [(None, 1.0, "A", "c", 900), (1.0, 1.0, "Z", None, 901)]  # many equal points, one without coordinates
    points = spark.createDataFrame(rows, POINT).repartition(3).withColumn("_n", F.lit("clash"))
    found = sampling.keyed_sample(points.drop("_n"), "state", percentage, "state", bin_rows=bin_rows).collect()
    for state, mine in (("A", range(0, 300, 3)), ("B", [i for i in range(300) if i % 3]), ("Z", [901])):
        seed = spark.range(1).select(random_seed(F.lit("state"), F.lit(state), F.lit(""), F.lit(percentage))).first()[0]
        want = sorted(mine, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[: max(1, round(len(mine) * percentage / 100))]
        assert [r.row_pos for r in sorted((r for r in found if r.state == state), key=lambda r: r.draw_rank)] == want
        assert sorted(r.draw_rank for r in found if r.state == state) == list(range(len(want)))


def test_country_and_empty(spark):
    points = spark.createDataFrame([(1.0, 2.0, "A", "c", i) for i in range(40)], POINT)
    assert sampling.keyed_sample(points, "country", 25).count() == 10
    assert sampling.keyed_sample(points.limit(0), "country", 25).count() == 0
    assert sampling.keyed_sample(points.limit(0), "state", 25, "state").count() == 0
