import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name."""

    def cell(x):
        if x is None or (isinstance(x, float) and x != x):
            return None
        return f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)

    return sorted((tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    def check(query, sql):
        ours, theirs = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        theirs = theirs.where(theirs.notna(), None)
        ours = ours.where(ours.notna(), None)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert plain(ours) == plain(theirs)

    return check
