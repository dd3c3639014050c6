"""The states of the map and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlens.functions.columns import normalize_county

#: FIPS code, postal code and name of each state, in the order of the FIPS codes.
ROWS = [
    ("01", "AL", "Alabama"), ("02", "AK", "Alaska"), ("04", "AZ", "Arizona"), ("05", "AR", "Arkansas"),
    ("06", "CA", "California"), ("08", "CO", "Colorado"), ("09", "CT", "Connecticut"), ("10", "DE", "Delaware"),
    ("11", "DC", "District of Columbia"), ("12", "FL", "Florida"), ("13", "GA", "Georgia"), ("15", "HI", "Hawaii"),
    ("16", "ID", "Idaho"), ("17", "IL", "Illinois"), ("18", "IN", "Indiana"), ("19", "IA", "Iowa"),
    ("20", "KS", "Kansas"), ("21", "KY", "Kentucky"), ("22", "LA", "Louisiana"), ("23", "ME", "Maine"),
    ("24", "MD", "Maryland"), ("25", "MA", "Massachusetts"), ("26", "MI", "Michigan"), ("27", "MN", "Minnesota"),
    ("28", "MS", "Mississippi"), ("29", "MO", "Missouri"), ("30", "MT", "Montana"), ("31", "NE", "Nebraska"),
    ("32", "NV", "Nevada"), ("33", "NH", "New Hampshire"), ("34", "NJ", "New Jersey"), ("35", "NM", "New Mexico"),
    ("36", "NY", "New York"), ("37", "NC", "North Carolina"), ("38", "ND", "North Dakota"), ("39", "OH", "Ohio"),
    ("40", "OK", "Oklahoma"), ("41", "OR", "Oregon"), ("42", "PA", "Pennsylvania"), ("44", "RI", "Rhode Island"),
    ("45", "SC", "South Carolina"), ("46", "SD", "South Dakota"), ("47", "TN", "Tennessee"), ("48", "TX", "Texas"),
    ("49", "UT", "Utah"), ("50", "VT", "Vermont"), ("51", "VA", "Virginia"), ("53", "WA", "Washington"),
    ("54", "WV", "West Virginia"), ("55", "WI", "Wisconsin"), ("56", "WY", "Wyoming"), ("72", "PR", "Puerto Rico"),
]


def state_table(spark: SparkSession) -> DataFrame:
    """fips, code, name: 52 rows."""
    return spark.createDataFrame(ROWS, "fips string, code string, name string")


def available_states(spark: SparkSession, codes: DataFrame | None = None, column: str = "state") -> DataFrame:
    """The state table in FIPS order, only states among the given codes (all without)."""
    table = state_table(spark)
    return (table if codes is None else table.join(codes.select(F.col(column).alias("code")).distinct(), "code", "left_semi")).select("fips", "code", "name").orderBy("fips")


def match_counties(wanted: DataFrame, atlas: DataFrame) -> DataFrame:
    """For each wanted (state, county), the first atlas county (fips, name) of that state with the same normalised name."""
    named = F.broadcast(state_table(wanted.sparkSession).select(F.col("code").alias("state"), F.col("fips").alias("_state_fips")))  # 52 rows
    left = wanted.join(named, "state").withColumn("_key", normalize_county("county"))
    right = atlas.select(F.lpad("fips", 5, "0").alias("fips"), "name", normalize_county("name").alias("_key")).withColumn("_state_fips", F.substring("fips", 1, 2))
    first = F.row_number().over(Window.partitionBy("state", "county").orderBy("fips"))
    return left.join(right, ["_state_fips", "_key"]).withColumn("_n", first).where("_n = 1").select("state", "county", "fips", "name")


def counties_by_state(atlas: DataFrame) -> DataFrame:
    """state_fips, counties (ascending) of an atlas (fips, name)."""
    full = F.lpad("fips", 5, "0")
    return atlas.groupBy(F.substring(full, 1, 2).alias("state_fips")).agg(F.sort_array(F.collect_list(full)).alias("counties"))
