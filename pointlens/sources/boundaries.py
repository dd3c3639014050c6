"""Boundary files: topologies and GeoJSON features as tables of ring points, and the choice among providers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.operators.geometry import RINGS, decode_arcs, fallback_rings, rings_of_features, stitch_rings
from pointlens.sources.shared import checkpoint


def read_topology(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """An object of a TopoJSON file: ring points (region: the geometry's id) and the geometries' names (fips, name).

    The file is one JSON document, so one task parses it; its arcs and geometries are tables from then on.
    """
    geometry = "struct<type: string, id: string, properties: struct<name: string>, arcs: string>"
    schema = f"transform struct<scale: array<double>, translate: array<double>>, arcs array<array<array<bigint>>>, objects struct<`{name}`: struct<geometries: array<{geometry}>>>"
    document = checkpoint(spark.read.schema(schema).option("multiLine", True).json(path))
    move = document.select("transform.*").first()
    steps = document.select(F.posexplode("arcs").alias("arc", "points")).select("arc", F.posexplode("points").alias("pos", "p"))
    steps = steps.select("arc", "pos", F.get("p", F.lit(0)).alias("dx"), F.get("p", F.lit(1)).alias("dy"))
    shapes = document.select(F.explode(f"objects.{name}.geometries").alias("g")).select("g.*")
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("arcs", "array<array<int>>"))).when(F.col("type") == "MultiPolygon", F.from_json("arcs", "array<array<array<int>>>"))
    polys = shapes.select(F.col("id").alias("region"), F.posexplode(polygons).alias("poly", "rings"))
    rings = polys.select("region", "poly", F.posexplode("rings").alias("ring", "parts"))
    uses = rings.select("region", "poly", "ring", F.posexplode("parts").alias("part", "arc"))
    arcs = decode_arcs(steps, tuple(move.scale), tuple(move.translate))
    return stitch_rings(uses, arcs), shapes.select(F.col("id").alias("fips"), F.col("properties.name").alias("name"))


def read_features(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Ring points of a GeoJSON feature file, under the given region's name."""
    schema = "geometry struct<type: string, coordinates: string>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).where("geometry IS NOT NULL")
    return rings_of_features(found.select(F.lit(region).alias("region"), "geometry.type", "geometry.coordinates"))


def best_answer(answers: DataFrame) -> DataFrame:
    """Of a geocoder's answers (pos, osm_type, type, coordinates) the first relation that is a polygon, else the first polygon."""
    shapes = answers.where(F.col("type").isin("Polygon", "MultiPolygon"))
    return shapes.orderBy((F.col("osm_type") == "relation").desc(), "pos").limit(1)


def resolve(providers: Iterable[Callable[[str], DataFrame | None]], region: str, points: DataFrame) -> DataFrame:
    """Ring points of a region from the first provider that knows it, else the padded hull of its points."""
    for provider in providers:
        found = provider(region)
        if found is not None and not found.isEmpty():
            return found.select(*[c.split()[0] for c in RINGS.split(", ")])
    ring = fallback_rings(points).select(F.posexplode("ring").alias("pos", "p"))
    return ring.select(F.lit(region).alias("region"), F.lit(0).alias("poly"), F.lit(0).alias("ring"), "pos", "p.lng", "p.lat")


def table_provider(rings: DataFrame) -> Callable[[str], DataFrame]:
    return lambda region: rings.where(F.col("region") == region)
