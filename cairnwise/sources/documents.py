"""Reference data documents: dimension JSON arrays and zone GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwise.functions.polygons import bounds


def read_referential(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON array files with the stated columns."""
    return spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").schema(schema).json(path)


_FEATURES = (
    "features array<struct<properties:struct<code:string,nom:string>,geometry:struct<type:string,coordinates:string>>>"
)


def read_zones(spark: SparkSession, path: str, country: str, level: int) -> DataFrame:
    """Zone rows of FeatureCollection files: code, name, rings and bounds.

    Features without a code are skipped. Polygons and multi-polygons both end
    up as one ring list.
    """
    collections = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").schema(_FEATURES).json(path)
    f = collections.select(F.explode("features").alias("f")).select(
        F.col("f.properties.code").alias("feature_code"),
        F.coalesce("f.properties.nom", F.lit("")).alias("name"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    ).where(F.coalesce("feature_code", F.lit("")) != "")
    single = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.transform(
        F.when(F.col("kind") == "MultiPolygon", multi).otherwise(single),
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )
    placed = f.withColumn("rings", rings)
    return placed.select(
        F.concat_ws("-", F.lit(country), "feature_code").alias("code"), F.lit(level).alias("level"), "name",
        F.lit(country).alias("country"), F.lit(None).cast("string").alias("parent_code"), "rings",
        *[v.alias(k) for k, v in bounds(F.col("rings")).items()],
    )
