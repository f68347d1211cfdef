"""Dumping all tables into one dated snapshot, listing and restoring snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "snapshot string, table string, docs bigint"


def write_snapshot(tables: dict[str, DataFrame], base: str, stamp: str) -> DataFrame:
    """Writes each table once and returns the manifest (snapshot, table, docs).

    Counts come from the files just written, so they say what can be restored.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        path = f"{base}/snapshot={stamp}/{name}"
        df.write.mode("error").parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        row = stored.groupBy().agg(F.count(F.lit(1)).alias("docs")).select(
            F.lit(stamp).alias("snapshot"), F.lit(name).alias("table"), "docs"
        )
        counts = row if counts is None else counts.unionByName(row)
    counts.write.mode("append").parquet(f"{base}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{base}/manifest").where(F.col("snapshot") == stamp)


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Snapshots with their number of tables and rows, newest first."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{base}/manifest")
    return manifest.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("docs").alias("docs")
    ).orderBy(F.desc("snapshot"))


def restore_counts(spark: SparkSession, base: str, stamp: str) -> DataFrame:
    """Dry run: what a restore would bring back, from the manifest alone."""
    return spark.read.schema(_MANIFEST).parquet(f"{base}/manifest").where(F.col("snapshot") == stamp).select("table", "docs")


def restore_table(current: DataFrame, base: str, stamp: str, name: str, key: list[str], drop_existing: bool = False) -> DataFrame:
    """The table after a restore: the snapshot alone, or the current rows plus
    the snapshot rows whose key is not there."""
    stored = current.sparkSession.read.schema(current.schema).parquet(f"{base}/snapshot={stamp}/{name}")
    return stored if drop_existing else current.unionByName(stored.join(current.select(*key), key, "left_anti"))
