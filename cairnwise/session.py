"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster the session comes from ``spark-submit``; there, leave
    ``spark.sql.shuffle.partitions`` high (a few times the core count) and let
    adaptive execution coalesce.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairnwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of the cluster.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session,
    whose one machine runs everything, may leave it unset and gets a temporary
    folder of this process; on a cluster a missing setting is an error.
    """
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        base = _local_scratch()
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


_LOCAL_SCRATCH: dict[str, str] = {}


def _local_scratch() -> str:
    """This process's own temporary folder, removed when the process ends."""
    if "dir" not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH["dir"] = tempfile.mkdtemp(prefix="cairnwise-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH["dir"], ignore_errors=True)
    return _LOCAL_SCRATCH["dir"]


def materialise(df, label: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps need the same expensive table: the copy
    cuts lineage, survives executor loss, and is scanned column by column.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_dealt(df, label: str, by: str, parts: int):
    """``materialise`` as a table bucketed by a column: joins and groupings by it
    find its rows dealt. ``df`` should be dealt by ``by`` in so many parts already.

    A bucketed table needs a name; it is dropped again at once, its files stay.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name = f"cairnwise_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, by).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored
