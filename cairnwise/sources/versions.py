"""Tables of versioned Parquet folders behind one commit manifest.

A commit writes the new folders of all its tables first, then one small file
that lists the folders of every table. That file appears at once or not at
all, so a run that dies half-way leaves folders nobody reads and the version
before it stays whole. Two runs that commit on the same version cannot both
succeed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, paths array<string>, docs bigint"


class Versions:
    """The tables under ``base``, a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _entries(self, version: int | None) -> list:
        """Rows of the manifest of one version, by default the newest: one per table."""
        if not self._exists():
            return []
        commits = self.spark.read.schema(f"{_ENTRY}, version bigint").parquet(f"{self.base}/commits")
        wanted = F.lit(version) if version is not None else commits.agg(F.max("version")).scalar()
        return commits.where(F.col("version") == wanted).collect()

    def current(self) -> int:
        """The newest version; 0 before the first commit."""
        return max((r["version"] for r in self._entries(None)), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the newest."""
        for r in self._entries(version):
            if r["name"] == name:
                return self.spark.read.parquet(*r["paths"])
        raise ValueError(f"no table {name!r} in version {version if version is not None else 'newest'}")

    def listing(self, version: int | None = None) -> DataFrame:
        """``name, docs, folders, version`` of every table of a version."""
        rows = [(r["name"], r["docs"], len(r["paths"]), r["version"]) for r in self._entries(version)]
        return self.spark.createDataFrame(rows, "name string, docs bigint, folders int, version bigint")

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None) -> int:
        """Publishes new tables, and rows appended to tables, as one version; returns its number.

        Tables that are not named stay as they are. An appended table keeps its
        older folders and gains one.
        """
        before = {r["name"]: (list(r["paths"]), r["docs"], r["version"]) for r in self._entries(None)}
        version = 1 + max((v for _, _, v in before.values()), default=0)
        entries = {name: (paths, docs) for name, (paths, docs, _) in before.items()}
        for name, df in {**replaced, **(appended or {})}.items():
            path, seen = f"{self.base}/{name}/{version}-{uuid.uuid4().hex}", Observation()
            df.observe(seen, F.count(F.lit(1)).alias("docs")).write.parquet(path)
            old, docs = entries.get(name, ([], 0)) if name in (appended or {}) else ([], 0)
            entries[name] = ([*old, path], docs + seen.get["docs"])
        rows = [(name, paths, docs) for name, (paths, docs) in entries.items()]
        manifest = self.spark.createDataFrame(rows, _ENTRY).coalesce(1)
        manifest.write.mode("error").parquet(f"{self.base}/commits/version={version}")
        return version

