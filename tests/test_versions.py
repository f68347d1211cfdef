"""Commits over several tables: what a run that dies half-way leaves behind."""

import pytest
from pyspark.sql import functions as F

from cairnwise.session import scratch_path
from cairnwise.sources.versions import Versions


@pytest.fixture
def tables(spark):
    return Versions(spark, scratch_path(spark, "versions"))


def test_versions_are_kept_and_appended(spark, tables):
    assert tables.current() == 0
    with pytest.raises(ValueError):
        tables.read("a")
    assert tables.commit({"a": spark.range(5), "b": spark.range(2)}, {"log": spark.range(1)}) == 1
    assert tables.commit({"a": spark.range(7)}, {"log": spark.range(10, 13)}) == 2
    assert (tables.read("a").count(), tables.read("b").count(), tables.read("a", 1).count()) == (7, 2, 5)
    assert sorted(r.id for r in tables.read("log").collect()) == [0, 10, 11, 12]
    assert {r["name"]: (r["docs"], r["folders"]) for r in tables.listing().collect()} == {"a": (7, 1), "b": (2, 1), "log": (4, 2)}


def test_a_dead_run_changes_nothing(spark, tables):
    tables.commit({"a": spark.range(5), "b": spark.range(2)})
    broken = spark.range(9).withColumn("id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"a": spark.range(8), "b": broken})
    assert (tables.current(), tables.read("a").count(), tables.read("b").count()) == (1, 5, 2)
    assert tables.commit({"a": spark.range(8)}) == 2


def test_two_runs_cannot_commit_the_same_version(spark, tables):
    tables.commit({"a": spark.range(1)})
    entries = tables._entries(None)

    class Stale(Versions):
        def _entries(self, version):
            return entries

    tables.commit({"a": spark.range(2)})
    with pytest.raises(Exception, match="(?i)exists"):
        Stale(spark, tables.base).commit({"a": spark.range(3)})
    assert tables.read("a").count() == 2


def test_empty_tables_and_empty_appends(spark, tables):
    tables.commit({"a": spark.range(0)}, {"log": spark.range(0)})
    tables.commit({}, {"log": spark.range(0)})
    assert (tables.read("a").count(), tables.read("log").count(), tables.current()) == (0, 0, 2)
