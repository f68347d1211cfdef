"""Integrity and completeness audits over all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwise.session import materialise

# Parents before children, and every foreign key (table, column, parent).
ORDER = [
    "countries", "types", "sizes", "attributes", "users", "states", "items", "challenges", "enrolments", "finds",
    "tasks", "snapshots", "targets",
]
REFERENCES = [
    ("items", "country_id", "countries"),
    ("items", "state_id", "states"),
    ("items", "type_id", "types"),
    ("items", "size_id", "sizes"),
    ("items", "attributes.attr_id", "attributes"),
    ("challenges", "item_id", "items"),
    ("finds", "item_id", "items"),
    ("finds", "user_id", "users"),
    ("snapshots", "uc_id", "enrolments"),
    ("states", "country_id", "countries"),
    ("targets", "user_id", "users"),
    ("targets", "uc_id", "enrolments"),
    ("targets", "item_id", "items"),
    ("targets", "primary_task_id", "tasks"),
    ("tasks", "uc_id", "enrolments"),
    ("enrolments", "challenge_id", "challenges"),
    ("enrolments", "user_id", "users"),
]
# Parents whose own rows refer to something, so that an orphan among them makes orphans of its children.
_CASCADING = {parent for _, _, parent in REFERENCES} & {source for source, _, _ in REFERENCES}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _key(df: DataFrame, ref: Column) -> DataFrame:
    """The values of ``ref``, as ``id``: whole numbers as they are, everything else as text."""
    df = df.select(ref.alias("id"))
    return df if isinstance(df.schema["id"].dataType, _WHOLE) else df.select(F.col("id").cast("string").alias("id"))


def _without(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """``rows`` whose value of ``column`` is not among the keys ``ids``; numbers are compared with text as text."""
    whole = [isinstance(df.schema[c].dataType, _WHOLE) for df, c in ((rows, column), (ids, "id"))]
    left, right = (F.col(column), F.col("_key")) if all(whole) else (F.col(column).cast("string"), F.col("_key").cast("string"))
    return rows.join(ids.withColumnRenamed("id", "_key"), left == right, how)


def reference_rows(table: DataFrame, column: str) -> DataFrame:
    """(id, ref) of the rows of a table that refer to something in this column (of an array's structs, if it has a dot)."""
    array, _, field = column.partition(".")
    refs = F.explode(F.transform(array, lambda a: a[field])) if field else F.col(column)
    return table.select(F.col("id"), refs.alias("ref")).where(F.col("ref").isNotNull())


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, id) of rows whose reference leads nowhere.

    A row that was found to be an orphan does not count as a parent any more,
    so whole chains show up. Each table has an ``id`` column. Parents come
    before children: of every parent that refers to something itself, the ids
    that are left are written before its children are looked at. Each reference
    is one anti join of (id, ref) with these; a popular parent's rows are split
    by adaptive execution. Reports of tables that nothing refers to are lazy.
    """
    left, report = {}, None
    for name in ORDER:
        table, found = tables[name], None
        for source, column, parent in REFERENCES:
            if source != name:
                continue
            lost = _without(reference_rows(table, column), "ref", left[parent])
            lost = _key(lost, F.col("id")).distinct().select(F.lit(name).alias("table"), F.lit(column).alias("column"), "id")
            found = lost if found is None else found.unionByName(lost)
        left[name] = _key(table, F.col("id"))
        if found is None:
            continue
        if name in _CASCADING:
            found = materialise(found, "orphans")
            left[name] = materialise(_without(left[name], "id", found.select("id")), "parents")
        found = found.withColumn("id", F.col("id").cast("string"))
        report = found if report is None else report.unionByName(found)
    return report


def orphan_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("table", "column").agg(F.count(F.lit(1)).alias("orphans"))


def clean(tables: dict[str, DataFrame], report: DataFrame, backup: str | None = None) -> dict[str, DataFrame]:
    """Tables without their reported rows, which are first copied to ``backup``."""
    out = {}
    report = materialise(report, "orphan-report")
    for name, df in tables.items():
        ids = report.where(F.col("table") == name).select("id")
        if isinstance(df.schema["id"].dataType, _WHOLE):
            number = F.expr("try_cast(id AS bigint)")
            ids = ids.where(number.cast("string") == F.col("id")).select(number.alias("id"))
        if backup is not None:
            _without(df, "id", ids, "left_semi").write.mode("error").parquet(f"{backup}/{name}")
        out[name] = _without(df, "id", ids)
    return out


def geo_anomalies(items: DataFrame) -> DataFrame:
    """Null patterns of country and state, and how many of the countryless have
    coordinates or a code starting with AL."""
    no_country, no_state = F.col("country_id").isNull(), F.col("state_id").isNull()
    al = F.coalesce(F.col("code").startswith("AL"), F.lit(False))
    return items.groupBy().agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(no_country).alias("null_country"),
        F.count_if(no_state).alias("null_state"),
        F.count_if(no_country & no_state).alias("null_both"),
        F.count_if(no_country & ~no_state).alias("null_country_only"),
        F.count_if(~no_country & no_state).alias("null_state_only"),
        F.count_if(no_country & F.col("lat").isNotNull()).alias("null_country_with_coords"),
        F.count_if(no_country & al).alias("null_country_al"),
        F.count_if(no_country & ~al).alias("null_country_not_al"),
        (F.count_if(no_country & ~al) == 0).alias("hypothesis_confirmed"),
    )


def geo_anomaly_sample(items: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows (by code) without country and without the AL prefix."""
    hit = items.where(F.col("country_id").isNull() & ~F.coalesce(F.col("code").startswith("AL"), F.lit(False)))
    return hit.select("code", "title", "lat", "lon").orderBy("code").limit(rows)


def user_counts(users: DataFrame, finds: DataFrame, enrolments: DataFrame, items: DataFrame, challenges: DataFrame) -> DataFrame:
    """Per user finds, enrolments and enrolments by computed status, beside the
    global numbers of users, items and challenges."""

    def total(df: DataFrame):
        return df.groupBy().agg(F.count(F.lit(1))).scalar()

    found = finds.groupBy("user_id").agg(F.count(F.lit(1)).alias("finds"))
    enrolled = enrolments.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("enrolments"),
        F.count_if(F.col("computed_status") == "completed").alias("completed"),
        F.count_if(F.col("computed_status").isNull()).alias("not_computed"),
    )
    rows = users.select("user_id").join(found, "user_id", "left").join(enrolled, "user_id", "left")
    return rows.fillna(0).withColumns(
        {"all_users": total(users), "all_items": total(items), "all_challenges": total(challenges)}
    )


def import_statistics(users: DataFrame, finds: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """(scope, name, rows): table totals, and each user's number of finds."""
    out = None
    for name, df in dims.items():
        row = df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit("table").alias("scope"), F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    found = users.select("user_id").join(finds.select("user_id", "item_id"), "user_id", "left").groupBy("user_id").agg(F.count("item_id").alias("rows"))
    return out.unionByName(found.select(F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("name"), "rows"))
