"""User statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_stats(users: DataFrame, finds: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Find and challenge totals per user; last activity is the later of the
    last find and the last created enrolment."""
    found = finds.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_finds"),
        F.min("found_date").alias("first_find"),
        F.max("found_date").alias("last_find"),
    )
    completed = (F.col("status") == "completed") | (F.col("computed_status") == "completed")
    enrolled = enrolments.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_challenges"),
        F.count_if(F.col("status") == "accepted").alias("active_challenges"),
        F.count_if(F.coalesce(completed, F.lit(False))).alias("completed_challenges"),
        F.max("created_at").alias("last_enrolment"),
    )
    counts = ["total_finds", "total_challenges", "active_challenges", "completed_challenges"]
    return (
        users.select("user_id", "username", "created_at")
        .join(found, "user_id", "left")
        .join(enrolled, "user_id", "left")
        .fillna(0, subset=counts)
        .select(
            "user_id", "username", "created_at", *counts, "first_find", "last_find",
            F.greatest("last_find", "last_enrolment").alias("last_activity"),
        )
    )


def user_type_stats(finds: DataFrame, items: DataFrame, types: DataFrame) -> DataFrame:
    """Finds per user and type with zero rows for the other types.

    ``position`` orders found types by falling count, then the zeros by code.
    Users without a find of a known type have no rows. The type list is a
    small dimension and is folded into one array, so no pair of tables is
    multiplied out.
    """
    counts = (
        finds.join(items.select("item_id", "type_code"), "item_id")
        .join(types.select("type_code"), "type_code", "left_semi")
        .groupBy("user_id", "type_code")
        .agg(F.count(F.lit(1)).alias("finds"))
    )
    per_user = counts.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("type_code", "finds"))).alias("by_type")
    )
    all_types = types.groupBy().agg(F.collect_list("type_code").alias("codes")).scalar()
    rows = F.transform(
        "codes",
        lambda c: F.struct(
            (-F.coalesce(F.try_element_at("by_type", c), F.lit(0))).alias("minus"), c.alias("type_code")
        ),
    )
    with_codes = per_user.withColumn("codes", all_types)
    return with_codes.select("user_id", F.posexplode(F.array_sort(rows)).alias("position", "r")).select(
        "user_id",
        F.col("r.type_code").alias("type_code"),
        (-F.col("r.minus")).alias("finds"),
        (F.col("position") + 1).alias("position"),
    )


def derived_stats(stats: DataFrame, as_of: str) -> DataFrame:
    """Percent of challenges done, days since the last find, finds per active
    challenge. Halves round up; zero denominators give 0."""

    def half_up(value):
        return F.floor(value + F.lit(0.5)).cast("long")

    return stats.select(
        "user_id",
        F.when(F.col("total_challenges") == 0, F.lit(0).cast("long"))
        .otherwise(half_up(F.try_divide("completed_challenges", "total_challenges") * 100))
        .alias("completion_percent"),
        F.abs(F.datediff(F.lit(as_of).cast("date"), "last_find")).cast("long").alias("days_since_last_find"),
        F.when(F.col("active_challenges") == 0, F.lit(0).cast("long"))
        .otherwise(half_up(F.try_divide("total_finds", "active_challenges")))
        .alias("finds_per_active_challenge"),
    )
