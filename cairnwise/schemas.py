"""Schemas of the canonical tables.

Names used everywhere: *items* (places), *finds* (who visited what and when),
*enrolments* (a user working on a challenge), *tasks* (rules of an enrolment),
*snapshots* (stored progress), *targets* (recommended items), *zones*.
"""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTE = T.StructType(
    [T.StructField("attr_id", T.IntegerType()), T.StructField("is_positive", T.BooleanType())]
)

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("type_code", T.StringType()),
        T.StructField("size_code", T.StringType()),
        T.StructField("country_id", T.IntegerType()),
        T.StructField("state_id", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("elevation", T.IntegerType()),
        T.StructField("difficulty", T.DoubleType()),
        T.StructField("terrain", T.DoubleType()),
        T.StructField("favorites", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("placed_at", T.DateType()),
        T.StructField("attributes", T.ArrayType(ATTRIBUTE)),
    ]
)

FINDS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("found_date", T.DateType()),
        T.StructField("notes", T.StringType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("home_lat", T.DoubleType()),
        T.StructField("home_lon", T.DoubleType()),
        T.StructField("created_at", T.DateType()),
        T.StructField("last_import_at", T.DateType()),
        T.StructField("last_evaluated_at", T.DateType()),
    ]
)

ENROLMENTS = T.StructType(
    [
        T.StructField("uc_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("challenge_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("computed_status", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("manual_override", T.BooleanType()),
        T.StructField("override_reason", T.StringType()),
        T.StructField("percent", T.DoubleType()),
        T.StructField("created_at", T.DateType()),
        T.StructField("updated_at", T.DateType()),
    ]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("uc_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("rule_id", T.IntegerType()),
        T.StructField("min_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("uc_id", T.LongType()),
        T.StructField("checked_at", T.DateType()),
        T.StructField("percent", T.DoubleType()),
        T.StructField("tasks_done", T.IntegerType()),
        T.StructField("tasks_total", T.IntegerType()),
    ]
)

# Ring vertices are (x=longitude, y=latitude); several rings are read even-odd,
# which covers holes and disjoint parts alike.
RING = T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)

ZONES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("parent_code", T.StringType()),
        T.StructField("rings", T.ArrayType(RING)),
    ]
)
