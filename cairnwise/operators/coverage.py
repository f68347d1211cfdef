"""Calendar and difficulty/terrain coverage of every user's finds.

Both reduce finds to one row per (user, day) or (user, cell) first, with
map-side combining, so a user holding a third of all finds still reaches the
second step as at most 366 days or 81 cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.functions import grids


def resolve_label(dim: DataFrame, key: str, label: str, names: tuple[str, ...] = ("name",)) -> DataFrame:
    """Keys of ``dim`` whose key, name or alias equals ``label`` (case-insensitive)."""
    wanted = F.lower(F.lit(label))
    hit = F.lower(F.col(key)) == wanted
    for name in names:
        if dict(dim.dtypes)[name].startswith("array"):
            hit = hit | F.exists(name, lambda a: F.lower(a) == wanted)
        else:
            hit = hit | (F.lower(F.col(name)) == wanted)
    return dim.where(hit).select(key)


def matching_finds(
    finds: DataFrame, items: DataFrame, columns: list[str], type_keys: DataFrame | None = None,
    size_keys: DataFrame | None = None,
) -> DataFrame:
    """Finds with the given item columns; finds of unknown items drop out.

    An unresolved filter is an empty key table and therefore matches nothing.
    """
    kept = items
    if type_keys is not None:
        kept = kept.join(type_keys, "type_code", "left_semi")
    if size_keys is not None:
        kept = kept.join(size_keys, "size_code", "left_semi")
    return finds.join(kept.select("item_id", *columns), "item_id")


def calendar_day_counts(finds: DataFrame) -> DataFrame:
    """(user_id, day, finds) over all years."""
    return finds.groupBy("user_id", F.date_format("found_date", "MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("finds")
    )


def _per_user(users: DataFrame | None, counts: DataFrame) -> DataFrame:
    return counts if users is None else users.select("user_id").join(counts, "user_id", "left")


def _days(users: DataFrame | None, day_counts: DataFrame) -> DataFrame:
    per_user = day_counts.groupBy("user_id").agg(
        F.collect_list(F.struct("day", "finds")).alias("days"), F.min("finds").alias("fewest")
    )
    none = F.expr("CAST(array() AS array<struct<day:string,finds:bigint>>)")
    return _per_user(users, per_user).withColumn("days", F.coalesce("days", none))


def calendar_coverage(day_counts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row per user: covered days of 365 and 366, rates, missing days, tours.

    ``tours`` is the smallest count over all covered days (29 February
    included when found) once the 365 regular days are covered.
    """
    done = _days(users, day_counts).withColumn("done", F.transform("days", lambda d: d["day"]))
    done366 = F.size("done")
    done365 = done366 - F.array_contains("done", grids.LEAP_DAY).cast("int")
    missing = F.array_except(grids.calendar_days(), F.col("done"))
    return done.select(
        "user_id",
        done365.cast("long").alias("completed_365"),
        (done365 / F.lit(365)).alias("rate_365"),
        done366.cast("long").alias("completed_366"),
        (done366 / F.lit(366)).alias("rate_366"),
        F.size(missing).cast("long").alias("missing_count"),
        F.array_join(missing, ",").alias("missing_days"),
        F.when(done365 == 365, F.col("fewest")).otherwise(F.lit(0)).cast("long").alias("tours"),
    )


def calendar_months(day_counts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Covered and missing days per user and month, with the month's rate in percent."""
    months = F.array(
        *[
            F.struct(F.lit(i).alias("month"), F.lit(n).alias("days_in_month"))
            for i, n in enumerate(grids.DAYS_PER_MONTH, start=1)
        ]
    )
    per_user = _days(users, day_counts).select("user_id", "days", F.explode(months).alias("m"))
    inside = F.filter("days", lambda d: F.substring(d["day"], 1, 2).cast("int") == F.col("m.month"))
    return per_user.select(
        "user_id", "m.month", "m.days_in_month", F.size(inside).alias("completed")
    ).select(
        "user_id",
        "month",
        F.col("completed").cast("long").alias("completed"),
        (F.col("days_in_month") - F.col("completed")).cast("long").alias("missing"),
        (F.col("completed") / F.col("days_in_month") * 100).alias("rate"),
    )


def matrix_cell_counts(matched: DataFrame) -> DataFrame:
    """(user_id, difficulty, terrain, finds) with both axes rounded to half steps."""
    return (
        matched.select(
            "user_id",
            grids.half_step(F.col("difficulty")).alias("difficulty"),
            grids.half_step(F.col("terrain")).alias("terrain"),
        )
        .where(F.col("difficulty").isNotNull() & F.col("terrain").isNotNull())
        .groupBy("user_id", "difficulty", "terrain")
        .agg(F.count(F.lit(1)).alias("finds"))
    )


def _cells(cell_counts: DataFrame) -> DataFrame:
    inside = grids.on_grid(F.col("difficulty")) & grids.on_grid(F.col("terrain"))
    return cell_counts.where(inside).withColumn(
        "cell", grids.grid_label(F.col("difficulty"), F.col("terrain"))
    )


def _matrix_tours(done: Column, fewest: Column) -> Column:
    return F.when(done == grids.GRID_CELLS, fewest).otherwise(F.lit(0)).cast("long")


def matrix_coverage(cell_counts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row per user: covered cells of 81, missing cells, tours, next round."""
    per_user = _cells(cell_counts).groupBy("user_id").agg(
        F.collect_list("cell").alias("done"),
        F.collect_list("finds").alias("counts"),
        F.min("finds").alias("fewest"),
    )
    none = F.expr("CAST(array() AS array<string>)")
    rows = _per_user(users, per_user).withColumn("done", F.coalesce("done", none))
    done = F.size("done")
    missing = F.array_except(grids.grid_labels(), F.col("done"))
    above = F.size(F.filter("counts", lambda c: c > F.col("fewest")))
    next_round = F.when(done == grids.GRID_CELLS, above).otherwise(done)
    return rows.select(
        "user_id",
        done.cast("long").alias("completed"),
        (done / F.lit(grids.GRID_CELLS)).alias("rate"),
        F.array_join(missing, ",").alias("missing_cells"),
        _matrix_tours(done, F.col("fewest")).alias("tours"),
        next_round.cast("long").alias("next_round_completed"),
        (next_round / F.lit(grids.GRID_CELLS)).alias("next_round_rate"),
    )


def matrix_missing_by_difficulty(cell_counts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Missing terrains per user and difficulty (only difficulties with gaps)."""
    missing = matrix_coverage(cell_counts, users).select(
        "user_id", F.explode(F.filter(F.split("missing_cells", ","), lambda c: c != "")).alias("cell")
    )
    parts = F.split("cell", "/")
    return (
        missing.select("user_id", parts[0].cast("double").alias("difficulty"), parts[1].alias("terrain"))
        .groupBy("user_id", "difficulty")
        .agg(F.array_join(F.sort_array(F.collect_list("terrain")), ",").alias("missing_terrains"))
    )


def matrix_grid(cell_counts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Dense 81 rows per user with the count of every cell."""
    per_user = _cells(cell_counts).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "finds"))).alias("counts")
    )
    rows = _per_user(users, per_user).select(
        "user_id", "counts", F.explode(grids.grid_labels()).alias("cell")
    )
    count = F.coalesce(F.try_element_at("counts", F.col("cell")), F.lit(0)).cast("long")
    return rows.select(
        "user_id",
        F.split("cell", "/")[0].cast("double").alias("difficulty"),
        F.split("cell", "/")[1].cast("double").alias("terrain"),
        count.alias("finds"),
        (count > 0).alias("is_completed"),
    )
