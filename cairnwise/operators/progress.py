"""Progress of tasks and enrolments for all users in one job.

Finds are reduced to one row per (user, signature, day, country) before any task
is joined. Everything later is bounded per user and rule by the number of days
and countries, however many finds one user holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnwise.functions import grids
from cairnwise.operators.rule_index import StoredRules
from cairnwise.operators.rules import RuleSet

TAG_COLUMNS = ["difficulty", "terrain", "elevation", "country_id"]
# Totals are made in as many parts as the finds ask for, each of about so many.
FINDS_PER_PARTITION = 250_000


def rule_hits(finds: DataFrame, items: DataFrame, user_rules: DataFrame, rules: RuleSet | StoredRules) -> DataFrame:
    """(user_id, sig, found_date, item columns): finds matching a rule of their user.

    ``user_rules`` holds user_id and sig.
    """
    return rules.hits(finds, items, user_rules, TAG_COLUMNS)


def daily_totals(hits: DataFrame, parts: int) -> DataFrame:
    """Per (user, signature, day, country): matches, summed scores, grid cells as bits,
    and the running count. A missing country counts as one, -1.

    Hits are dealt by day in ``parts``, so that one user's many finds lie in many.
    The last row of a day holds the running count of the whole day."""
    zero = F.lit(0)
    hits = hits.repartition(parts, "user_id", "sig", "found_date")
    low, high = grids.cell_bits(grids.cell_index(F.col("difficulty"), F.col("terrain")))
    daily = hits.groupBy("user_id", "sig", "found_date", F.coalesce("country_id", F.lit(-1)).alias("country")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("difficulty", zero)).alias("difficulty"),
        F.sum(F.coalesce("terrain", zero)).alias("terrain"),
        F.sum(F.coalesce("elevation", zero)).alias("altitude"),
        F.bit_or(low).alias("cells_low"),
        F.bit_or(high).alias("cells_high"),
    )
    so_far = W.partitionBy("user_id", "sig").orderBy("found_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.repartition(parts, "user_id", "sig").withColumn("running", F.sum("n").over(so_far))


def with_rules(tasks: DataFrame, rules: RuleSet | StoredRules, and_only: bool = True) -> DataFrame:
    """Tasks with their rule's signature and aggregate; ``supported`` is false
    for rules with or/not when ``and_only`` is asked for, and for unknown rules."""
    joined = rules.attach(tasks)
    supported = F.col("sig").isNotNull() & (F.col("and_only") | F.lit(not and_only))
    return joined.withColumn("supported", F.coalesce(supported, F.lit(False)))


def task_measures(tasks: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules) -> DataFrame:
    """Per task: count, the six aggregates' values, first and n-th date.

    ``tasks`` comes from ``with_rules``; ``min_count`` is the n of the n-th date.
    Tasks of the job follow the number of finds, which are counted first.
    """
    parts = max(1, -(-finds.count() // FINDS_PER_PARTITION))
    hits = rule_hits(finds, items, tasks, rules)
    keyed = tasks.select("task_id", "user_id", "sig", "min_count", "agg_kind", "max_d", "max_t")
    measures = (
        keyed.join(daily_totals(hits, parts), ["user_id", "sig"])
        .groupBy("task_id")
        .agg(
            F.sum("n").alias("matched"),
            F.sum("difficulty").alias("sum_difficulty"),
            F.sum("terrain").alias("sum_terrain"),
            F.sum("altitude").alias("sum_altitude"),
            F.bit_or("cells_low").alias("cells_low"),
            F.bit_or("cells_high").alias("cells_high"),
            F.first("max_d").alias("max_d"),
            F.first("max_t").alias("max_t"),
            F.min("found_date").alias("first_date"),
            F.min(F.when((F.col("min_count") > 0) & (F.col("running") >= F.col("min_count")), F.col("found_date"))).alias("nth_date"),
            # Only tasks that ask for it tell countries apart.
            F.count_distinct(F.when(F.col("agg_kind") == "distinct_countries", F.col("country"))).alias("countries"),
        )
    )
    measures = measures.withColumn("countries", F.when(F.col("countries") > 0, F.col("countries").cast("long")))
    covered = grids.cells_within(F.col("cells_low"), F.col("cells_high"), F.col("max_d"), F.col("max_t"))
    cells = F.when(F.col("max_d").isNotNull(), F.size(covered).cast("long"))
    return measures.withColumn("cells", cells).drop("cells_low", "cells_high", "max_d", "max_t")


def aggregate_total(kind: Column) -> Column:
    """The value of the task's own aggregate kind, cut to a whole number."""
    value = (
        F.when(kind == "difficulty", F.col("sum_difficulty"))
        .when(kind == "terrain", F.col("sum_terrain"))
        .when(kind == "diff_plus_terr", F.col("sum_difficulty") + F.col("sum_terrain"))
        .when(kind == "altitude", F.col("sum_altitude"))
        .when(kind == "distinct_countries", F.col("countries"))
        .when(kind == "dt_matrix", F.col("cells"))
    )
    return F.when(kind.isNotNull(), F.coalesce(value, F.lit(0)).cast("long"))


def task_progress(
    tasks: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules, force: bool = False, and_only: bool = True
) -> DataFrame:
    """One row per task with count, percent, aggregate, status and dates.

    Rules come from a ``RuleSet`` by ``rule_id``, or from the tasks' own
    expressions with ``StoredRules``.

    A task the user marked done stands at 100 % unless ``force``. Tasks may
    carry ``start_found_at`` and ``completed_at`` from an earlier evaluation:
    the start is kept, the completion is recomputed.
    """
    for name in ("start_found_at", "completed_at"):
        if name not in tasks.columns:
            tasks = tasks.withColumn(name, F.lit(None).cast("date"))
    tasks = with_rules(tasks, rules, and_only).withColumn("min_count", F.coalesce("min_count", F.lit(0)))
    status = F.lower(F.coalesce("status", F.lit("todo")))
    tasks = tasks.withColumns({"old_status": status, "overridden": (status == "done") & F.lit(not force)})
    counted = tasks.where("supported AND NOT overridden")
    rows = tasks.join(task_measures(counted, finds, items, rules), "task_id", "left")

    m, total, target = F.col("min_count"), F.col("agg_total"), F.col("agg_target")
    current = F.coalesce("matched", F.lit(0)).cast("long")
    live = F.col("supported") & ~F.col("overridden")
    has_target = target.isNotNull() & (target > 0)
    rows = rows.withColumns({"current": current, "agg_total": aggregate_total(F.col("agg_kind"))})
    count_percent = F.when(m > 0, 100.0 * (F.least("current", m) / F.nullif(m, F.lit(0)))).otherwise(100.0)
    agg_percent = F.when(has_target, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.try_divide(total, target)))).otherwise(0.0)
    percent = (
        F.when(F.col("agg_kind").isNull(), count_percent)
        .when(m > 0, F.least(count_percent, agg_percent))
        .otherwise(agg_percent)
    )
    count_ok = (m == 0) | (F.col("current") >= m)
    agg_ok = F.col("agg_kind").isNull() | ~has_target | (total >= target)
    return rows.select(
        "task_id", "uc_id", "user_id", "ord",
        F.coalesce("title", F.lit("Task")).alias("title"),
        "rule_id",
        (F.col("supported") | F.col("overridden")).alias("supported"),
        m.cast("long").alias("min_count"),
        F.when(F.col("overridden"), m.cast("long")).when(live, F.col("current")).otherwise(F.lit(0)).cast("long").alias("current_count"),
        F.when(F.col("overridden"), 100.0).when(live, percent).otherwise(0.0).alias("percent"),
        F.when(live, total).alias("agg_total"),
        F.when(live & F.col("agg_kind").isNotNull(), F.coalesce(target, F.lit(0)).cast("long")).alias("agg_target"),
        F.when(live, F.col("agg_unit")).alias("agg_unit"),
        F.when(live & count_ok & agg_ok, "done").otherwise(F.col("old_status")).alias("status"),
        F.when(live, F.coalesce("start_found_at", "first_date")).otherwise(F.col("start_found_at")).alias("start_found_at"),
        F.when(~live, F.col("completed_at"))
        .when((m > 0) & (F.col("current") >= m), F.col("nth_date"))
        .alias("completed_at"),
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per enrolment."""
    payload = [c for c in snapshots.columns if c != "uc_id"]
    newest = F.max_by(F.struct(*payload), "checked_at")
    return snapshots.groupBy("uc_id").agg(newest.alias("s")).select("uc_id", *[F.col(f"s.{c}") for c in payload])


#: What a snapshot keeps of each task.
SNAPSHOT_FIELDS = (
    "ord", "task_id", "title", "status", "supported", "min_count", "current_count", "percent", "agg_total", "agg_target", "agg_unit",
    "start_found_at", "completed_at",
)


def nested_snapshots(progress: DataFrame, rolled: DataFrame, as_of: str) -> DataFrame:
    """One snapshot per enrolment: its roll-up, and its tasks in order as an array of structs.

    ``progress`` comes from ``task_progress``, ``rolled`` from
    ``enrolment_progress``. An enrolment without tasks has an empty array.
    """
    tasks = progress.groupBy("uc_id").agg(F.array_sort(F.collect_list(F.struct(*SNAPSHOT_FIELDS))).alias("tasks"))
    none = F.array().cast(tasks.schema["tasks"].dataType)
    return rolled.join(tasks, "uc_id", "left").select(
        "uc_id", "user_id", F.lit(as_of).cast("date").alias("checked_at"), "percent", "tasks_done", "tasks_total",
        F.coalesce("tasks", none).alias("tasks"),
    )


def latest_task_progress(snapshots: DataFrame) -> DataFrame:
    """One row per task of every enrolment's newest snapshot, with ``uc_id`` and ``checked_at``.

    Snapshots are compared before their tasks are unfolded, so older ones cost
    no more than their date.
    """
    newest = snapshots.groupBy("uc_id").agg(F.max_by("tasks", "checked_at").alias("tasks"), F.max("checked_at").alias("checked_at"))
    return newest.select("uc_id", "checked_at", F.inline("tasks"))


def written_tasks(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """The task table after an evaluation: status and dates of evaluated tasks, all others as they were."""
    for name in ("start_found_at", "completed_at"):
        if name not in tasks.columns:
            tasks = tasks.withColumn(name, F.lit(None).cast("date"))
    fresh = progress.select("task_id", F.struct("status", "start_found_at", "completed_at").alias("new"))
    changed = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("status", "start_found_at", "completed_at")}
    return tasks.join(fresh, "task_id", "left").withColumns(changed).select(*tasks.columns)


def written_enrolments(enrolments: DataFrame, rolled: DataFrame, as_of: str) -> DataFrame:
    """The enrolment table after an evaluation, with the last ``progress`` of evaluated ones."""
    kind = "struct<percent:double,tasks_done:bigint,tasks_total:bigint,checked_at:date>"
    if "progress" not in enrolments.columns:
        enrolments = enrolments.withColumn("progress", F.lit(None).cast(kind))
    last = F.struct("percent", "tasks_done", "tasks_total", F.lit(as_of).cast("date").alias("checked_at")).cast(kind)
    fresh = rolled.select("uc_id", F.struct("status", "computed_status", last.alias("progress")).alias("new"))
    changed = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("status", "computed_status", "progress")}
    return enrolments.join(fresh, "uc_id", "left").withColumns(changed).select(*enrolments.columns)


def enrolment_progress(
    enrolments: DataFrame, tasks: DataFrame, strict: bool = False
) -> DataFrame:
    """Roll task progress up to enrolments.

    Weighted by ``min_count`` when any is set, else the mean percent; one
    decimal. Done when every supported task is done, which an enrolment without
    supported tasks also is unless ``strict``.
    """
    s = F.col("supported")
    m, c = F.col("min_count"), F.col("current_count")
    sums = tasks.groupBy("uc_id").agg(
        F.sum(F.when(s, m)).alias("sum_min"),
        F.sum(F.when(s, F.when(m > 0, F.least(c, m)).otherwise(c))).alias("sum_current"),
        F.count_if(s).alias("tasks_total"),
        F.count_if(s & (F.col("status") == "done")).alias("tasks_done"),
        F.avg(F.when(s, F.col("percent"))).alias("mean_percent"),
    )
    rows = enrolments.select("uc_id", "user_id", "status", "computed_status").join(sums, "uc_id", "left")
    rows = rows.fillna(0, subset=["sum_min", "sum_current", "tasks_total", "tasks_done"])
    percent = F.when(
        F.col("sum_min") > 0, F.bround(100.0 * F.try_divide("sum_current", "sum_min"), 1)
    ).otherwise(F.coalesce(F.bround("mean_percent", 1), F.lit(0.0)))
    done = F.col("tasks_done") == F.col("tasks_total")
    if strict:
        done = done & (F.col("tasks_total") > 0)
    newly = done & ~(F.col("computed_status").eqNullSafe("completed"))
    return rows.select(
        "uc_id", "user_id", percent.alias("percent"), "tasks_done", "tasks_total",
        F.when(newly, "completed").otherwise(F.col("status")).alias("status"),
        F.when(newly, "completed").otherwise(F.col("computed_status")).alias("computed_status"),
    )


def split_completed(enrolments: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to evaluate, already completed with a stored snapshot): the second part
    answers with its last snapshot and never reaches the heavy join."""
    completed = F.coalesce((F.col("computed_status") == "completed") | (F.col("status") == "completed"), F.lit(False))
    latest = latest_snapshots(snapshots).select("uc_id", "percent", "tasks_done", "tasks_total", "checked_at")
    stored = enrolments.where(completed).select("uc_id", "user_id", "status", "computed_status").join(latest, "uc_id")
    fresh = enrolments.join(stored.select("uc_id"), "uc_id", "left_anti")
    return fresh, stored


def new_candidates(
    enrolments: DataFrame, snapshots: DataFrame, include_pending: bool = False, limit: int = 50, since: str | None = None
) -> DataFrame:
    """Enrolments due for a first snapshot, flagged ``evaluate``.

    Per user the first ``3 * limit`` by id are looked at, those with a snapshot
    are skipped, and at most ``limit`` of the rest are evaluated.
    """
    rows = enrolments.where(F.col("status").isin(["accepted", "pending"] if include_pending else ["accepted"]))
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("date"))
    by_id = W.partitionBy("user_id").orderBy("uc_id")
    seen = rows.select("user_id", "uc_id").withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= 3 * limit)
    have = snapshots.select("uc_id").distinct().withColumn("has_snapshot", F.lit(True))
    flagged = seen.join(have, "uc_id", "left").withColumn("has_snapshot", F.coalesce("has_snapshot", F.lit(False)))
    nth_open = F.sum(F.when(F.col("has_snapshot"), 0).otherwise(1)).over(by_id)
    return flagged.select(
        "user_id", "uc_id", (~F.col("has_snapshot") & (nth_open <= limit)).alias("evaluate")
    )


def new_candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("user_id").agg(
        F.count_if("evaluate").alias("evaluated_count"), F.count_if(~F.col("evaluate")).alias("skipped_count")
    )


def progress_history(snapshots: DataFrame, limit: int = 10, before: str | None = None) -> DataFrame:
    """The newest ``limit`` snapshots per enrolment; position 1 is the latest."""
    rows = snapshots if before is None else snapshots.where(F.col("checked_at") < F.lit(before).cast("date"))
    newest = W.partitionBy("uc_id").orderBy(F.desc("checked_at"))
    return (
        rows.withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= max(1, limit))
        .withColumn("is_latest", F.col("position") == 1)
    )


def task_eta(progress: DataFrame, as_of: str) -> DataFrame:
    """Adds ``eta``: the completion date, or the date the current pace reaches
    ``min_count``; null when there is no pace yet."""
    today = F.lit(as_of).cast("date")
    days = F.greatest(F.datediff(today, F.col("start_found_at")), F.lit(1))
    speed = (F.col("current_count") - 1) / days
    remaining = F.greatest(F.lit(0), F.col("min_count") - F.col("current_count"))
    ahead = F.ceil(F.try_divide(remaining, speed)).cast("int")
    pacing = (
        F.col("start_found_at").isNotNull() & (F.col("current_count") >= 1) & (F.col("min_count") > 0)
        & (speed > 0) & (remaining > 0)
    )
    return progress.withColumn(
        "eta", F.when(F.col("completed_at").isNotNull(), F.col("completed_at")).when(pacing, F.date_add(today, ahead))
    )


def enrolment_eta(with_eta: DataFrame) -> DataFrame:
    """The latest task date per enrolment."""
    return with_eta.groupBy("uc_id").agg(F.max("eta").alias("eta"))
