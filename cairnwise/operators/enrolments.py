"""Enrolments of users in challenges: status, sync, patches, lists, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values.
STATUSES = ["pending", "accepted", "dismissed", "completed"]
MAX_NOTES, MAX_REASON = 2000, 500
MANUAL_REASON = "Manual completion"
COMPLETED = "completed"


def _is(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(value)


def effective_status() -> Column:
    """Completed if either status says so, else the user's, else pending."""
    either = _is("status", COMPLETED) | _is("computed_status", COMPLETED)
    return F.when(either, COMPLETED).otherwise(F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")))


def has_status(wanted: str) -> Column:
    """Filter by effective status; 'pending' includes a missing status."""
    if wanted == COMPLETED:
        return _is("status", COMPLETED) | _is("computed_status", COMPLETED)
    user = F.col("status").isNull() | _is("status", "pending") if wanted == "pending" else _is("status", wanted)
    return user & ~_is("computed_status", COMPLETED)


# -- synchronising -------------------------------------------------------------


def missing_counts(users: DataFrame, challenges: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Per user, how many enrolments exist and how many are missing.

    Every user is due one enrolment per challenge, so the number missing is
    the number of challenges less those enrolled; no pair is formed.
    """
    total = challenges.groupBy().agg(F.countDistinct("challenge_id")).scalar()
    enrolled = (
        enrolments.join(challenges.select("challenge_id"), "challenge_id", "left_semi")
        .select("user_id", "challenge_id").distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("existing"))
    )
    return (
        users.select("user_id").join(enrolled, "user_id", "left")
        .withColumns({"existing": F.coalesce("existing", F.lit(0)).cast("long"), "total": total})
        .select("user_id", "existing", (F.col("total") - F.col("existing")).alias("created"), "total")
    )


def missing_enrolments(
    requests: DataFrame, challenges: DataFrame, enrolments: DataFrame, as_of: str, shards: int = 64
) -> DataFrame:
    """The pending rows themselves for the users who asked.

    The result is by definition one row per asking user and missing challenge.
    Challenges are spread over shards and every request visits each shard in
    an equi join, so the rows are made by all tasks, none holding a whole side.
    """
    asking = requests.select("user_id").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    offered = challenges.select("challenge_id").distinct().withColumn("shard", F.pmod(F.hash("challenge_id"), F.lit(shards)))
    return (
        asking.join(offered, "shard").drop("shard")
        .join(enrolments.select("user_id", "challenge_id"), ["user_id", "challenge_id"], "left_anti")
        .select("user_id", "challenge_id", F.lit("pending").alias("status"), F.lit(as_of).cast("date").alias("created_at"))
    )


def autocomplete(enrolments: DataFrame, challenges: DataFrame, finds: DataFrame) -> DataFrame:
    """Open enrolments whose challenge item the user has found: now completed at 100 %."""
    open_rows = enrolments.where(~has_status(COMPLETED))
    located = open_rows.join(challenges.select("challenge_id", "item_id"), "challenge_id")
    hit = located.join(finds.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return hit.drop("item_id").withColumns({"computed_status": F.lit(COMPLETED), "percent": F.lit(100.0)})


def sync_counts(users: DataFrame, challenges: DataFrame, enrolments: DataFrame, finds: DataFrame) -> DataFrame:
    """created / existing / auto_completed / total per user."""
    done = autocomplete(enrolments, challenges, finds).groupBy("user_id").agg(F.count(F.lit(1)).alias("auto_completed"))
    return missing_counts(users, challenges, enrolments).join(done, "user_id", "left").withColumn(
        "auto_completed", F.coalesce("auto_completed", F.lit(0)).cast("long")
    )


def sync(
    enrolments: DataFrame, challenges: DataFrame, finds: DataFrame, requests: DataFrame | None = None, as_of: str | None = None
) -> DataFrame:
    """The whole enrolment table after a synchronisation, with ``created`` and ``auto_completed``.

    Open enrolments whose challenge item was found become completed at 100 %;
    all others stay as they are. ``requests`` (user_id) adds the enrolments
    those users lack, dated ``as_of`` and completed alike; columns these rows
    cannot know, ids among them, are null. An enrolment in an unknown
    challenge is kept, and repeated finds or challenge rows change nothing.
    """
    rows = enrolments.withColumn("created", F.lit(False))
    if requests is not None:
        if as_of is None:
            raise ValueError("new enrolments need a date")
        added = missing_enrolments(requests, challenges, enrolments, as_of).withColumn("created", F.lit(True))
        known = [c for c in added.columns if c in rows.columns]
        rows = rows.unionByName(added.select(*known), allowMissingColumns=True)
    # Enrolments and finds meet on user and item, so neither a popular item nor a busy user makes pairs.
    met = (
        rows.select("user_id", "challenge_id").join(challenges.select("challenge_id", "item_id"), "challenge_id")
        .join(finds.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
        .select("user_id", "challenge_id").distinct().withColumn("met", F.lit(True))
    )
    done = F.col("met").isNotNull() & ~has_status(COMPLETED)
    return (
        rows.join(met, ["user_id", "challenge_id"], "left")
        .withColumn("auto_completed", done)
        .withColumns({
            "computed_status": F.when(F.col("auto_completed"), COMPLETED).otherwise(F.col("computed_status")),
            "percent": F.when(F.col("auto_completed"), 100.0).otherwise(F.col("percent")),
        })
        .select(*enrolments.columns, "created", "auto_completed")
    )


def reset(enrolments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Back to pending, with everything derived or noted cleared, for the chosen ids."""
    marked = enrolments.join(chosen.select("uc_id").distinct().withColumn("chosen", F.lit(True)), "uc_id", "left")
    cleared = ["computed_status", "percent", "manual_override", "override_reason", "notes"]
    out = marked.withColumn("status", F.when(F.col("chosen"), "pending").otherwise(F.col("status")))
    for name in (c for c in cleared if c in enrolments.columns):
        out = out.withColumn(name, F.when(F.col("chosen").isNull(), F.col(name)))
    return out.select(*enrolments.columns)


# -- patches ---------------------------------------------------------------------


def transition_error(new_status: Column, computed: Column) -> Column:
    """Why a status may not be set, or null."""
    return (
        F.when(new_status.isNotNull() & ~new_status.isin(STATUSES), F.concat(F.lit("status_unknown: "), new_status))
        .when(computed.eqNullSafe(COMPLETED) & new_status.isin("pending", "dismissed"), "completed_by_find")
    )


def override_kind(new_status: Column, computed: Column) -> Column:
    """manual_completion, status_override, or null when nothing is overridden."""
    return F.when((new_status == COMPLETED) & ~computed.eqNullSafe(COMPLETED), "manual_completion").when(
        computed.isNotNull() & new_status.isNotNull() & (new_status != computed), "status_override"
    )


def check_patches(enrolments: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (``uc_id, user_id, status, notes, reason, ord``) with ``error``.

    A missing value means the field is left alone, and so does a blank status.
    """
    patches = patches.withColumn("status", F.nullif(F.trim("status"), F.lit("")))
    current = enrolments.select("uc_id", "user_id", F.col("computed_status").alias("computed"), F.lit(True).alias("known"))
    rows = patches.join(current, ["uc_id", "user_id"], "left")
    error = F.coalesce(
        F.when(F.col("known").isNull(), "enrolment_unknown"),
        transition_error(F.col("status"), F.col("computed")),
        F.when(F.length("notes") > MAX_NOTES, f"notes_long"),
        F.when(F.length("reason") > MAX_REASON, f"reason_long"),
    )
    return rows.withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("known")


def apply_patches(
    enrolments: DataFrame, patches: DataFrame, challenges: DataFrame, finds: DataFrame, as_of: str
) -> DataFrame:
    """The enrolment table after all valid patches; later patches of a row win per field.

    Blank notes or reasons clear the stored ones. A patched row whose challenge
    item was found and that has no computed status is completed as well.
    """
    valid = check_patches(enrolments, patches).where("ok")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord")))

    merged = valid.groupBy("uc_id").agg(
        last("status").alias("p_status"), last("notes").alias("p_notes"), last("reason").alias("p_reason")
    ).withColumn("patched", F.lit(True))
    found = (
        valid.select("uc_id", "user_id").distinct()
        .join(enrolments.select("uc_id", "challenge_id"), "uc_id")
        .join(challenges.select("challenge_id", "item_id"), "challenge_id")
        .join(finds.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
        .select("uc_id", F.lit(True).alias("item_found"))
    )
    rows = enrolments.join(merged, "uc_id", "left").join(found, "uc_id", "left")
    kind = override_kind(F.col("p_status"), F.col("computed_status"))
    auto = F.col("item_found").isNotNull() & F.col("computed_status").isNull()

    def text(patch: str, stored: str) -> Column:
        return F.when(F.col(patch).isNotNull(), F.nullif(F.trim(patch), F.lit(""))).otherwise(F.col(stored))

    reason = F.when(kind == "manual_completion", F.lit(MANUAL_REASON)).otherwise(text("p_reason", "override_reason"))
    return rows.select(
        *[c for c in enrolments.columns if c not in ("status", "computed_status", "notes", "manual_override", "override_reason", "percent", "updated_at")],
        F.coalesce("p_status", "status").alias("status"),
        F.when(auto, COMPLETED).otherwise(F.col("computed_status")).alias("computed_status"),
        text("p_notes", "notes").alias("notes"),
        F.when(kind.isNotNull(), F.lit(True)).otherwise(F.col("manual_override")).alias("manual_override"),
        reason.alias("override_reason"),
        F.when((kind == "manual_completion") | auto, F.lit(100.0)).otherwise(F.col("percent")).alias("percent"),
        F.when(F.col("patched"), F.lit(as_of).cast("date")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def set_status(enrolments: DataFrame, chosen: DataFrame, status: str, as_of: str) -> DataFrame:
    """One status for many ids; 'completed' also records the override and 100 %."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    marked = enrolments.join(chosen.select("uc_id").distinct().withColumn("chosen", F.lit(True)), "uc_id", "left")
    changes = {"status": F.lit(status), "updated_at": F.lit(as_of).cast("date")}
    if status == COMPLETED:
        changes |= {"manual_override": F.lit(True), "override_reason": F.lit(MANUAL_REASON), "percent": F.lit(100.0)}
    out = marked.withColumns({k: F.when(F.col("chosen"), v).otherwise(F.col(k)) for k, v in changes.items()})
    return out.select(*enrolments.columns)


# -- lists -----------------------------------------------------------------------


def detail(enrolments: DataFrame, challenges: DataFrame, items: DataFrame) -> DataFrame:
    """Enrolments with their challenge (required) and item (optional)."""
    return (
        enrolments.join(challenges.select("challenge_id", "item_id", F.col("name").alias("challenge_name")), "challenge_id")
        .join(items.select("item_id", F.col("code").alias("item_code"), "difficulty", "terrain", "lat", "lon"), "item_id", "left")
        .withColumn("effective_status", effective_status())
    )


def list_page(
    enrolments: DataFrame, challenges: DataFrame, items: DataFrame, status: str | None = None, page: int = 1, size: int = 50
) -> DataFrame:
    """A page per user, latest update first, with the user's total and pages.

    Rows are ranked before the two joins, so only a page's rows are joined.
    """
    rows = enrolments if status is None else enrolments.where(has_status(status))
    rows = rows.join(challenges.select("challenge_id"), "challenge_id", "left_semi")
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("nb_items"))
    order = W.partitionBy("user_id").orderBy(F.desc("updated_at"), "uc_id")
    last = page * size
    ranked = rows.withColumn("position", F.row_number().over(order)).where(
        (F.col("position") <= last) & (F.col("position") > last - size)
    )
    return (
        detail(ranked, challenges, items).join(totals, "user_id")
        .withColumn("nb_pages", F.ceil(F.col("nb_items") / F.lit(size)).cast("long"))
    )


# -- tasks -----------------------------------------------------------------------


def replace_tasks(tasks: DataFrame, payload: DataFrame) -> DataFrame:
    """All tasks of the enrolments in ``payload`` are replaced by its rows.

    ``payload`` holds ``uc_id, user_id, position`` and optional ``ord, title,
    status``; missing ones default to the position, "Task #n" and todo.
    """
    filled = payload.withColumns(
        {
            "ord": F.coalesce("ord", "position").cast("int"),
            "title": F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Task #"), (F.col("position") + 1).cast("string"))),
            "status": F.coalesce("status", F.lit("todo")),
        }
    )
    kept = tasks.join(payload.select("uc_id").distinct(), "uc_id", "left_anti")
    return kept.unionByName(filled.select(*tasks.columns))


def list_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with their place (by order, then id) in the enrolment and a title."""
    order = W.partitionBy("uc_id").orderBy("ord", "task_id")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled task"))
    return tasks.withColumns({"position": F.row_number().over(order), "title": title})
