"""Merging batches into tables: a new version of the table comes out.

Plain Parquet has no in-place update, so a merge is a full outer join on the
key whose result is written as the next version. Both sides are unique on the
key before they meet (the batch is reduced with map-side combining), so no key
can be hot in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_PATTERN = r"(?i)\bGC[A-Z0-9]+\b"


def extract_codes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct item codes mentioned in each text, upper-cased.

    Keeps every other column as the key of the text; ``position`` is the place
    of the first mention among all mentions.
    """
    keys = [c for c in texts.columns if c != text]
    codes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_PATTERN), F.lit(0))
    distinct = F.array_distinct(F.transform(codes, lambda c: F.upper(c)))
    return texts.select(*keys, F.posexplode(distinct).alias("position", "code"))


def _last(column: str, order: str) -> Column:
    """Last non-missing value in batch order."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert new keys, overwrite only the fields a batch provides.

    A missing value means "not provided". ``change`` is inserted, updated or
    kept; ``order`` decides between rows of one batch.
    """
    payload = [c for c in batch.columns if c not in (*keys, order)]
    latest = batch.groupBy(*keys).agg(*[_last(c, order).alias(f"new_{c}") for c in payload]).withColumn("in_batch", F.lit(True))
    merged = existing.withColumn("in_table", F.lit(True)).join(latest, keys, "full")
    change = F.when(F.col("in_table").isNull(), "inserted").when(F.col("in_batch"), "updated").otherwise("kept")
    columns = [
        F.coalesce(f"new_{c}", c).alias(c) if c in payload else F.col(c) for c in existing.columns if c not in keys
    ]
    return merged.select(*keys, *columns, change.alias("change"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy().agg(
        F.count_if(F.col("change") == "inserted").alias("inserted"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def resolve_items(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Replaces ``code`` by ``item_id``; rows of unknown codes drop out."""
    return batch.join(items.select("code", "item_id"), "code").drop("code")


def upsert_finds(existing: DataFrame, batch: DataFrame, items: DataFrame) -> DataFrame:
    """Finds by (user, item): the first date ever stored stays, the last notes win.

    ``batch`` holds ``user_id, code, found_date, notes, notes_present, ord``;
    present but missing notes clear the stored ones.
    """
    known = resolve_items(batch, items)
    said = F.when(F.col("notes_present"), F.col("ord"))
    latest = known.groupBy("user_id", "item_id").agg(
        F.min_by("found_date", "ord").alias("new_date"),
        F.max_by(F.struct("notes"), said).alias("new_notes"),
    )
    merged = existing.withColumn("in_table", F.lit(True)).join(
        latest.withColumn("in_batch", F.lit(True)), ["user_id", "item_id"], "full"
    )
    notes = F.when(F.col("new_notes").isNotNull(), F.col("new_notes.notes")).otherwise(F.col("notes"))
    change = F.when(F.col("in_table").isNull(), "inserted").when(F.col("in_batch"), "updated").otherwise("kept")
    return merged.select(
        "user_id", "item_id", F.coalesce("found_date", "new_date").alias("found_date"), notes.alias("notes"), change.alias("change")
    )


def existing_items(codes: DataFrame, items: DataFrame) -> DataFrame:
    """(code, item_id) of the codes that exist."""
    return items.select("code", "item_id").join(codes.select("code").distinct(), "code", "left_semi")


def count_existing_finds(asked: DataFrame, finds: DataFrame, items: DataFrame) -> DataFrame:
    """Per user, how many of the asked codes the user has found already."""
    pairs = resolve_items(asked.select("user_id", "code").distinct(), items)
    return pairs.join(finds, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("existing")
    )


def sync_finds(listed: DataFrame, finds: DataFrame, items: DataFrame) -> DataFrame:
    """What an authoritative list changes: (user_id, code, item_id, action).

    Only users with a list are touched. ``action`` is add, delete, keep or
    unknown (a code no item has).
    """
    wanted = listed.select("user_id", "code").distinct()
    resolved = wanted.join(items.select("code", "item_id"), "code", "left").withColumn("listed", F.lit(True))
    current = (
        finds.join(wanted.select("user_id").distinct(), "user_id", "left_semi")
        .select("user_id", "item_id").withColumn("stored", F.lit(True))
    )
    known = resolved.where("item_id IS NOT NULL").join(current, ["user_id", "item_id"], "full")
    action = F.when(F.col("stored").isNull(), "add").when(F.col("listed").isNull(), "delete").otherwise("keep")
    unknown = resolved.where("item_id IS NULL").select("user_id", "code", "item_id", F.lit("unknown").alias("action"))
    return known.select("user_id", "code", "item_id", action.alias("action")).unionByName(unknown)


def sync_report(actions: DataFrame) -> DataFrame:
    def n(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    return actions.groupBy("user_id").agg(
        (F.count(F.lit(1)) - n("delete")).alias("nb_provided"),
        n("add").alias("nb_added"), n("delete").alias("nb_deleted"), n("unknown").alias("nb_unknown"),
    )


def apply_sync(finds: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """The finds table after the sync; new finds are dated ``as_of`` without notes."""
    gone = actions.where("action = 'delete'").select("user_id", "item_id")
    added = actions.where("action = 'add'").select(
        "user_id", "item_id", F.lit(as_of).cast("date").alias("found_date"), F.lit(None).cast("string").alias("notes")
    )
    kept = finds.join(gone, ["user_id", "item_id"], "left_anti")
    return kept.select("user_id", "item_id", "found_date", "notes").unionByName(added)


# Fixed value: the attribute that marks an item as a challenge.
CHALLENGE_ATTRIBUTE = 71


def create_challenges(items: DataFrame, challenges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """New challenges for items marked as one and not registered yet.

    Running it again on the extended table yields nothing.
    """
    marked = items.where(
        F.exists("attributes", lambda a: (a["attr_id"] == CHALLENGE_ATTRIBUTE) & a["is_positive"])
    )
    if subset is not None:
        marked = marked.join(subset.select("item_id").distinct(), "item_id", "left_semi")
    fresh = marked.join(challenges.select("item_id"), "item_id", "left_anti")
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Challenge "), F.col("code")))
    return fresh.select(F.col("item_id").alias("challenge_id"), "item_id", name.alias("name"), "description")


def challenge_counts(items: DataFrame, challenges: DataFrame) -> DataFrame:
    """matched / created / skipped of ``create_challenges``."""
    marked = items.where(
        F.exists("attributes", lambda a: (a["attr_id"] == CHALLENGE_ATTRIBUTE) & a["is_positive"])
    ).select("item_id")
    known = challenges.select("item_id", F.lit(True).alias("known"))
    return marked.join(known, "item_id", "left").groupBy().agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col("known").isNull()).alias("created"), F.count_if("known").alias("skipped")
    )


def publish(df: DataFrame, base: str, version: str) -> str:
    """Write the next version of a table beside the old one and return its path;
    readers switch by path, so a half-written version is never read."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("error").parquet(path)
    return path
