"""Exact duplicates with a separate way for frequent texts.

Frequent digests are found with mergeable Misra-Gries summaries
(``approx_top_k`` over shards of the digest space), then verified by exact
counts. The winners, at most ``frequent`` rows, are broadcast and resolve their
copies on the map side, so a text that makes up a third of all rows is never
shuffled. All other digests are resolved by an ordinary shuffle of digests and
row ids; texts are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.session import materialise

#: Shards of the digest space; each has its own summary, merged independently.
SHARDS = 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def frequent_digests(digests: DataFrame, frequent: int = 1024, tracked: int = 4096) -> DataFrame:
    """At most ``frequent`` digests that are really frequent, with exact figures.

    Returns ``digest, winner struct<doc_id, tag>, group_size``. A digest below
    one in ``4 * frequent`` rows is left to the shuffle.
    """
    least = max(2, digests.count() // (4 * frequent))
    key = F.xxhash64("digest")
    found = (
        digests.select(key.alias("h"))
        .groupBy(F.pmod("h", F.lit(SHARDS)).alias("shard"))
        .agg(F.expr(f"approx_top_k(h, {max(1, frequent // SHARDS)}, {tracked})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where(F.col("t.count") >= least)
        .select(F.col("t.item").alias("h"))
    )
    return (
        digests.withColumn("h", key)
        .join(F.broadcast(found), "h", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "tag")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
        .orderBy(F.desc("group_size"), "digest")
        .limit(frequent)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text equals the
    empty one. A null id ranks below every other id; of rows that also agree in
    the id exactly one is kept. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    digests = materialise(
        docs.select(
            docs[id_col].cast("bigint").alias("doc_id"),
            text_digest(docs[text_col]).alias("digest"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "digests",
    )
    winners = materialise(frequent_digests(digests, frequent), "frequent")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    known = marked.where(F.col("winner").isNotNull())
    same = Window.partitionBy("digest")
    others = (
        marked.where(F.col("winner").isNull())
        .select("doc_id", "digest", "tag")
        .select(
            "doc_id",
            "digest",
            "tag",
            F.max(F.struct("doc_id", "tag")).over(same).alias("winner"),
            F.count(F.lit(1)).over(same).alias("group_size"),
        )
    )
    return known.select(others.columns).unionByName(others).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("winner.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each text.

    Decisions are joined on id and digest; rows that repeat in both are reduced
    to one on the same partitioning.
    """
    key = ["__id", "__null", "__sha"]

    def keys(column, sha) -> list:
        return [F.coalesce(column, F.lit(0)).alias("__id"), column.isNull().alias("__null"), sha.alias("__sha")]

    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(*keys(F.col("doc_id"), F.col("text_sha256")))
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__own"), *keys(docs[id_col].cast("bigint"), sha))
    joined = rows.join(kept, key, "left_semi")
    first = Window.partitionBy(*key).orderBy("__sha")
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__own.*")
