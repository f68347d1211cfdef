"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random key, made of its id and text, so that rows
without an id, or sharing one, spread as well. Rows that agree in everything
are counted before they are ordered. Within a source, documents are ordered
by that key; their running sum of sizes is a distributed prefix sum: sizes are
summed per range of the key (the key is uniform, so equal ranges hold equal
shares), the range totals are summed up per source, and the running sums inside
the ranges are added. A source that holds a third of all rows is spread over
many ranges. The last epoch of a source is cut exactly at its budget.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.session import materialise

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Rows that one key range of a source should hold.
RANGE_ROWS = 2_000
#: Equal rows are written out again in lists of at most this many.
COPIES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: dict, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS
) -> dict:
    """Target words of each source: ``share`` of all words by weight, at most ``most`` times its size.

    Sources are ordered by code point, null last, and take the weights in turn.
    What a source cannot take is shared again by weight among the others until
    none is above its limit. Sizes are one number per source.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, epochs``.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: every full epoch of its source takes all of them, the last epoch
    takes documents in key order until the source's budget, the target rounded
    to whole words, is used up exactly; the document at the cut gives a part.
    ``epochs`` is the number of epochs that take any of it. A null text has size
    0 and is never taken; a null source is a source of its own. Repeated rows
    count as rows of their own, ordered among themselves by size; equal rows are
    interchangeable. The per-source figures (one row per source) pass the driver.
    """
    return _mix_sources(docs, id_col, text_col, source_col, **options)


def _mix_sources(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: int = MOST_EPOCHS,
    seed: str = "mix",
    carry: Sequence[Column] = (),
) -> DataFrame:
    """``mix_sources`` with further columns of ``docs``, named ``carry``."""
    id_, text = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in (id_col, text_col))
    single = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col]).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), text)).alias("key"),
        *carry,
    )
    rows = materialise(single.groupBy(*single.columns).agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    all_words = F.col("size") * F.col("copies")
    per_source = rows.groupBy("source").agg(F.sum(all_words).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in per_source}
    targets = source_targets(sizes, weights, share, most)
    ranges = {r["source"]: max(1, -(-r["n"] // RANGE_ROWS)) for r in per_source}
    figures = docs.sparkSession.createDataFrame(
        [(s, sizes[s], targets[s], math.floor(targets[s] + 0.5), ranges[s]) for s in sizes],
        "source string, source_size bigint, target double, budget bigint, ranges int",
    )
    joined = rows.join(F.broadcast(figures), rows["source"].eqNullSafe(figures["source"])).drop(figures["source"])
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("ranges")).cast("int")
    joined = joined.withColumn("part", part)
    before_part = F.coalesce(
        F.sum("part_size").over(
            Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    parts = (
        joined.groupBy("source", "part")
        .agg(F.sum(all_words).alias("part_size"))
        .select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), before_part.alias("ahead"))
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = joined.withColumn("within", F.sum(all_words).over(inside) - all_words)
    same = running["source"].eqNullSafe(parts["p_source"]) & (running["part"] == parts["p_part"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("budget") - F.col("full") * F.col("source_size")
    before = F.col("ahead") + F.col("within") + F.col("copy") * F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - before)).cast("bigint")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint")))
    each = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("copies")) - 1))
    return (
        running.join(parts, same)
        .withColumn("full", full)
        .withColumn("first", first)
        .withColumn("copy", each)
        .withColumn("cut", cut)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("full") * F.col("size") + F.col("cut")).cast("bigint").alias("taken"),
            F.when(F.col("size") == 0, 0)
            .otherwise(F.col("full") + (F.col("cut") > 0).cast("int"))
            .cast("int")
            .alias("epochs"),
            *single.columns[4:],
        )
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """``docs`` with its own columns, each row once per epoch that takes it.

    Documents are not cut: the one at a source's budget is kept whole. Rows
    are told apart by id, source and text; of rows that agree in all three, the
    largest number of epochs holds for each of them.
    """
    key = ["__id", "__source", "__nulls", "__text"]
    nulls = F.concat(docs[id_col].isNull().cast("string"), docs[source_col].isNull().cast("string"))

    def keys(id_: Column, source: Column) -> list:
        return [F.coalesce(id_.cast("string"), F.lit("")).alias("__id"), F.coalesce(source.cast("string"), F.lit("")).alias("__source")]

    tell = [nulls.alias("__nulls"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("__text")]
    mix = _mix_sources(docs, id_col, text_col, source_col, carry=tell, **options)
    mix = mix.select(*keys(F.col("doc_id"), F.col("source")), "__nulls", "__text", "epochs")
    mix = mix.groupBy(*key).agg(F.max("epochs").alias("__epochs")).where("__epochs > 0")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__own"), *keys(docs[id_col], docs[source_col]), *tell)
    joined = own.join(mix, key)
    return joined.select("__own", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select("__own.*")
