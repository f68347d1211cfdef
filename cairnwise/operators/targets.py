"""Recommending items that help unfinished tasks.

The reference list for one signature is built once: eligible items in id
order, cut into numbered blocks. A task that may show L items, of which its
user already excludes x (found or owned), needs at most the first L + x of
that list, so it joins only those blocks, and of these only as many as hold L
items its user may see. A block travels as one array, so candidates become
rows only where they are scored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnwise.functions import geo, grids
from cairnwise.operators.progress import rule_hits, with_rules
from cairnwise.operators.rule_index import StoredRules
from cairnwise.operators.rules import RuleSet, predicate
from cairnwise.operators.search import cell_width, grid_probes, with_cells
from cairnwise.session import materialise, materialise_dealt

# Limits and score weights.
LIMIT_PER_TASK = 200
HARD_LIMIT = 2000
WEIGHTS = {"urgency": 0.4, "coverage": 0.3, "geographic": 0.3}

# What a target shows of its item.
ITEM_COLUMNS = ["code", "title", "owner", "difficulty", "terrain", "type_code", "lat", "lon"]

BLOCK = 64
ID_BUCKETS = 512
# Nearly every task reads the first blocks; these are repeated over salts.
SALTED_BLOCKS, SALTS = 4, 16
# Lists with so many entries altogether, and so many shown items, are broadcast.
BROADCAST_ENTRIES, BROADCAST_ITEMS = 4_000_000, 500_000
# Candidates are dealt in parts of about so many.
ROWS_PER_PARTITION = 1_000_000


def open_tasks(
    tasks: DataFrame, enrolments: DataFrame, percents: DataFrame, rules: RuleSet | StoredRules, and_only: bool = True
) -> DataFrame:
    """Unfinished tasks of accepted enrolments, with ratio and the enrolment's
    number of unfinished tasks (unsupported ones count there as well).
    ``place`` numbers an enrolment's tasks: the best ratio comes last, of equal
    ones the lower order, so that the last place is the primary task.

    Rules come from a ``RuleSet`` by ``rule_id``, or from the tasks' own
    expressions with ``StoredRules``; with ``and_only=False`` or/not take part.

    ``percents`` holds (task_id, percent); a task without one stands at 0.
    """
    accepted = enrolments.where("status = 'accepted'").select("uc_id")
    rows = (
        with_rules(tasks, rules, and_only)
        .join(accepted, "uc_id", "left_semi")
        .join(percents.select("task_id", "percent"), "task_id", "left")
        .withColumn("percent", F.coalesce("percent", F.lit(0.0)))
        .where(F.col("percent") < 100)
        .withColumn("incomplete", F.count(F.lit(1)).over(W.partitionBy("uc_id")))
    )
    by_ratio = W.partitionBy("uc_id").orderBy("ratio", -F.col("ord"), "task_id")
    return rows.where("supported").withColumn("ratio", F.col("percent") / 100.0).select(
        "task_id", "uc_id", "user_id", "ord", "sig", "agg_kind", "max_d", "max_t",
        "ratio", "incomplete", F.row_number().over(by_ratio).alias("place"),
    )


def eligible(items: DataFrame) -> DataFrame:
    """Neither disabled nor archived; an unknown status is fine."""
    return items.where(~F.coalesce("status", F.lit("")).isin("disabled", "archived"))


def _matrix_variants(rules: RuleSet) -> set[tuple[int, float, float]]:
    return {
        (r.sig, r.aggregate["max_d"], r.aggregate["max_t"])
        for r in rules.rules
        if r.aggregate and r.aggregate["kind"] == "dt_matrix"
    }


def posting_keys(rules: RuleSet) -> Column:
    """The lists an item belongs to: one per plain signature, and for matrix
    rules one per signature and grid cell (off-grid items get their own)."""
    variants = _matrix_variants(rules)
    plain = {r.sig for r in rules.rules if not (r.aggregate and r.aggregate["kind"] == "dt_matrix")}
    index = grids.cell_index(F.col("difficulty"), F.col("terrain"))
    keys = [F.when(predicate(rules.signatures[s]), F.lit(f"{s}")) for s in sorted(plain)]
    for sig, max_d, max_t in sorted(variants):
        inside = F.col("difficulty").between(1.0, max_d) & F.col("terrain").between(1.0, max_t)
        holds = predicate(rules.signatures[sig]) & inside
        keys.append(
            F.when(holds & index.isNotNull(), F.concat(F.lit(f"{sig}|"), index.cast("string")))
            .when(holds, F.lit(f"{sig}|off|{max_d}|{max_t}"))
        )
    return F.array_distinct(F.array_compact(F.array(*keys)))


def item_lists(items: DataFrame, tasks: DataFrame, rules: RuleSet | StoredRules) -> DataFrame:
    """(item_id, lat, lon, keys): eligible items and the lists they belong to.

    A ``RuleSet`` answers with one expression per signature. Stored rules
    answer with their (item, rule) pairs; ``tasks`` tell which of them are
    matrix rules, and up to which difficulty and terrain.
    """
    if isinstance(rules, RuleSet):
        return eligible(items).select("item_id", "lat", "lon", posting_keys(rules).alias("keys")).where(F.size("keys") > 0)
    matrix = F.coalesce(F.col("agg_kind") == "dt_matrix", F.lit(False))
    forms = tasks.groupBy("sig").agg(
        F.max(~matrix).alias("plain"), F.collect_set(F.when(matrix, F.struct("max_d", "max_t"))).alias("variants")
    )
    name = F.col("sig").cast("string")
    index = grids.cell_index(F.col("difficulty"), F.col("terrain"))

    def cell_list(v: Column) -> Column:
        inside = F.col("difficulty").between(F.lit(1.0), v["max_d"]) & F.col("terrain").between(F.lit(1.0), v["max_t"])
        off = F.concat_ws("|", name, F.lit("off"), v["max_d"].cast("string"), v["max_t"].cast("string"))
        return F.when(inside, F.when(index.isNotNull(), F.concat_ws("|", name, index.cast("string"))).otherwise(off))

    own = F.when(F.col("plain"), F.array(name)).otherwise(F.array().cast("array<string>"))
    keys = F.array_compact(F.concat(own, F.transform("variants", cell_list)))
    shown = eligible(items).select("item_id", "lat", "lon", "difficulty", "terrain")
    rows = rules.pairs(items).join(forms, "sig").join(shown, "item_id").select("item_id", "lat", "lon", keys.alias("keys")).where(F.size("keys") > 0)
    lists = rows.groupBy("item_id", "lat", "lon").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    return materialise(lists, "item-lists")


def covered_cells(tasks: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules) -> DataFrame:
    """(user_id, sig, cells_low, cells_high): grid cells a user's matching finds
    cover, for the users of matrix tasks."""
    asking = tasks.where("agg_kind = 'dt_matrix'").select("user_id", "sig").distinct()
    hits = rule_hits(finds, items, asking, rules)
    low, high = grids.cell_bits(grids.cell_index(F.col("difficulty"), F.col("terrain")))
    return hits.groupBy("user_id", "sig").agg(F.bit_or(low).alias("cells_low"), F.bit_or(high).alias("cells_high"))


def task_keys(tasks: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules) -> DataFrame:
    """Tasks with the lists they draw from (``key``): their signature, or for a
    matrix task one list per cell its user has not covered yet."""
    plain = tasks.where("agg_kind IS NULL OR agg_kind <> 'dt_matrix'").withColumn("key", F.col("sig").cast("string"))
    if isinstance(rules, RuleSet) and not _matrix_variants(rules):
        return plain
    free = grids.cells_within(F.col("cells_low"), F.col("cells_high"), F.col("max_d"), F.col("max_t"), present=False)
    off = F.concat_ws("|", F.col("sig").cast("string"), F.lit("off"), F.col("max_d").cast("string"), F.col("max_t").cast("string"))
    cell_keys = F.transform(free, lambda i: F.concat_ws("|", F.col("sig").cast("string"), i.cast("string")))
    matrix = (
        tasks.where("agg_kind = 'dt_matrix'")
        .join(covered_cells(tasks, finds, items, rules), ["user_id", "sig"], "left")
        .withColumn("key", F.explode(F.array_append(cell_keys, off)))
        .drop("cells_low", "cells_high")
    )
    return plain.unionByName(matrix)


def excluded_items(users: DataFrame, finds: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id) a user must not be shown: found or own items; a pair may come twice."""
    owned = items.select("item_id", F.col("owner").alias("username")).join(
        users.select("user_id", "username"), "username"
    )
    return finds.select("user_id", "item_id").unionByName(owned.select("user_id", "item_id"))


def _id_buckets(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """``postings`` with ``bucket``: buckets between the quantiles of ``ids``, in their order.

    The bounds are fetched once: approximate quantiles may come out otherwise in
    another run, and every use of the buckets must agree.
    """
    shares = [i / ID_BUCKETS for i in range(1, ID_BUCKETS)]
    bounds = ids.agg(F.percentile_approx("item_id", shares, 20 * ID_BUCKETS)).first()[0] or []
    # how many bounds lie below the id: every 16th one first, then those in between
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("item_id")))
    fixed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    return postings.withColumn("coarse", below(fixed(bounds[15::16]))).select(
        *postings.columns, (F.col("coarse") * 16 + below(F.slice(fixed(bounds), F.col("coarse") * 16 + 1, 16))).alias("bucket")
    )


def ranked_postings(postings: DataFrame, ids: DataFrame, deepest: DataFrame | None = None) -> DataFrame:
    """Adds ``rank`` (1-based, by id) per list without sorting a list in one task.

    Items are bucketed by quantiles of the ids, so outlying ids do not crowd the
    others into few buckets; bucket counts give each bucket its offset in the
    list, and ranks are counted inside a bucket only. Postings that come with
    their ``bucket`` keep it. With ``deepest`` (key, deepest) only lists that it
    holds are ranked, so far, and buckets that begin below are left where they are.
    """
    bucketed = postings if "bucket" in postings.columns else _id_buckets(postings, ids)
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = W.partitionBy("key", "bucket").orderBy("item_id")
    rank = (F.col("offset") + F.col("rn")).alias("rank")
    if deepest is None:
        ranked = bucketed.withColumn("rn", F.row_number().over(inside)).join(offsets, ["key", "bucket"])
        return ranked.select("key", "item_id", rank)
    read = materialise(offsets.join(deepest, "key").where(F.col("offset") < F.col("deepest")), "read-buckets")
    read = F.broadcast(read) if read.count() <= BROADCAST_ITEMS else read
    ranked = bucketed.join(read, ["key", "bucket"]).withColumn("rn", F.row_number().over(inside))
    return ranked.select("key", "item_id", rank, "deepest").where(F.col("rank") <= F.col("deepest")).drop("deepest")


def list_needs(keyed: DataFrame, excluded: DataFrame, limit: int) -> DataFrame:
    """``keyed`` with ``need``: how far down a list a task can have to read at
    most, namely ``limit`` plus all that its user excludes."""
    most = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("most"))
    need = F.lit(limit) + F.coalesce("most", F.lit(0))
    return keyed.join(most, "user_id", "left").withColumn("need", need).drop("most")


def list_blocks(postings: DataFrame, list_key: str, entry: Column, at: str) -> DataFrame:
    """(list, block, entries, n, first, last): each list cut into blocks of ``BLOCK``
    entries in rank order, with the least and greatest ``at`` of the block."""
    gathered = postings.groupBy(list_key, _block_of(F.col("rank")).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")
    )
    return gathered.select(list_key, "block", F.col("rows.entry").alias("entries"), F.size("rows").alias("n"), "first", "last")


def _block_of(rank: Column) -> Column:
    return F.floor((rank - 1) / F.lit(BLOCK)).cast("int")


def hidden_places(needs: DataFrame, excluded: DataFrame, postings: DataFrame, list_key: str) -> DataFrame:
    """(user_id, list, block, hidden): the places (from 0) in a block that the user
    excludes, for the lists that the user's tasks read.

    Items carry their places, users their lists, so an excluded pair stays one
    row until its real places are exploded.
    """
    place = F.struct(F.col(list_key), _block_of(F.col("rank")).alias("block"), F.pmod(F.col("rank") - 1, F.lit(BLOCK)).cast("int").alias("at"))
    places = materialise(postings.groupBy("item_id").agg(F.collect_list(place).alias("places")), "item-places")
    places = F.broadcast(places) if places.count() <= BROADCAST_ITEMS else places
    reading = needs.groupBy("user_id").agg(F.collect_set(list_key).alias("lists"))
    own = F.filter("places", lambda p: F.array_contains("lists", p[list_key]))
    return (
        excluded.join(places, "item_id").join(reading, "user_id")
        .select("user_id", F.inline(own))
        .groupBy("user_id", list_key, "block").agg(F.collect_set("at").alias("hidden"))
    )


def _meet(asks: DataFrame, blocks: DataFrame, list_key: str, small: bool) -> DataFrame:
    """Asks with their block; unless the blocks are broadcast, the first blocks of the lists,
    which nearly every task reads, are repeated over salts."""
    if small:
        return asks.join(F.broadcast(blocks), [list_key, "block"])
    head = F.col("block") < SALTED_BLOCKS
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = blocks.withColumn("salt", F.explode(F.when(head, every).otherwise(F.array(F.lit(0)))))
    dealt = asks.withColumn("salt", F.when(head, F.pmod(F.hash("task_id"), F.lit(SALTS))).otherwise(F.lit(0)))
    return dealt.join(spread, [list_key, "block", "salt"]).drop("salt")


def _parts(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_PARTITION))


def block_asks(needs: DataFrame, blocks: DataFrame, hidden: DataFrame, list_key: str, limit: int, small: bool) -> DataFrame:
    """Each task with the blocks it has to read (``block``, ``n``, ``hidden``).

    The blocks of all lists of a task, in the order of their last entries, are
    counted without what its user excludes. Where they hold ``limit`` entries,
    no block that begins later can matter.
    """
    last_block = _block_of(F.col("need"))
    lengths = blocks.groupBy(list_key).agg(F.max("block").alias("end"))
    asks = (
        needs.join(lengths, list_key)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.least(last_block, "end")))).drop("need", "end")
    )
    asks = _meet(asks, blocks.drop("entries"), list_key, small).join(hidden, ["user_id", list_key, "block"], "left")
    passed = W.partitionBy("uc_id", "task_id").orderBy("last").rowsBetween(W.unboundedPreceding, 0)
    shown = F.col("n") - F.coalesce(F.size("hidden"), F.lit(0))
    enough = F.min(F.when(F.col("held") >= limit, F.col("last"))).over(W.partitionBy("uc_id", "task_id"))
    needed = F.col("enough").isNull() | F.col("first").isNull() | (F.col("first") <= F.col("enough"))
    return asks.withColumn("held", F.sum(shown).over(passed)).withColumn("enough", enough).where(needed).drop("first", "last", "held", "enough")


def drawn(
    tasks: DataFrame, needs: DataFrame, excluded: DataFrame, postings: DataFrame, list_key: str, entry: Column, at: str, limit: int
) -> DataFrame:
    """Each task with the first ``limit`` entries (``entry``, of all its lists
    together) that its user does not exclude.

    Entries travel as blocks, never one by one, and are dealt by enrolment in as
    many parts as they ask for, so whatever is grouped within an enrolment
    afterwards (``score``) needs no further shuffle.
    """
    blocks = materialise(list_blocks(postings, list_key, entry, at), "blocks")
    small = (blocks.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ENTRIES
    hidden = hidden_places(needs, excluded, postings, list_key)
    asks = materialise(block_asks(needs, blocks, hidden, list_key, limit, small), "asks")
    parts = _parts(asks.agg(F.sum("n")).first()[0] or 0)
    entries = blocks.select(list_key, "block", "entries")
    if small:
        rows = _meet(asks.repartition(parts, "uc_id"), entries, list_key, small)
    else:
        rows = _meet(asks, entries, list_key, small).repartition(parts, "uc_id")
    kept = F.filter("entries", lambda _, i: ~F.array_contains("hidden", i))
    shown = F.when(F.col("hidden").isNull(), F.col("entries")).otherwise(kept)
    firsts = F.slice(F.sort_array(F.flatten(F.collect_list(shown))), 1, max(limit, 0))
    out = rows.groupBy(*tasks.columns).agg(firsts.alias("entries")).select(*tasks.columns, F.explode("entries").alias("entry"))
    of_task = asks.groupBy(*tasks.columns).agg(F.least(F.sum("n"), F.lit(max(limit, 0))).alias("n"))
    most = of_task.groupBy("uc_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    out.drawn = Drawn(parts, most, postings.select("item_id"))
    return out


class Drawn(NamedTuple):
    """What is known of candidates when they are drawn. The frame that ``candidates_by_rank`` or
    ``candidates_by_distance`` returns carries it (``drawn``), frames derived from that do not."""

    parts: int  # its rows are dealt by enrolment in so many parts
    most: int  # no enrolment has more rows
    ids: DataFrame  # holds the ids of all its items


def _with_drawn(df: DataFrame, source: DataFrame) -> DataFrame:
    df.drawn = source.drawn
    return df


def _inputs(tasks, users, finds, items, rules):
    """The open tasks, their list keys, the excluded pairs and the items' keys.

    Tasks and keys are small next to finds and items and are read several
    times below; each is written once to the shared folder, so no later step
    runs the progress evaluation again.
    """
    tasks = materialise(tasks, "open-tasks")
    keyed = materialise(task_keys(tasks, finds, items, rules), "task-keys")
    item_keys = item_lists(items, tasks, rules)
    return tasks, keyed, excluded_items(users, finds, items), item_keys


def candidates_by_rank(
    tasks: DataFrame, users: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules, limit: int = LIMIT_PER_TASK
) -> DataFrame:
    """(task, item) with the first ``limit`` items per task by id."""
    tasks, keyed, excluded, item_keys = _inputs(tasks, users, finds, items, rules)
    needs = materialise(list_needs(keyed, excluded, limit), "task-needs")
    deepest = needs.groupBy("key").agg(F.max("need").alias("deepest"))
    bucketed = _id_buckets(item_keys.select("item_id", "keys"), items)
    postings = materialise(ranked_postings(bucketed.select("item_id", "bucket", F.explode("keys").alias("key")), items, deepest), "postings")
    shown = drawn(tasks, needs, excluded, postings, "key", F.col("item_id"), "item_id", limit)
    return _with_drawn(shown.select(*tasks.columns, F.col("entry").alias("item_id"), F.lit(None).cast("double").alias("distance_m")), shown)


def candidates_by_distance(
    tasks: DataFrame, centres: DataFrame, users: DataFrame, finds: DataFrame, items: DataFrame, rules: RuleSet | StoredRules,
    radius_km: float, limit: int = LIMIT_PER_TASK, split: int = 16,
) -> DataFrame:
    """(task, item) with the nearest ``limit`` items per task inside a radius.

    ``centres`` holds (user_id, centre_lat, centre_lon). Lists are made per
    distinct place and list key, not per task. Counting items per grid cell
    first tells how far out a list must reach to hold all its tasks can need;
    only cells up to there are joined with items. Tasks then read their list
    by rank as in ``candidates_by_rank``.
    """
    tasks, keyed, excluded, item_keys = _inputs(tasks, users, finds, items, rules)
    places = centres.select("user_id", "centre_lat", "centre_lon", F.concat_ws(":", "centre_lat", "centre_lon").alias("centre"))
    needs = materialise(
        list_needs(keyed, excluded, limit).join(places, "user_id")
        .withColumn("list", F.concat_ws("@", "key", "centre")),
        "task-needs",
    )
    lists = needs.groupBy("list", "key", "centre_lat", "centre_lon").agg(F.max("need").alias("deepest"))
    width = cell_width(radius_km, split)
    listed = with_cells(item_keys.select("item_id", "lat", "lon", F.explode("keys").alias("key")), width)
    counts = listed.groupBy("key", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    outward = W.partitionBy("list").orderBy("farthest_m", "cy", "cx").rowsBetween(W.unboundedPreceding, 0)
    probes = (
        grid_probes(lists, radius_km, split).join(counts, ["key", "cy", "cx"])
        .withColumn("held", F.sum("n").over(outward))
        .withColumn("enough_m", F.min(F.when(F.col("held") >= F.col("deepest"), F.col("farthest_m"))).over(W.partitionBy("list")))
        .where(F.col("enough_m").isNull() | (F.col("nearest_m") <= F.col("enough_m")))
        .select("list", "key", "cy", "cx", "centre_lat", "centre_lon", "deepest")
    )
    distance = geo.haversine_km(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon")) * 1000
    by_distance = W.partitionBy("list").orderBy("distance_m", "item_id")
    postings = materialise(
        listed.join(probes, ["key", "cy", "cx"])
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius_km * 1000)
        .withColumn("rank", F.row_number().over(by_distance).cast("long"))
        .where(F.col("rank") <= F.col("deepest"))
        .select("list", "item_id", "distance_m", "rank"),
        "postings",
    )
    needs = needs.drop("key", "centre_lat", "centre_lon", "centre")
    shown = drawn(tasks, needs, excluded, postings, "list", F.struct("distance_m", "item_id"), "distance_m", limit)
    return _with_drawn(shown.select(*tasks.columns, "entry.item_id", "entry.distance_m"), shown)


def _shown_items(candidates: DataFrame, items: DataFrame) -> tuple[DataFrame, bool]:
    """``items`` as scores show them, and whether they are broadcast. Few items are broadcast, of many those that are
    candidates at all, so that the scored rows stay where they are; the lists that
    candidates were drawn from tell these without drawing them once more."""
    shown = items.withColumn("type_code", F.coalesce(F.lower("type_code"), F.lit("unknown"))).select("item_id", *ITEM_COLUMNS)
    if items.count() > BROADCAST_ITEMS:
        drawn_from = getattr(candidates, "drawn", None)
        ids = candidates.select("item_id") if drawn_from is None else drawn_from.ids
        shown = materialise(shown.join(ids.distinct(), "item_id", "left_semi"), "candidate-items")
        if shown.count() > BROADCAST_ITEMS:
            return shown, False
    return F.broadcast(shown), True


def score(
    candidates: DataFrame, items: DataFrame, hard_limit: int = HARD_LIMIT, radius_km: float | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """One row per (enrolment, item): matched tasks, primary task and scores.

    At most ``hard_limit`` items per enrolment are kept, those of earlier tasks
    first, then by distance and id. Only numbers are aggregated, so rows are
    grouped by hash; the candidates' ``place`` tells the primary task.
    """
    w = {**WEIGHTS, **(weights or {})}
    merged = candidates.groupBy("uc_id", "user_id", "item_id").agg(
        F.count(F.lit(1)).alias("matched_tasks"),
        F.max("ratio").alias("best_ratio"),
        F.max_by("task_id", "place").alias("primary_task_id"),
        F.max("incomplete").alias("incomplete"),
        F.min("ord").alias("first_ord"),
        F.min("distance_m").alias("distance_m"),
    )
    order = W.partitionBy("uc_id").orderBy("first_ord", F.asc_nulls_first("distance_m"), "item_id")
    known = getattr(candidates, "drawn", None)
    kept = merged
    if known is None or known.most > hard_limit:
        kept = merged.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= hard_limit).drop("rn")
    urgency = F.least("best_ratio", F.lit(1.0))
    coverage = F.when(F.col("incomplete") > 0, F.least(F.col("matched_tasks") / F.col("incomplete"), F.lit(1.0))).otherwise(0.0)
    near = F.lit(0.0)
    if radius_km is not None:
        near = F.coalesce(geo.proximity_score(F.col("distance_m"), F.lit(float(radius_km))), F.lit(0.0))
    total = F.col("urgency") * w["urgency"] + F.col("coverage") * w["coverage"] + F.col("geographic") * w["geographic"]
    rows = (
        kept.withColumns({"urgency": urgency, "coverage": coverage, "geographic": near})
        .withColumn("score", F.least(total, F.lit(1.0)))
        .drop("best_ratio", "incomplete", "first_ord")
    )
    shown, small = _shown_items(candidates, items)
    scored = rows.join(shown, "item_id")
    if known is not None and small:
        scored.stored_as = Stored(rows, shown, known.parts)
    return scored


class Stored(NamedTuple):
    """How ``store_targets`` writes scored targets whose items are broadcast."""

    rows: DataFrame  # the targets without what they show of their items
    shown: DataFrame
    parts: int


def store_targets(scored: DataFrame, label: str) -> DataFrame:
    """The targets of ``score`` written once, dealt by enrolment as they were scored, so that later
    joins and groupings within enrolments need no shuffle. What targets show of their items
    is met when they are read, so texts are not written once a target."""
    how = getattr(scored, "stored_as", None)
    if how is None:
        return materialise(scored, label)
    return materialise_dealt(how.rows, label, "uc_id", how.parts).join(how.shown, "item_id")


def needs_evaluation(
    enrolments: DataFrame, existing: DataFrame, limit: int = LIMIT_PER_TASK, hard_limit: int = HARD_LIMIT
) -> DataFrame:
    """Accepted enrolments that do not hold enough targets yet."""
    enough = min(hard_limit, 5 * limit)
    full = existing.groupBy("uc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    return enrolments.where("status = 'accepted'").join(full.select("uc_id"), "uc_id", "left_anti")


def merge_targets(existing: DataFrame, scored: DataFrame, evaluated: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Upsert on (enrolment, item); ``change`` is inserted, updated, same or kept.

    With ``evaluated`` (the enrolments of a forced run) their old targets are
    dropped first, so everything of theirs is inserted.

    ``dealt`` tells that both tables are stored by enrolment (``store_targets``):
    rows then meet where they lie, if Spark may join on more than the columns
    they are dealt by, which is allowed here for the session. It changes no rows.
    """
    if evaluated is not None:
        gone = materialise(evaluated.select("uc_id").distinct(), "evaluated")
        existing = existing.join(F.broadcast(gone) if gone.count() <= BROADCAST_ENTRIES else gone.hint("shuffle_hash"), "uc_id", "left_anti")
    if dealt:
        existing.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    keys = ["uc_id", "item_id"]
    columns = [c for c in scored.columns if c not in keys]
    shown = [c for c in ITEM_COLUMNS if c in columns]
    variants = _item_variants(existing, scored, shown) if shown and not dealt else None
    if variants is not None:
        existing, scored = (_coded(df, variants, shown) for df in (existing, scored))
    payload = [c for c in scored.columns if c not in keys]
    new = scored.select(*keys, F.struct(*payload).alias("new"))
    old = existing.select(*keys, F.struct(*payload).alias("old"))
    change = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "kept")
        .when(F.col("old").eqNullSafe(F.col("new")), "same")
        .otherwise("updated")
    )
    row = [F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col("old")[c]).alias(c) for c in payload]
    merged = old.join(new, keys, "full").select(*keys, *row, change.alias("change"))
    if variants is not None:
        merged = merged.join(F.broadcast(variants.select("variant", *shown)), "variant", "left")
    return merged.select(*keys, *columns, "change")


def _item_variants(existing: DataFrame, scored: DataFrame, shown: list[str]) -> DataFrame | None:
    """The distinct ``shown`` columns of items in both tables, numbered; none if they are too many to broadcast."""
    both = existing.select("item_id", *shown).unionByName(scored.select("item_id", *shown)).distinct()
    variants = materialise(both.withColumn("variant", F.monotonically_increasing_id()), "item-variants")
    return variants if variants.count() <= BROADCAST_ITEMS else None


def _coded(df: DataFrame, variants: DataFrame, shown: list[str]) -> DataFrame:
    """``df`` with ``variant`` for its ``shown`` columns, so that their texts do not travel."""
    names = {c: f"_{c}" for c in ("item_id", *shown)}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(F.broadcast(variants.withColumnsRenamed(names)), same).drop(*names.values(), *shown)


def evaluation_counts(merged: DataFrame) -> DataFrame:
    """Inserted, updated and total targets per user."""
    return merged.groupBy("user_id").agg(
        F.countDistinct("uc_id").alias("enrolments"),
        F.count_if(F.col("change") == "inserted").alias("inserted"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def clear_targets(targets: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Targets without those of the given enrolments."""
    return targets.join(enrolments.select("uc_id").distinct(), "uc_id", "left_anti")


def parse_sort(text: str, allowed: dict[str, str]) -> list[Column]:
    """``"-score,code"`` as ordering; unknown names are an error."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        name = allowed[part.lstrip("-")]
        out.append(F.desc(name) if part.startswith("-") else F.asc(name))
    return out


SORTABLE = {"score": "score", "code": "code", "distance": "distance_m", "matched_tasks": "matched_tasks", "item_id": "item_id"}


def list_targets(
    targets: DataFrame, sort: str = "-score", page: int = 1, size: int = 50, enrolments: DataFrame | None = None,
    status: str | None = None,
) -> DataFrame:
    """A page of targets per user with the user's total and page count.

    ``status`` keeps only targets of enrolments with that status.
    """
    if status is not None:
        targets = targets.join(enrolments.where(F.col("status") == status).select("uc_id").hint("shuffle_hash"), "uc_id", "left_semi")
    order = W.partitionBy("user_id").orderBy(*parse_sort(sort, SORTABLE), "uc_id", "item_id")
    totals = targets.groupBy("user_id").agg(F.count(F.lit(1)).alias("nb_items"))
    last = page * size
    rows = targets.withColumn("position", F.row_number().over(order)).where(
        (F.col("position") <= last) & (F.col("position") > last - size)
    )
    return rows.join(totals, "user_id").withColumn("nb_pages", F.ceil(F.col("nb_items") / F.lit(size)).cast("long"))


def targets_nearby(targets: DataFrame, places: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """Targets within a radius of their user's place (``user_id, place_lat, place_lon``).

    Places travel to the enrolments, not targets to the users: each enrolment takes
    its user's place, and targets take it from there. Those without an enrolment ask their user.
    """
    targets, places = targets.drop("distance_m"), places.select("user_id", "place_lat", "place_lon")
    columns = ["user_id", *[c for c in targets.columns if c != "user_id"], "place_lat", "place_lon"]
    of_enrolment = (
        targets.where("uc_id IS NOT NULL").select("uc_id", "user_id").distinct()
        .join(places, "user_id").withColumnsRenamed({"uc_id": "_uc", "user_id": "_user"})
    )
    # two comparisons instead of one key, so that targets stay dealt by enrolment
    same = (F.col("uc_id") == F.col("_uc")) & (F.col("user_id") <= F.col("_user")) & (F.col("user_id") >= F.col("_user"))
    near = targets.join(of_enrolment.hint("shuffle_hash"), same).select(*columns)
    near = near.unionByName(targets.where("uc_id IS NULL").join(places, "user_id").select(*columns))
    d = geo.haversine_km(F.col("place_lat"), F.col("place_lon"), F.col("lat"), F.col("lon"))
    return near.withColumn("distance_m", d * 1000).where(F.col("distance_m") <= radius_km * 1000)


def refresh_status(users: DataFrame) -> DataFrame:
    """Whether a user imported unfound items after the last evaluation."""
    stale = F.col("last_import_at").isNotNull() & (
        F.col("last_evaluated_at").isNull() | (F.col("last_import_at") > F.col("last_evaluated_at"))
    )
    return users.select("user_id", F.coalesce(stale, F.lit(False)).alias("needs_refresh"), "last_import_at", "last_evaluated_at")
