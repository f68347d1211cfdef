"""Rules that tasks hold as JSON, evaluated through an index of their conditions.

Each distinct rule is filed under the keys of its most selective condition
(type, size, country, state, attribute, year, difficulty or terrain step; the
counts of the items decide), items meet the index by equi join on their own
keys, and the rest of the rule is decided inside the join. An ``and`` needs the
keys of one child, an ``or`` those of all, a ``not`` the key that every item
has. So (item, rule) pairs are found once, whatever the number of tasks and
users, and the only rows that leave the join are real matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.operators.rule_tables import item_keys, matches, rule_signatures
from cairnwise.operators.rules import AGGREGATES
from cairnwise.session import materialise

#: The key of every item.
ANY = "*"
#: Shares into which the items of a key are dealt; index rows are repeated as often.
SALTS = 8
#: Items are dealt to as many tasks as they ask for, each of about so many; one item meets many rules.
ITEMS_PER_PARTITION = 20_000
_ACCESS = "struct<cost:bigint,keys:array<string>>"


def probe_keys(k: Column) -> Column:
    """The keys an item answers to; ``k`` comes from ``item_keys``."""

    def one(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value.cast("string"))

    single = [
        F.lit(ANY), one("t:", k["type_code"]), one("s:", k["size_code"]), one("c:", k["country"]), one("st:", k["state"]),
        one("y:", F.year(k["placed"])), one("d:", F.floor(k["d"] * 2)), one("e:", F.floor(k["t"] * 2)),
    ]
    attributes = F.transform(F.coalesce(k["attributes"], F.array().cast("array<string>")), lambda a: F.concat(F.lit("a:"), a))
    return F.array_distinct(F.array_compact(F.concat(F.array(*single), attributes)))


def _leaf_keys(step: Column, spans: dict[str, tuple]) -> Column:
    """Keys of which every item that satisfies the leaf has one; none if nothing can.

    ``spans`` holds the least and greatest year, difficulty and terrain step of
    the items, to which open ranges are cut.
    """
    ids, nothing, anything = step["ids"], F.array().cast("array<string>"), F.array(F.lit(ANY))

    def named(prefix: str) -> Column:
        return F.transform(ids, lambda i: F.concat(F.lit(prefix), i))

    def ranged(prefix: str, low: Column | None, high: Column | None) -> Column:
        least, most = spans[prefix]
        if least is None:
            return nothing
        start = F.lit(least) if low is None else F.floor(F.greatest(low, F.lit(float(least)))).cast("int")
        stop = F.lit(most) if high is None else F.floor(F.least(high, F.lit(float(most)))).cast("int")
        # greatest and least skip nulls, but a leaf without its bound never holds
        given = reduce(lambda a, b: a & b, [c.isNotNull() for c in (low, high) if c is not None])
        steps = F.transform(F.sequence(start, F.greatest(start, stop)), lambda x: F.concat(F.lit(prefix), x.cast("string")))
        return F.when(given & (start <= stop), steps).otherwise(nothing)

    year = F.year(F.try_to_date(step["params"])).cast("double")
    by_kind = {
        "type_in": F.when(F.size(ids) == 0, anything).otherwise(named("t:")),
        "size_in": F.when(F.size(ids) == 0, anything).otherwise(named("s:")),
        "country_is": named("c:"),
        "state_in": named("st:"),
        "placed_year": F.array_compact(F.array(F.concat(F.lit("y:"), step["params"]))),
        "placed_before": ranged("y:", None, year),
        "placed_after": ranged("y:", year, None),
        "difficulty_between": ranged("d:", step["low"] * 2, step["high"] * 2),
        "terrain_between": ranged("e:", step["low"] * 2, step["high"] * 2),
        "attributes": F.when(~step["known"], nothing).when(F.size(ids) == 0, anything).otherwise(named("a:")),
    }
    out = None
    for kind, value in by_kind.items():
        out = F.when(step["op"] == kind, value) if out is None else out.when(step["op"] == kind, value)
    return F.coalesce(out, nothing)


def _access(program: Column, leaf: Column, total: Column) -> Column:
    """Cost and keys of the cheapest way to all items of a rule; ``leaf`` maps steps to those of the leaves."""
    everything = F.struct(total.alias("cost"), F.array(F.lit(ANY)).alias("keys"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<string>").alias("keys"))
    steps = F.transform(
        program, lambda s, i: F.struct(s["op"].alias("op"), s["n"].alias("n"), F.coalesce(F.try_element_at(leaf, i), nothing).alias("own"))
    )

    def follow(done: Column, step: Column) -> Column:
        before = F.slice(done, F.lit(1), F.size(done) - step["n"])
        last = F.slice(done, F.size(done) - step["n"] + 1, step["n"])
        either = F.struct(
            F.aggregate(last, F.lit(0).cast("bigint"), lambda a, x: a + x["cost"]).alias("cost"),
            F.array_distinct(F.flatten(F.transform(last, lambda x: x["keys"]))).alias("keys"),
        )
        joined = (
            F.when(step["op"] == "and", F.array_min(last))
            .when(step["op"] == "or", F.when(F.exists(last, lambda x: F.array_contains(x["keys"], ANY)), everything).otherwise(either))
            .when(step["op"] == "not", everything)
            .otherwise(step["own"])
        )
        return F.concat(before, F.array(joined.cast(_ACCESS)))

    done = F.aggregate(steps, F.array().cast(f"array<{_ACCESS}>"), follow)
    return F.coalesce(F.try_element_at(done, F.lit(1)), everything)["keys"]


def index(programs: DataFrame, probes: DataFrame) -> DataFrame:
    """(sig, program, keys): rules (sig, program) with the keys they are filed under.

    ``probes`` holds the items' (item_id, k, keys). A rule that nothing can
    satisfy has no keys, one without a selective condition only ``ANY``.
    """
    counts = probes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("items"))
    counts = materialise(counts, "key-counts")
    total = counts.where(F.col("key") == ANY).agg(F.sum("items")).first()[0] or 0
    step_of = F.col("key").startswith
    bounds = counts.agg(*[
        f(F.when(step_of(p), F.substring_index("key", ":", -1).cast("int"))).alias(f"{n}{p[0]}") for p in ("y:", "d:", "e:") for n, f in (("low", F.min), ("high", F.max))
    ]).first()
    spans = {p: (bounds[f"low{p[0]}"], bounds[f"high{p[0]}"]) for p in ("y:", "d:", "e:")}
    leaf_steps = programs.select("sig", F.posexplode("program").alias("pos", "step")).where("step.n = 0")
    asked = leaf_steps.select("sig", "pos", (F.col("step.op") == "attributes").alias("one"), F.explode(_leaf_keys(F.col("step"), spans)).alias("key"))
    counted = asked.join(counts, "key", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    best = F.min(F.struct("items", "key"))
    leaf = counted.groupBy("sig", "pos").agg(
        F.when(F.first("one"), F.struct(best["items"].alias("cost"), F.array(best["key"]).alias("keys")))
        .otherwise(F.struct(F.sum("items").alias("cost"), F.array_sort(F.collect_set("key")).alias("keys"))).alias("own")
    )
    leaf = leaf.groupBy("sig").agg(F.map_from_entries(F.collect_list(F.struct("pos", "own"))).alias("leaf"))
    found = programs.join(leaf, "sig", "left")
    return found.select("sig", "program", _access(F.col("program"), F.coalesce("leaf", F.create_map().cast(f"map<int,{_ACCESS}>")), F.lit(total)).alias("keys"))


def matching_pairs(items: DataFrame, programs: DataFrame) -> DataFrame:
    """(item_id, sig) of every item and rule (sig, program) that match, each once.

    A popular key's items are dealt over salts; a rule that is filed under
    several keys of an item takes it under the first of them. Tasks of the join
    follow the number of items, which are counted first, not the size of their files.
    """
    items = items.repartition(max(1, -(-items.count() // ITEMS_PER_PARTITION)), "item_id")
    probes = item_keys(items, []).withColumn("keys", probe_keys(F.col("k")))
    filed = index(programs, probes).select("sig", "program", F.col("keys").alias("filed"), F.explode("keys").alias("at"))
    # written once, so that its size is known and few rules travel to the items, never few items to the rules
    filed = materialise(filed, "rule-index")
    filed = filed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asks = probes.withColumn("salt", F.pmod(F.hash("item_id"), F.lit(SALTS))).select("item_id", "k", "keys", "salt", F.explode("keys").alias("key"))
    first = F.try_element_at(F.array_intersect("keys", "filed"), F.lit(1)) == F.col("key")
    met = (F.col("key") == F.col("at")) & (F.col("salt") == F.col("share")) & first & matches(F.col("program"), F.col("k"))
    return asks.join(filed, met).select("item_id", "sig")


class StoredRules:
    """Rules that a table's rows hold as JSON (``expression``), for progress and targets.

    The rules stay rows: nothing is built on the driver, and their number may
    grow with the tasks. Each distinct text is taken apart once, each distinct
    rule meets the items once. ``attach`` comes first: the rules of its tasks
    are the ones that ``hits`` and ``pairs`` know. One object serves one
    evaluation over one items table.
    """

    def __init__(self, lookup: DataFrame, expression: str = "expression"):
        self.lookup, self.expression = lookup, expression
        self.programs: DataFrame | None = None
        self._pairs: DataFrame | None = None

    def attach(self, tasks: DataFrame) -> DataFrame:
        """Tasks with signature number and aggregate; without a signature
        where the expression is missing or has a leaf of no known kind."""
        units = reduce(lambda acc, kv: acc.when(F.col("agg_kind") == kv[0], kv[1]), AGGREGATES.values(), F.when(F.lit(False), ""))
        known = materialise(rule_signatures(tasks, "task_id", self.lookup, self.expression).where("known"), "task-rules")
        named = known.groupBy("signature").agg(F.min("program").alias("program"))
        named = materialise(named.withColumn("sig", F.monotonically_increasing_id()), "signatures")
        self.programs, self._pairs = named.select("sig", "program"), None
        table = known.drop("program").join(named.select("signature", "sig"), "signature")
        return tasks.join(table.select("task_id", "sig", "and_only", "agg_kind", "agg_target", units.alias("agg_unit"), "max_d", "max_t"), "task_id", "left")

    def pairs(self, items: DataFrame) -> DataFrame:
        """(item_id, sig): which items match which rules, written once."""
        if self._pairs is None:
            self._pairs = materialise(matching_pairs(items, self.programs), "item-rules")
        return self._pairs

    def hits(self, finds: DataFrame, items: DataFrame, tasks: DataFrame, columns: list[str]) -> DataFrame:
        """Finds that match a rule of their user.

        Items carry the numbers of their rules, users those of theirs, so a
        find stays one row until its real matches are exploded.
        """
        wanted = tasks.where("sig IS NOT NULL").groupBy("user_id").agg(F.collect_set("sig").alias("user_sigs"))
        sigs = self.pairs(items).groupBy("item_id").agg(F.collect_list("sig").alias("sigs"))
        tagged = items.select("item_id", *columns).join(sigs, "item_id")
        return (
            finds.select("user_id", "item_id", "found_date").join(wanted, "user_id").join(tagged, "item_id")
            .withColumn("sig", F.explode(F.array_intersect("sigs", "user_sigs"))).drop("sigs", "user_sigs")
        )
