"""Rules stored as JSON text in tables: canonical leaves, checks, signatures.

A rule is taken apart level by level with ``from_json``; how many levels to
unroll is read off the nesting of the texts, so no rule is too deep or too wide. Labels are
resolved by one join of all leaves with the dimension lookup table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.operators.rules import AGGREGATES, ITEM_LEAVES, LOGICAL
from cairnwise.session import materialise

_NODE = (
    "kind string, nodes array<string>, node string,"
    " types array<struct<code:string,type_code:string,id:string>>, codes array<string>, type_ids array<string>,"
    " sizes array<struct<code:string,name:string,id:string>>, names array<string>, size_ids array<string>,"
    " country struct<code:string,name:string>, country_id string,"
    " states array<struct<name:string,state_id:string>>, state_ids array<string>,"
    " year int, date string, min double, max double,"
    " attributes array<struct<id:string,code:string,is_positive:boolean>>,"
    " min_total int, max_difficulty double, max_terrain double"
)
_REF = "array<struct<ref:string,fields:array<string>,value:string,scope:string,mark:string>>"
_IDS = "array<string>"


def _nesting(text: Column) -> Column:
    """How many braces are open at once in a JSON text, outside its strings."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), "[^{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, brace: Column) -> Column:
        now = acc["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(braces, ""), start, step, lambda acc: acc["most"])


def leaves(rules: DataFrame, key: str, expression: str = "expression") -> DataFrame:
    """One row per leaf: (key, path, trail, parent, and_path, top, n).

    ``trail`` lists the logical kinds from the root down to the leaf.
    ``parent`` is the nearest and/or above the leaf, or 'not' when any
    negation is above it; ``and_path`` says that only 'and' is; a rule that is
    a bare leaf counts as an 'and' of it, as do nodes without a kind. ``n``
    holds the parsed leaf.

    Levels are unrolled as deep as the texts are nested, however wide they are;
    leaves that end early are carried along, so the plan grows with depth only.
    """
    texts = rules.where(F.col(expression).isNotNull()).select(key, F.col(expression).alias("text"))
    deepest = texts.agg(F.max(_nesting(F.col("text")))).first()[0] or 0
    level = texts.select(
        key, F.lit("0").alias("path"), F.expr("CAST(array() AS array<string>)").alias("trail"), F.from_json("text", _NODE).alias("n")
    )
    for _ in range(deepest - 1):
        kind = F.coalesce("n.kind", F.when(F.col("n.nodes").isNotNull(), "and"))
        inner = F.coalesce(kind.isin(*LOGICAL), F.lit(False))
        below = F.when(kind == "not", F.array(F.col("n.node"))).otherwise(F.coalesce("n.nodes", F.expr("CAST(array() AS array<string>)")))
        children = F.when(inner, below).otherwise(F.expr("CAST(array(NULL) AS array<string>)"))
        level = level.select(
            key, "path", "trail", "n", F.when(inner, kind).alias("logical"), F.posexplode(children).alias("i", "child")
        ).select(
            key,
            F.when(F.col("logical").isNull(), F.col("path")).otherwise(F.concat_ws(".", "path", F.col("i").cast("string"))).alias("path"),
            F.when(F.col("logical").isNull(), F.col("trail")).otherwise(F.concat("trail", F.array("logical"))).alias("trail"),
            F.when(F.col("logical").isNull(), F.col("n")).otherwise(F.from_json("child", _NODE)).alias("n"),
        )
    negated = F.array_contains("trail", "not")
    return level.where(~F.coalesce(F.col("n.kind").isin(*LOGICAL), F.lit(False))).select(
        key, "path", "trail",
        F.when(negated, "not").otherwise(F.coalesce(F.try_element_at("trail", F.lit(-1)), F.lit("and"))).alias("parent"),
        F.forall("trail", lambda k: k == "and").alias("and_path"),
        F.coalesce(F.try_element_at("trail", F.lit(1)), F.lit("and")).alias("top"),
        "n",
    )


def _references() -> Column:
    """Labels a leaf mentions: what kind, which lookup fields, the text, its scope."""
    n = F.col("n")

    def refs(values: Column, kind: str, fields: list[str], label, scope=None, mark=None) -> Column:
        made = F.transform(
            values,
            lambda v: F.struct(
                F.lit(kind).alias("ref"), F.array(*[F.lit(f) for f in fields]).alias("fields"), label(v).alias("value"),
                (F.lit(None) if scope is None else scope).cast("string").alias("scope"),
                (F.lit("") if mark is None else mark(v)).alias("mark"),
            ),
        )
        return F.coalesce(F.filter(made, lambda r: r["value"].isNotNull()), F.expr(f"CAST(array() AS {_REF})"))

    def sign(a: Column) -> Column:
        return F.when(F.coalesce(a["is_positive"], F.lit(True)), "+").otherwise("-")

    empty = F.expr(f"CAST(array() AS {_REF})")
    size_name = ["name", "alias"]
    by_kind = {
        "type_in": F.concat(
            refs(F.filter(n["types"], lambda t: t["id"].isNull()), "type", ["code"], lambda t: F.coalesce(t["type_code"], t["code"])),
            refs(n["codes"], "type", ["code"], lambda c: c),
        ),
        "size_in": F.concat(
            refs(F.filter(n["sizes"], lambda s: s["id"].isNull() & s["code"].isNotNull()), "size", ["code"], lambda s: s["code"]),
            refs(F.filter(n["sizes"], lambda s: s["id"].isNull() & s["code"].isNull()), "size", size_name, lambda s: s["name"]),
            refs(n["codes"], "size", ["code"], lambda c: c),
            refs(n["names"], "size", size_name, lambda c: c),
        ),
        "country_is": F.when(n["country_id"].isNull(), refs(F.array(n["country"]), "country", ["name"], lambda c: F.coalesce(c["name"], c["code"]))).otherwise(empty),
        "state_in": refs(F.filter(n["states"], lambda s: s["state_id"].isNull()), "state", ["name"], lambda s: s["name"], scope=n["country_id"]),
        "attributes": F.concat(
            refs(F.filter(n["attributes"], lambda a: a["id"].isNull()), "attribute", ["code", "name"], lambda a: a["code"], mark=sign),
            refs(n["codes"], "attribute", ["code", "name"], lambda c: c, mark=lambda c: F.lit("+")),
        ),
    }
    out = None
    for kind, value in by_kind.items():
        out = F.when(n["kind"] == kind, value) if out is None else out.when(n["kind"] == kind, value)
    return out.otherwise(empty)


def _given_ids() -> Column:
    """Ids a leaf states itself (kind, id, sign)."""
    n = F.col("n")
    empty = F.expr("CAST(array() AS array<struct<ref:string,id:string,mark:string>>)")

    def ids(values: Column, kind: str, ident, mark=None) -> Column:
        made = F.transform(values, lambda v: F.struct(F.lit(kind).alias("ref"), ident(v).alias("id"), (F.lit("") if mark is None else mark(v)).alias("mark")))
        return F.coalesce(F.filter(made, lambda r: r["id"].isNotNull()), empty)

    def sign(a: Column) -> Column:
        return F.when(F.coalesce(a["is_positive"], F.lit(True)), "+").otherwise("-")

    return (
        F.when(n["kind"] == "type_in", F.concat(ids(n["types"], "type", lambda t: t["id"]), ids(n["type_ids"], "type", lambda i: i)))
        .when(n["kind"] == "size_in", F.concat(ids(n["sizes"], "size", lambda s: s["id"]), ids(n["size_ids"], "size", lambda i: i)))
        .when(n["kind"] == "country_is", ids(F.array(n["country_id"]), "country", lambda c: c))
        .when(n["kind"] == "state_in", F.concat(ids(n["states"], "state", lambda s: s["state_id"]), ids(n["state_ids"], "state", lambda i: i)))
        .when(n["kind"] == "attributes", ids(n["attributes"], "attribute", lambda a: a["id"], mark=sign))
        .otherwise(empty)
    )


def canonical_leaves(rules: DataFrame, key: str, lookup: DataFrame, expression: str = "expression") -> DataFrame:
    """Leaves with every label replaced by its id.

    Adds ``ids`` (sorted, with +/- for attributes), ``unknown`` (labels or ids
    nothing answers to) and ``params`` (year, date, range or target). ``lookup``
    is ``referentials.alias_table``. Each distinct text is worked on once,
    however many rules share it.
    """
    shared = rules.where(F.col(expression).isNotNull()).select(key, F.col(expression).alias("rule_text"))
    texts = shared.select("rule_text").distinct().withColumn("expression", F.col("rule_text"))
    return shared.join(_canonical_texts(texts, "rule_text", lookup), "rule_text").drop("rule_text")


def _canonical_texts(rules: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    base = materialise(
        leaves(rules, key).withColumns({"refs": _references(), "given": _given_ids()}), "rule-leaves"
    )
    asked = base.select(key, "path", F.inline("refs")).withColumn("lk", F.lower("value"))
    table = lookup.select(
        F.col("kind").alias("ref"), F.col("field").alias("lf"), F.col("key").alias("lk"), F.col("scope").alias("ls"),
        F.when((F.col("kind") == "state") & (F.col("candidates") > 1), F.lit(None)).otherwise(F.col("id")).alias("id"),
    )
    hits = asked.join(table, ["ref", "lk"]).where(
        F.array_contains("fields", F.col("lf")) & F.col("scope").eqNullSafe(F.col("ls"))
    )
    best = hits.groupBy(key, "path", "ref", "lk", "mark").agg(
        F.min(F.struct(F.array_position("fields", F.col("lf")).alias("rank"), "id"))["id"].alias("id")
    )
    resolved = (
        asked.join(best, [key, "path", "ref", "lk", "mark"], "left")
        .groupBy(key, "path").agg(
            F.collect_set(F.when(F.col("id").isNotNull(), F.concat("id", "mark"))).alias("found"),
            F.collect_set(F.when(F.col("id").isNull(), F.col("value"))).alias("missing"),
        )
    )
    known = lookup.groupBy("kind", "id").agg(F.lit(True).alias("known")).select(F.col("kind").alias("ref"), "id", "known")
    stated = (
        base.select(key, "path", F.inline("given")).join(known, ["ref", "id"], "left")
        .groupBy(key, "path").agg(
            F.collect_set(F.when(F.col("known"), F.concat("id", "mark"))).alias("stated"),
            F.collect_set(F.when(F.col("known").isNull(), F.col("id"))).alias("strange"),
        )
    )
    none = F.expr(f"CAST(array() AS {_IDS})")

    def union(*names: str) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in names]))), ",")

    n = F.col("n")
    params = F.concat_ws("|", n["year"].cast("string"), n["date"], n["min"].cast("string"), n["max"].cast("string"), n["min_total"].cast("string"), n["max_difficulty"].cast("string"), n["max_terrain"].cast("string"))
    return (
        base.join(resolved, [key, "path"], "left").join(stated, [key, "path"], "left")
        .select(key, "path", "trail", "parent", "and_path", "top", n["kind"].alias("kind"), union("found", "stated").alias("ids"), union("missing", "strange").alias("unknown"), params.alias("params"), "n")
    )


def _node_text(node: Column) -> Column:
    return F.when(node["op"] == "leaf", node["parts"][0]).otherwise(
        F.concat(node["op"], F.lit("["), F.array_join(node["parts"], ";"), F.lit("]"))
    )


def _token(op, n: Column) -> Column:
    """A step of a program that joins the last ``n`` results."""
    return F.struct(op.alias("op"), n.alias("n"), F.lit(None).cast("string").alias("params"), F.lit(None).cast(_IDS).alias("ids"), F.lit(True).alias("known"),
                    F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))


def _trees(rows: DataFrame, key: str) -> DataFrame:
    """(key, signature, program) from leaves (key, path, trail, leaf, token), built up from the deepest level.

    A node's text holds its children's in order, each once; a nested node of the
    same kind is merged into it, and an and/or of one child is that child. A
    node's program is its children's one after another, then how to join them.
    """
    rows = materialise(rows, "signature-leaves")
    deepest = rows.agg(F.max(F.size("trail"))).first()[0] or 0
    level = rows.select(
        key, F.split("path", r"\.").alias("place"), "trail",
        F.struct(F.lit("leaf").alias("op"), F.array("leaf").alias("parts"), F.array("token").alias("program")).alias("node"),
    )
    for depth in range(deepest, 0, -1):
        here = F.size("trail") == depth
        grouped = level.groupBy(
            key,
            F.when(here, F.slice("place", 1, depth)).otherwise(F.col("place")).alias("place"),
            F.when(here, F.slice("trail", 1, depth - 1)).otherwise(F.col("trail")).alias("trail"),
            F.when(here, F.col("trail")[depth - 1]).alias("op"),
        ).agg(F.collect_list("node").alias("below"))
        op = F.col("op")
        parts = F.transform("below", lambda c: F.when(c["op"] == op, c["parts"]).otherwise(F.array(_node_text(c))))
        only = F.col("below")[0]
        joined = F.concat(F.flatten(F.transform("below", lambda c: c["program"])), F.array(_token(op, F.size("below"))))
        level = grouped.withColumn("parts", F.array_sort(F.array_distinct(F.flatten(parts)))).select(
            key, "place", "trail",
            F.when(op == "not", F.struct(op.alias("op"), F.array(_node_text(only)).alias("parts"), joined.alias("program")))
            .when(op.isNull() | (F.size("parts") == 1), only)
            .otherwise(F.struct(op.alias("op"), F.col("parts").alias("parts"), joined.alias("program"))).alias("node"),
        )
    return level.select(key, _node_text(F.col("node")).alias("signature"), "node.program")


def signatures(canonical: DataFrame, key: str) -> DataFrame:
    """Per rule: signature of its item leaves, whether it is 'and' only, and its
    first usable aggregate with its target.

    Equal signatures mean equal item conditions: the text follows the tree, so
    'and', 'or' and 'not' stay apart. A rule of aggregates alone has an empty one.
    ``program`` holds the steps that ``matches`` follows; ``known`` is false where
    a leaf is of no known kind.
    """
    is_agg = F.coalesce(F.col("kind").isin(*AGGREGATES), F.lit(False))
    # An unknown attribute never holds, so such a leaf differs from the same one without it.
    strange = F.when((F.col("kind") == "attributes") & (F.col("unknown") != ""), "?").otherwise("")
    text = F.concat_ws("", "kind", F.lit("("), "ids", F.lit("|"), "params", strange, F.lit(")"))
    kind = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], kv[1][0]), AGGREGATES.items(), F.when(F.lit(False), ""))
    steps_d = F.bround((F.coalesce("n.max_difficulty", F.lit(5.0)) - 1.0) / 0.5) + 1
    steps_t = F.bround((F.coalesce("n.max_terrain", F.lit(5.0)) - 1.0) / 0.5) + 1
    target = F.when(F.col("kind") == "aggregate_dt_matrix_complete", (steps_d * steps_t).cast("int")).otherwise(F.col("n.min_total"))
    first = F.min(
        F.when(
            is_agg & target.isNotNull(),
            F.struct("path", kind.alias("agg"), target.alias("target"), *[F.coalesce(f"n.{c}", F.lit(5.0)).alias(c) for c in ("max_difficulty", "max_terrain")]),
        )
    )
    known = F.coalesce(F.col("kind").isin(*AGGREGATES, *ITEM_LEAVES), F.lit(False))
    facts = canonical.groupBy(key).agg(F.min("and_path").alias("and_only"), F.min(known).alias("known"), first.alias("a"))
    token = F.struct(
        F.col("kind").alias("op"), F.lit(0).alias("n"), F.coalesce(F.col("n.year").cast("string"), "n.date").alias("params"),
        F.when(F.col("ids") == "", F.array().cast(_IDS)).otherwise(F.split("ids", ",")).alias("ids"), (F.col("unknown") == "").alias("known"),
        F.col("n.min").alias("low"), F.col("n.max").alias("high"),
    )
    trees = _trees(canonical.where(~is_agg).select(key, "path", "trail", text.alias("leaf"), token.alias("token")), key)
    matrix = F.col("a.agg") == "dt_matrix"
    return facts.join(trees, key, "left").select(
        key, F.coalesce("signature", F.lit("")).alias("signature"), "and_only", "known", "program",
        F.col("a.agg").alias("agg_kind"), F.col("a.target").alias("agg_target"),
        F.when(matrix, F.col("a.max_difficulty")).alias("max_d"), F.when(matrix, F.col("a.max_terrain")).alias("max_t"),
    )


def item_keys(items: DataFrame, columns: list[str]) -> DataFrame:
    """Items with what ``matches`` compares (``k``), made once per item."""
    k = F.struct(
        "type_code", "size_code", F.col("country_id").cast("string").alias("country"), F.col("state_id").cast("string").alias("state"),
        F.col("placed_at").cast("date").alias("placed"), F.col("difficulty").alias("d"), F.col("terrain").alias("t"),
        F.transform("attributes", lambda a: F.concat(a["attr_id"].cast("string"), F.when(a["is_positive"], "+").otherwise("-"))).alias("attributes"),
    )
    return items.select("item_id", *columns, k.alias("k"))


def _holds(step: Column, k: Column) -> Column:
    """Whether one leaf holds; what is missing never does."""
    ids = step["ids"]

    def among(value: Column) -> Column:
        return F.array_contains(ids, value)

    by_kind = {
        "type_in": (F.size(ids) == 0) | among(k["type_code"]),
        "size_in": (F.size(ids) == 0) | among(k["size_code"]),
        "country_is": among(k["country"]),
        "state_in": among(k["state"]),
        "placed_year": F.year(k["placed"]).cast("string") == step["params"],
        "placed_before": k["placed"] < F.try_to_date(step["params"]),
        "placed_after": k["placed"] > F.try_to_date(step["params"]),
        "difficulty_between": k["d"].between(step["low"], step["high"]),
        "terrain_between": k["t"].between(step["low"], step["high"]),
        "attributes": step["known"] & F.forall(ids, lambda i: F.array_contains(k["attributes"], i)),
    }
    out = None
    for kind, value in by_kind.items():
        out = F.when(step["op"] == kind, value) if out is None else out.when(step["op"] == kind, value)
    return F.coalesce(out, F.lit(False))


def matches(program: Column, k: Column) -> Column:
    """The rule over an item: the steps in order, each and/or/not joining the
    results before it. A missing program (a rule of aggregates alone) holds."""

    def follow(done: Column, step: Column) -> Column:
        before = F.slice(done, F.lit(1), F.size(done) - step["n"])
        last = F.slice(done, F.size(done) - step["n"] + 1, step["n"])
        joined = (
            F.when(step["op"] == "and", F.forall(last, lambda v: v))
            .when(step["op"] == "or", F.exists(last, lambda v: v))
            .when(step["op"] == "not", ~F.exists(last, lambda v: v))
            .otherwise(_holds(step, k))
        )
        return F.concat(before, F.array(joined))

    done = F.aggregate(program, F.array().cast("array<boolean>"), follow)
    return F.coalesce(F.try_element_at(done, F.lit(1)), F.lit(True))


def rule_signatures(rules: DataFrame, key: str, lookup: DataFrame, expression: str = "expression") -> DataFrame:
    """``signatures`` of stored rules; each distinct text is worked on once."""
    shared = rules.where(F.col(expression).isNotNull()).select(key, F.col(expression).alias("rule_text"))
    texts = shared.select("rule_text").distinct().withColumn("expression", F.col("rule_text"))
    return shared.join(signatures(_canonical_texts(texts, "rule_text", lookup), "rule_text"), "rule_text").drop("rule_text")


def validate(
    payload: DataFrame, lookup: DataFrame, requests: DataFrame | None = None
) -> DataFrame:
    """(uc_id, task_key, error, detail) for every rule that may not be stored.

    ``payload`` holds ``task_key, uc_id, ord, expression, min_count`` (text).
    ``requests`` lists the enrolments that were to receive tasks; one without
    any is an error too.
    """
    columns = ["task_key", "parent", "and_path", "top", "kind", "ids", "unknown", F.col("n.min").alias("low"), F.col("n.max").alias("high")]
    canonical = materialise(canonical_leaves(payload, "task_key", lookup).select(*columns), "canonical-rules")
    owner = payload.select("task_key", "uc_id")

    def rows(df: DataFrame, error: Column, detail: Column) -> DataFrame:
        return df.select("task_key", error.alias("error"), detail.cast("string").alias("detail"))

    is_agg = F.col("kind").isin(*AGGREGATES)
    unknown = canonical.where("unknown <> ''")
    anchored = canonical.where(F.col("kind") == "country_is").where("and_path").select("task_key").distinct()
    states = canonical.where((F.col("kind") == "state_in") & (F.col("top") == "and")).join(anchored, "task_key", "left_anti")
    min_count = F.trim("min_count")
    parts = [
        rows(canonical.where(is_agg & F.col("parent").isin("or", "not")), F.lit("aggregate_not_under_and"), F.col("parent")),
        rows(canonical.where(is_agg).groupBy("task_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), F.lit("several_aggregates"), F.col("k")),
        rows(unknown, F.concat(F.lit("unknown_in_"), F.col("kind")), F.col("unknown")),
        rows(states, F.lit("state_without_country"), F.col("ids")),
        rows(canonical.where(F.col("kind").isin("difficulty_between", "terrain_between") & (F.col("low") > F.col("high"))), F.lit("min_above_max"), F.col("kind")),
        rows(canonical.where((F.col("kind") == "type_in") & (F.col("ids") == "")), F.lit("type_in_matches_everything"), F.lit(None)),
        rows(payload.where("expression IS NULL"), F.lit("missing_expression"), F.lit(None)),
        rows(payload.where(F.col("min_count").isNotNull() & ~min_count.rlike(r"^\+?\d+$")), F.lit("bad_min_count"), F.col("min_count")),
    ]
    repeated = payload.groupBy("uc_id", "ord").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("uc_id", "ord")
    parts.append(rows(payload.join(repeated, ["uc_id", "ord"]), F.lit("duplicate_order"), F.col("ord")))
    found = reduce(DataFrame.unionByName, parts).join(owner, "task_key").select("uc_id", "task_key", "error", "detail")
    if requests is not None:
        empty = requests.join(payload.select("uc_id").distinct(), "uc_id", "left_anti")
        found = found.unionByName(
            empty.select("uc_id", F.lit(None).cast("long").alias("task_key"), F.lit("empty_list").alias("error"), F.lit(None).cast("string").alias("detail"))
        )
    return found
