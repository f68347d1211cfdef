"""The rule language over items.

A rule is a nested dict: a leaf such as ``{"kind": "type_in", "codes": [...]}``
or ``and`` / ``or`` / ``not`` over rules. Item leaves compile to one Column
each, so a rule is ordinary filter code for the optimiser. One aggregate leaf
may stand under ``and``; it describes what to add up over the matching finds.

Rules that share their item leaves share a *signature* and are evaluated once
per item, not once per task, user or find.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Aggregate leaves and the unit their totals are reported in.
AGGREGATES = {
    "aggregate_sum_difficulty_at_least": ("difficulty", "points"),
    "aggregate_sum_terrain_at_least": ("terrain", "points"),
    "aggregate_sum_diff_plus_terr_at_least": ("diff_plus_terr", "points"),
    "aggregate_sum_altitude_at_least": ("altitude", "meters"),
    "aggregate_count_distinct_countries_at_least": ("distinct_countries", "countries"),
    "aggregate_dt_matrix_complete": ("dt_matrix", "cells"),
}
LOGICAL = ("and", "or", "not")
ITEM_LEAVES = (
    "type_in", "size_in", "country_is", "state_in", "placed_year", "placed_before", "placed_after", "difficulty_between",
    "terrain_between", "attributes",
)


def wrap(rule: dict) -> dict:
    """A bare leaf, or nodes without a kind, become an ``and``."""
    kind = rule.get("kind")
    if kind in LOGICAL:
        return rule
    if kind is None and isinstance(rule.get("nodes"), list):
        return {"kind": "and", "nodes": rule["nodes"]}
    return {"kind": "and", "nodes": [rule]}


def _children(rule: dict) -> list[dict]:
    return [rule["node"]] if rule.get("kind") == "not" else list(rule.get("nodes") or [])


def _leaf(leaf: dict) -> Column:
    kind = leaf["kind"]
    if kind == "type_in":
        given = [t.get("id") or t.get("type_code") or t.get("code") for t in leaf.get("types") or []]
        codes = [c.lower() for c in [*given, *(leaf.get("codes") or []), *(leaf.get("type_ids") or [])] if c]
        return F.col("type_code").isin(codes) if codes else F.lit(True)
    if kind == "size_in":
        given = [s.get("id") or s.get("code") for s in leaf.get("sizes") or []]
        codes = [c for c in [*given, *(leaf.get("codes") or []), *(leaf.get("size_ids") or [])] if c]
        if not codes and (leaf.get("names") or leaf.get("sizes")):
            raise ValueError("sizes given by name: use resolve_labels first")
        # both cases are listed, so that the filter still reaches the scan
        return F.col("size_code").isin(sorted({v for c in codes for v in (c, c.upper(), c.lower())})) if codes else F.lit(True)
    if kind == "country_is":
        country = leaf.get("country_id")
        return F.lit(False) if country is None else F.col("country_id") == int(country)
    if kind == "state_in":
        given = [s.get("state_id") for s in leaf.get("states") or []]
        states = [int(s) for s in [*given, *(leaf.get("state_ids") or [])] if s is not None]
        return F.col("state_id").isin(states) if states else F.lit(False)
    if kind == "placed_year":
        year = int(leaf["year"])
        start, end = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
        return (F.col("placed_at") >= F.lit(start)) & (F.col("placed_at") < F.lit(end))
    if kind == "placed_before":
        return F.col("placed_at") < F.lit(leaf["date"]).cast("date")
    if kind == "placed_after":
        return F.col("placed_at") > F.lit(leaf["date"]).cast("date")
    if kind == "difficulty_between":
        return F.col("difficulty").between(float(leaf["min"]), float(leaf["max"]))
    if kind == "terrain_between":
        return F.col("terrain").between(float(leaf["min"]), float(leaf["max"]))
    if kind == "attributes":
        wanted = [*(leaf.get("attributes") or []), *({"code": c} for c in leaf.get("codes") or [])]
        return reduce(lambda a, b: a & b, [_attribute(w) for w in wanted], F.lit(True))
    raise ValueError(f"unknown rule kind {kind!r}")


def _attribute(wanted: dict) -> Column:
    if wanted.get("id") is None:
        return F.lit(False)
    ident, sign = F.lit(int(wanted["id"])), F.lit(bool(wanted.get("is_positive", True)))
    return F.exists("attributes", lambda a: (a["attr_id"] == ident) & (a["is_positive"] == sign))


# Lookup fields in which a label of each dimension is searched, in this order.
_FIELDS = {"type": ["code"], "size": ["code", "name", "alias"], "country": ["name"], "state": ["name"], "attribute": ["code", "name"]}


def _labels(leaf: dict) -> tuple[str | None, list[tuple[str, dict]], list]:
    """Dimension of a leaf, its labels (with the entry they stand in), and the ids it states."""
    entries = lambda name: [e for e in leaf.get(name) or []]
    plain = lambda *names: [(v, {}) for n in names for v in entries(n)]
    kind = leaf.get("kind")
    if kind == "type_in":
        dim, found, ids = "type", [(t.get("type_code") or t.get("code"), t) for t in entries("types")] + plain("codes"), entries("type_ids")
    elif kind == "size_in":
        dim, found, ids = "size", [(s.get("code") or s.get("name"), s) for s in entries("sizes")] + plain("codes", "names"), entries("size_ids")
    elif kind == "country_is":
        named = leaf.get("country") or {}
        dim, found, ids = "country", [(named.get("name") or named.get("code"), named)], [leaf.get("country_id")]
    elif kind == "state_in":
        dim, found, ids = "state", [(s.get("name"), {"id": s.get("state_id")}) for s in entries("states")], entries("state_ids")
    elif kind == "attributes":
        dim, found, ids = "attribute", [(a.get("code"), a) for a in entries("attributes")] + plain("codes"), []
    else:
        return None, [], []
    ids = [i for i in [*ids, *(e.get("id") for _, e in found if dim != "attribute")] if i is not None]
    return dim, [(text, e) for text, e in found if e.get("id") is not None or text], ids


def resolve_labels(rules: dict[int, dict], lookup: DataFrame) -> dict[int, dict]:
    """The rules with every label replaced by its id from ``referentials.alias_table``.

    Labels are compared without case. Types or sizes of which none is known do
    not filter; an unknown country, state or attribute matches nothing. Only
    lookup rows of labels in these rules are fetched.
    """
    asked = {text.lower() for rule in rules.values() for leaf in _leaves(rule) for text, _ in _labels(leaf)[1] if text}
    rows = lookup.where(F.col("key").isin(sorted(asked))).collect() if asked else []
    known = {(r["kind"], r["field"], r["key"], r["scope"]): r["id"] for r in rows if r["kind"] != "state" or r["candidates"] == 1}

    def find(dim: str, text: str, scope) -> str | None:
        keys = [(dim, field, text.lower(), None if scope is None else str(scope)) for field in _FIELDS[dim]]
        return next((known[k] for k in keys if k in known), None)

    def resolved(node: dict) -> dict:
        if node.get("kind") == "not":
            return {**node, "node": resolved(node["node"])}
        if isinstance(node.get("nodes"), list):
            return {**node, "nodes": [resolved(n) for n in node["nodes"]]}
        dim, found, ids = _labels(node)
        if dim is None:
            return node
        scope = node.get("country_id") if dim == "state" else None
        if dim == "attribute":
            wanted = [{"id": e["id"] if e.get("id") is not None else find(dim, text, None), "is_positive": e.get("is_positive", True)} for text, e in found]
            return {"kind": node["kind"], "attributes": wanted}
        if dim != "country" or not ids:
            ids = ids + [i for i in (find(dim, text, scope) for text, e in found if e.get("id") is None) if i is not None]
        if dim == "country":
            return {"kind": node["kind"], "country_id": ids[0] if ids else None}
        return {"kind": node["kind"], f"{dim}_ids": ids}

    return {k: resolved(rule) for k, rule in rules.items()}


def predicate(rule: dict) -> Column:
    """The rule as a Column over items; aggregate leaves do not filter.

    A missing value never satisfies a leaf, and negating that leaf does.
    """
    kind = rule.get("kind")
    if kind in AGGREGATES:
        return F.lit(True)
    if kind in LOGICAL:
        parts = [predicate(c) for c in _children(rule) if c.get("kind") not in AGGREGATES]
        if not parts:
            return F.lit(True)
        if kind == "not":
            return ~parts[0]
        return reduce(lambda a, b: (a & b) if kind == "and" else (a | b), parts)
    return F.coalesce(_leaf(rule), F.lit(False))


def is_and_only(rule: dict) -> bool:
    kind = rule.get("kind")
    if kind in ("or", "not"):
        return False
    return all(is_and_only(c) for c in _children(rule)) if kind == "and" else True


def _leaves(rule: dict):
    if rule.get("kind") in LOGICAL or isinstance(rule.get("nodes"), list):
        for child in _children(rule):
            yield from _leaves(child)
    else:
        yield rule


def aggregate_of(rule: dict) -> dict | None:
    """The first usable aggregate leaf as kind, target, unit and bounds."""
    for leaf in _leaves(rule):
        if leaf.get("kind") not in AGGREGATES:
            continue
        kind, unit = AGGREGATES[leaf["kind"]]
        if kind == "dt_matrix":
            max_d, max_t = float(leaf.get("max_difficulty", 5.0)), float(leaf.get("max_terrain", 5.0))
            target = (round((max_d - 1.0) / 0.5) + 1) * (round((max_t - 1.0) / 0.5) + 1)
            return {"kind": kind, "target": target, "unit": unit, "max_d": max_d, "max_t": max_t}
        if leaf.get("min_total") is not None:
            return {"kind": kind, "target": int(leaf["min_total"]), "unit": unit, "max_d": None, "max_t": None}
    return None


def _without_aggregates(rule: dict) -> dict | None:
    kind = rule.get("kind")
    if kind in AGGREGATES:
        return None
    if kind in LOGICAL:
        kept = [k for k in (_without_aggregates(c) for c in _children(rule)) if k is not None]
        return {"kind": "not", "node": kept[0] if kept else {"kind": "and", "nodes": []}} if kind == "not" else {"kind": kind, "nodes": kept}
    return rule


def signature(rule: dict) -> str:
    """Canonical text of the item part of a rule; equal rules, equal text."""

    def canonical(node: dict) -> dict:
        if node.get("kind") == "not":
            return {"kind": "not", "node": canonical(node["node"])}
        if node.get("kind") in LOGICAL:
            nodes: list[dict] = []
            for child in (canonical(c) for c in node["nodes"]):
                same = child.get("kind") == node["kind"]
                nodes += child["nodes"] if same else [child]
            return {"kind": node["kind"], "nodes": sorted(nodes, key=lambda n: json.dumps(n, sort_keys=True, default=str))}
        return node

    return json.dumps(canonical(_without_aggregates(wrap(rule)) or {}), sort_keys=True, default=str)


@dataclass
class Rule:
    rule_id: int
    expression: dict
    sig: int
    aggregate: dict | None
    and_only: bool
    top: str


class RuleSet:
    """The rules in use, keyed by ``rule_id``, with shared signatures."""

    def __init__(self, rules: dict[int, dict]):
        self.signatures: list[dict] = []
        self.rules: list[Rule] = []
        known: dict[str, int] = {}
        for rule_id, raw in rules.items():
            rule = wrap(raw)
            text = signature(rule)
            if text not in known:
                known[text] = len(self.signatures)
                self.signatures.append(rule)
            self.rules.append(
                Rule(rule_id, rule, known[text], aggregate_of(rule), is_and_only(rule), rule["kind"])
            )

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per rule (a driver-built list, so safe to broadcast)."""
        rows = [
            (
                r.rule_id, r.sig, r.and_only, r.top,
                *((r.aggregate[k] for k in ("kind", "target", "unit", "max_d", "max_t")) if r.aggregate else [None] * 5),
            )
            for r in self.rules
        ]
        return F.broadcast(
            spark.createDataFrame(
                rows,
                "rule_id int, sig int, and_only boolean, top string, agg_kind string, agg_target int,"
                " agg_unit string, max_d double, max_t double",
            )
        )

    def attach(self, tasks: DataFrame) -> DataFrame:
        """Tasks with their rule's signature and aggregate, by ``rule_id``."""
        return tasks.join(self.table(tasks.sparkSession), "rule_id", "left")

    def hits(self, finds: DataFrame, items: DataFrame, tasks: DataFrame, columns: list[str]) -> DataFrame:
        """Finds that match a rule of their user.

        A user's signatures travel as one small array, so the join multiplies
        nothing and only real matches are exploded.
        """
        wanted = tasks.groupBy("user_id").agg(F.collect_set("sig").alias("user_sigs"))
        tagged = tag_items(items, self, columns).where(F.size("sigs") > 0)
        return (
            finds.select("user_id", "item_id", "found_date")
            .join(wanted, "user_id")
            .join(tagged, "item_id")
            .withColumn("sig", F.explode(F.array_intersect("sigs", "user_sigs")))
            .drop("sigs", "user_sigs")
        )

    def matching_signatures(self) -> Column:
        """Array of the signatures an item satisfies."""
        return F.array_compact(
            F.array(*[F.when(predicate(rule), F.lit(i)) for i, rule in enumerate(self.signatures)])
        )


def tag_items(items: DataFrame, rules: RuleSet, columns: list[str]) -> DataFrame:
    """Items with ``sigs``: evaluated once per item in the scan stage."""
    return items.select("item_id", *columns, rules.matching_signatures().alias("sigs"))


def matching_items(items: DataFrame, rule: dict) -> DataFrame:
    return items.where(predicate(wrap(rule)))
