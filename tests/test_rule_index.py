"""The predicate index against plain evaluation of every rule over every item."""

import json
import random

from pyspark.sql import functions as F

from cairnwise.operators import rule_index as ri
from cairnwise.operators import rule_tables as rt

TYPES, SIZES = ["a", "b", "c", None], ["S", "M", None]


def lookup(spark):
    rows = [("type", "code", c, None, c, 1) for c in "abc"] + [("size", "code", c.lower(), None, c, 1) for c in "SM"]
    rows += [("attribute", "code", f"x{i}", None, str(i), 1) for i in range(4)]
    rows += [("country", "name", f"n{i}", None, str(i), 1) for i in range(3)] + [("state", "name", f"s{i}", None, str(i), 1) for i in range(3)]
    return spark.createDataFrame(rows, "kind string, field string, key string, scope string, id string, candidates long")


def items(spark, n=160):
    r = random.Random(7)
    rows = []
    for i in range(n):
        attributes = [(a, r.random() < 0.7) for a in range(4) if r.random() < 0.4]
        placed = r.choice([None, f"{r.randint(1999, 2004)}-0{r.randint(1, 9)}-11"])
        rows.append((i, r.choice(TYPES), r.choice(SIZES), r.choice([0, 1, None]), r.choice([0, 1, 2, None]), placed,
                     r.choice([1.0, 1.5, 3.25, 5.0, None]), r.choice([1.0, 2.0, 4.5, None]), attributes))
    frame = spark.createDataFrame(
        rows, "item_id long, type_code string, size_code string, country_id int, state_id int, placed string, difficulty double, terrain double, attributes array<struct<attr_id:int,is_positive:boolean>>"
    )
    return frame.withColumn("placed_at", F.to_date("placed")).drop("placed")


def random_rule(r, depth=0):
    if depth < 3 and r.random() < 0.55:
        kind = r.choice(["and", "and", "or", "not"])
        if kind == "not":
            return {"kind": "not", "node": random_rule(r, depth + 1)}
        return {"kind": kind, "nodes": [random_rule(r, depth + 1) for _ in range(r.randint(1, 3))]}
    return r.choice([
        {"kind": "type_in", "codes": r.sample(["a", "b", "c", "zz"], r.randint(0, 2))},
        {"kind": "size_in", "codes": r.sample(["S", "M"], r.randint(0, 2))},
        {"kind": "country_is", "country_id": r.randint(0, 3)},
        {"kind": "country_is", "country": {"name": "Nowhere"}},
        {"kind": "state_in", "state_ids": r.sample(range(5), r.randint(0, 2))},
        {"kind": "placed_year", "year": r.randint(1998, 2005)},
        {"kind": "placed_before", "date": f"{r.randint(1998, 2006)}-05-05"},
        {"kind": "placed_after", "date": f"{r.randint(1998, 2006)}-05-05"},
        {"kind": "placed_after", "date": "no date"},
        {"kind": "difficulty_between", "min": r.choice([-1e9, 1, 1.2, 3]), "max": r.choice([0.5, 1.5, 3.3, 1e9])},
        {"kind": "terrain_between", "min": 2},
        {"kind": "terrain_between", "min": 1.7, "max": 4.6},
        {"kind": "attributes", "attributes": [{"id": a, "is_positive": r.random() < 0.6} for a in r.sample(range(4), r.randint(0, 2))]},
        {"kind": "attributes", "attributes": [{"id": 1}, {"code": "nope"}]},
        {"kind": "aggregate_sum_terrain_at_least", "min_total": 5},
    ])


def attached(spark, rules):
    tasks = spark.createDataFrame([(i, i % 5, json.dumps(rule)) for i, rule in enumerate(rules)], "task_id long, user_id long, expression string")
    stored = ri.StoredRules(lookup(spark))
    return stored, stored.attach(tasks).where("sig IS NOT NULL").select("task_id", "user_id", "sig")


def test_index_equals_plain_evaluation(spark):
    r = random.Random(11)
    table = items(spark)
    stored, tasks = attached(spark, [random_rule(r) for _ in range(150)])
    got = {tuple(x) for x in tasks.join(stored.pairs(table), "sig").select("task_id", "item_id").collect()}
    assert stored.pairs(table).count() == stored.pairs(table).distinct().count()
    keyed = rt.item_keys(table, [])
    plain = tasks.join(stored.programs, "sig").crossJoin(keyed).where(rt.matches(F.col("program"), F.col("k")))
    assert got == {tuple(x) for x in plain.select("task_id", "item_id").collect()}
    assert got


def test_selective_condition_is_chosen(spark):
    """An 'and' is filed under its rarest condition, an 'or' under both, a 'not' under the key of all."""
    table = items(spark)
    rare = {"kind": "placed_year", "year": 2003}
    both = {"kind": "or", "nodes": [rare, {"kind": "attributes", "attributes": [{"id": 1}, {"id": 2}]}]}
    stored, _ = attached(spark, [{"kind": "and", "nodes": [{"kind": "size_in", "codes": ["S"]}, rare]}, both, {"kind": "not", "node": rare},
                                 {"kind": "country_is", "country_id": 99}])
    probes = rt.item_keys(table, []).withColumn("keys", ri.probe_keys(F.col("k")))
    keys = sorted(tuple(sorted(x["keys"])) for x in ri.index(stored.programs, probes).collect())
    assert ("*",) in keys and ("y:2003",) in keys and () in keys  # no item can be in an unknown country
    assert any(len(k) == 2 and "y:2003" in k and k[0] in ("a:1+", "a:2+") for k in keys)


def test_unknown_attribute_is_another_rule(spark):
    """Two rules of one user that differ by an unknown attribute do not share their matches."""
    table = items(spark)
    known = {"kind": "attributes", "attributes": [{"id": 3}]}
    strange = {"kind": "attributes", "attributes": [{"id": 3}, {"code": "nope"}]}
    stored, tasks = attached(spark, [known, strange])
    sigs = [x["sig"] for x in tasks.orderBy("task_id").collect()]
    assert sigs[0] != sigs[1]
    found = {x["sig"]: x["n"] for x in stored.pairs(table).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = table.where(F.exists("attributes", lambda a: (a["attr_id"] == 3) & a["is_positive"])).count()
    assert found == {sigs[0]: want}


def test_join_makes_real_matches_only(spark):
    """Rows that leave the index join are the matches; finds meet no rule they do not match."""
    table = items(spark)
    stored, tasks = attached(spark, [{"kind": "and", "nodes": [{"kind": "type_in", "codes": ["a"]}, {"kind": "placed_year", "year": y}]} for y in range(1990, 2010)])
    pairs = ri.matching_pairs(table, stored.programs)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") - plan.count("Join LeftOuter") == 1 and "Cartesian" not in plan
    finds = table.selectExpr("item_id % 5 AS user_id", "item_id", "DATE '2005-01-01' AS found_date")
    hits = stored.hits(finds, table, tasks, ["difficulty"])
    want = finds.join(tasks, "user_id").join(pairs, ["item_id", "sig"])
    assert sorted(map(tuple, hits.select("user_id", "item_id", "sig").collect())) == sorted(map(tuple, want.select("user_id", "item_id", "sig").collect()))


def test_no_items_and_no_rules(spark):
    table = items(spark)
    stored, _ = attached(spark, [{"kind": "type_in", "codes": ["a"]}, {"kind": "terrain_between", "min": 1, "max": 2}])
    assert stored.pairs(table.where("false")).count() == 0
    none, _ = attached(spark, [{"kind": "moon_phase"}])
    assert none.pairs(table).count() == 0


def test_items_are_dealt_by_their_number(spark, monkeypatch):
    """Items travel to many tasks, rules to the items: the join's work follows the items, not their files."""
    table = items(spark).coalesce(1)
    stored, _ = attached(spark, [{"kind": "type_in", "codes": ["a"]}, {"kind": "not", "node": {"kind": "placed_year", "year": 1990}}])
    want = sorted(map(tuple, ri.matching_pairs(table, stored.programs).collect()))
    monkeypatch.setattr(ri, "ITEMS_PER_PARTITION", 4)
    pairs = ri.matching_pairs(table, stored.programs)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-table.count() // 4)}), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" in plan and "BuildRight" in plan
    assert sorted(map(tuple, pairs.collect())) == want
