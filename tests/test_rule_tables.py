import itertools
import json
import time

from pyspark.sql import functions as F

from cairnwise.operators import rule_tables as rt
from cairnwise.operators.rules import matching_items

A, B = {"kind": "type_in", "codes": ["a"]}, {"kind": "type_in", "codes": ["b"]}
C, D = {"kind": "placed_year", "year": 2010}, {"kind": "placed_year", "year": 2011}
SUM = {"kind": "aggregate_sum_terrain_at_least", "min_total": 5}


def land(*nodes):
    return {"kind": "and", "nodes": list(nodes)}


def lor(*nodes):
    return {"kind": "or", "nodes": list(nodes)}


def lnot(node):
    return {"kind": "not", "node": node}


def lookup(spark):
    rows = [("type", "code", c, None, c, 1) for c in "abcd"]
    return spark.createDataFrame(rows, "kind string, field string, key string, scope string, id string, candidates long")


def signatures(spark, *rules):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rules)], "k long, expression string")
    return {r.k: r for r in rt.rule_signatures(rows, "k", lookup(spark)).collect()}


def test_different_trees_have_different_signatures(spark):
    got = signatures(
        spark, lor(land(A, B), land(C, D)), lor(land(A, C), land(B, D)), lnot(lor(A, B)), lnot(land(A, B)), lor(A, B), land(A, B), lnot(A), A
    )
    for one, two in itertools.combinations(got, 2):
        assert got[one].signature != got[two].signature, (one, two)


def test_equal_trees_share_a_signature(spark):
    got = signatures(spark, land(A, land(C, B)), land(B, A, C, A), {"nodes": [A, B, C]}, land(lor(C), land(land(A, B)), SUM))
    assert len({r.signature for r in got.values()}) == 1
    assert [got[i].and_only for i in range(4)] == [True, True, True, False]
    assert (got[3].agg_kind, got[3].agg_target) == ("terrain", 5)
    same = signatures(spark, lor(land(A, B), land(B, A)), land(A, B))
    assert same[0].signature == same[1].signature


def test_edges(spark):
    got = signatures(spark, SUM, {"kind": "type_in", "codes": ['}}{"\\{{', "a"]}, "not json", land(land(), A), lnot(lnot(A)))
    assert got[0].signature == ""
    assert got[1].signature == got[3].signature == "type_in(a|)"
    assert got[2].signature == "(|)"
    assert got[4].signature == "not[not[type_in(a|)]]"


def test_wide_and_deep_rules(spark):
    wide = lor(*[land(A, {"kind": "placed_year", "year": 1000 + i}) for i in range(500)])
    deep = A
    for i in range(12):
        deep = (land if i % 2 else lor)(deep, {"kind": "placed_year", "year": 1000 + i})
    rows = spark.createDataFrame([(0, json.dumps(wide))], "k long, expression string")
    rt.leaves(rows, "k")  # warm
    start = time.monotonic()
    found = rt.leaves(rows, "k")
    found._jdf.queryExecution().executedPlan()
    assert time.monotonic() - start < 2
    assert found.count() == 1000
    got = signatures(spark, wide, deep)
    assert got[0].signature.count("and[") == 500
    assert got[1].signature.count("[") == 12 and got[1].signature.count("placed_year") == 12


def test_programs_agree_with_predicates(spark):
    """Every item under every rule: the stored program says what the Column says."""
    near = {"kind": "attributes", "attributes": [{"id": 3, "is_positive": False}]}
    early, year = {"kind": "placed_before", "date": "2005-01-01"}, {"kind": "placed_year", "year": 2006}
    hard = {"kind": "difficulty_between", "min": 2, "max": 3}
    trees = [A, land(A, lor(hard, near)), lnot(lor(A, early)), lor(lnot(year), land(B, C)), lnot(lnot(near)), land(SUM, lor(A, A)), SUM, land(lor(A, land(B, hard)), lnot(early), year)]
    rows = spark.createDataFrame([(i, json.dumps(tree)) for i, tree in enumerate(trees)], "k long, expression string")
    known = lookup(spark).unionByName(spark.createDataFrame([("attribute", "code", "x", None, "3", 1)], lookup(spark).schema))
    items = spark.createDataFrame(
        [(1, "a", "2004-05-01", 2.0, [(3, False)]), (2, "b", "2006-05-01", 5.0, [(3, True)]), (3, "c", "2006-01-01", 2.5, []), (4, None, None, None, None), (5, "a", "2006-12-31", 3.0, [(3, False), (3, True)])],
        "item_id long, type_code string, placed string, difficulty double, attributes array<struct<attr_id:int,is_positive:boolean>>",
    ).selectExpr("*", "CAST(placed AS DATE) AS placed_at", "CAST(NULL AS STRING) AS size_code", "1 AS country_id", "2 AS state_id", "1D AS terrain")
    pairs = rt.item_keys(items, []).crossJoin(rt.rule_signatures(rows, "k", known).select(F.col("k").alias("rule"), "program"))
    got = {(r.rule, r.item_id) for r in pairs.where(rt.matches(F.col("program"), F.col("k"))).collect()}
    want = {(i, r.item_id) for i, tree in enumerate(trees) for r in matching_items(items, tree).collect()}
    assert got == want
