import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairnwise.operators import progress as p
from cairnwise.operators.rules import RuleSet, aggregate_of, is_and_only, matching_items, resolve_labels, signature, wrap

ITEMS = "item_id long, type_code string, size_code string, country_id int, state_id int, placed_at date, difficulty double, terrain double, elevation int, attributes array<struct<attr_id:int,is_positive:boolean>>"


def items(spark, n=12):
    rows = [
        (i, "abc"[i % 3], "SM"[i % 2], i % 4 if i % 5 else None, None, dt.date(2010, 1, 1) + dt.timedelta(days=40 * i), 1 + i % 5 * 0.5, 1 + i % 3 * 0.5,
         100 * i if i % 2 else None, [(i % 3, True), (7, i % 2 == 0)])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ITEMS)


def ids(df):
    return sorted(r.item_id for r in df.collect())


def test_leaf_edges(spark):
    data = items(spark)
    assert ids(matching_items(data, {"kind": "type_in", "codes": []})) == list(range(12))
    assert ids(matching_items(data, {"kind": "country_is"})) == []
    assert ids(matching_items(data, {"kind": "state_in", "state_ids": []})) == []
    assert ids(matching_items(data, {"kind": "placed_before", "date": "2010-01-01"})) == []
    assert ids(matching_items(data, {"kind": "placed_after", "date": "2010-01-01"})) == list(range(1, 12))
    assert ids(matching_items(data, {"kind": "not", "node": {"kind": "country_is", "country_id": 1}})) == [0, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    both = {"kind": "attributes", "attributes": [{"id": 1}, {"id": 7, "is_positive": False}]}
    assert ids(matching_items(data, both)) == [1, 7]
    assert ids(matching_items(data, {"kind": "attributes", "attributes": [{"code": "unknown"}]})) == []


def test_every_leaf_form(spark):
    data = items(spark).withColumn("state_id", F.col("item_id").cast("int") % 3)
    assert ids(matching_items(data, {"kind": "type_in", "types": [{"code": "b"}]})) == [1, 4, 7, 10]
    assert ids(matching_items(data, {"kind": "type_in", "type_ids": ["zzz"]})) == []
    assert ids(matching_items(data, {"kind": "size_in", "codes": ["s"]})) == [0, 2, 4, 6, 8, 10]
    assert ids(matching_items(data, {"kind": "attributes", "codes": ["one"]})) == []
    with pytest.raises(ValueError):
        matching_items(data, {"kind": "size_in", "names": ["small"]})
    rows = [("type", "code", "b", None, "b", 1), ("size", "name", "small", None, "S", 1), ("size", "alias", "tiny", None, "S", 1),
            ("country", "name", "land", None, "1", 1), ("state", "name", "north", "1", "2", 1), ("state", "name", "south", "1", "0", 2),
            ("attribute", "name", "one", None, "1", 1)]
    lookup = spark.createDataFrame(rows, "kind string, field string, key string, scope string, id string, candidates long")
    cases = [
        ({"kind": "type_in", "types": [{"type_code": "B"}], "codes": ["nonsense"]}, [1, 4, 7, 10]),
        ({"kind": "type_in", "codes": ["nonsense"]}, list(range(12))),
        ({"kind": "type_in", "type_ids": ["c"]}, [2, 5, 8, 11]),
        ({"kind": "size_in", "names": ["Tiny"]}, [0, 2, 4, 6, 8, 10]),
        ({"kind": "size_in", "sizes": [{"name": "SMALL"}, {"id": "M"}]}, list(range(12))),
        ({"kind": "country_is", "country": {"name": "Land"}}, [1, 9]),
        ({"kind": "country_is", "country": {"name": "nowhere"}}, []),
        ({"kind": "state_in", "country_id": 1, "states": [{"name": "North"}, {"name": "South"}]}, [2, 5, 8, 11]),
        ({"kind": "state_in", "states": [{"state_id": 1}]}, [1, 4, 7, 10]),
        ({"kind": "attributes", "codes": ["ONE"]}, [1, 4, 7, 10]),
        ({"kind": "attributes", "attributes": [{"code": "one"}, {"id": 7, "is_positive": False}]}, [1, 7]),
        ({"nodes": [{"kind": "not", "node": {"kind": "type_in", "codes": ["b"]}}, {"kind": "or", "nodes": [{"kind": "attributes", "codes": ["one"]}, {"kind": "size_in", "names": ["small"]}]}]}, [0, 2, 6, 8]),
    ]
    got = resolve_labels(dict(enumerate(rule for rule, _ in cases)), lookup)
    for i, (rule, expected) in enumerate(cases):
        assert ids(matching_items(data, got[i])) == expected, rule


def test_rule_structure():
    nested = {"kind": "and", "nodes": [{"kind": "and", "nodes": [{"kind": "size_in", "codes": ["M"]}]}, {"kind": "aggregate_sum_terrain_at_least", "min_total": 5}]}
    flat = {"kind": "and", "nodes": [{"kind": "size_in", "codes": ["M"]}]}
    assert signature(nested) == signature(flat) == signature(flat["nodes"][0])
    assert aggregate_of(nested) == {"kind": "terrain", "target": 5, "unit": "points", "max_d": None, "max_t": None}
    assert aggregate_of({"kind": "aggregate_dt_matrix_complete"})["target"] == 81
    assert is_and_only(nested) and not is_and_only({"kind": "and", "nodes": [{"kind": "or", "nodes": []}]})
    assert wrap({"nodes": []})["kind"] == "and"


def tasks(spark, rows):
    return spark.createDataFrame(rows, "task_id long, uc_id long, user_id long, ord int, title string, rule_id int, min_count int, status string")


def finds(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, found_date date")


RULES = RuleSet({
    0: {"kind": "type_in", "codes": ["a"]},
    1: {"kind": "aggregate_count_distinct_countries_at_least", "min_total": 3},
    2: {"kind": "aggregate_dt_matrix_complete", "max_difficulty": 1.5, "max_terrain": 1.5},
    3: {"kind": "or", "nodes": [{"kind": "type_in", "codes": ["a"]}]},
    4: {"kind": "and", "nodes": [{"kind": "type_in", "codes": ["b"]}, {"kind": "aggregate_sum_altitude_at_least", "min_total": 100}]},
})
D = dt.date


def evaluate(spark, task_rows, **kw):
    found = finds(spark, [(1, i, D(2020, 1, 1) + dt.timedelta(days=i)) for i in range(10)] + [(2, 0, D(2020, 5, 5))])
    return {r.task_id: r for r in p.task_progress(tasks(spark, task_rows), found, items(spark), RULES, **kw).collect()}


def test_task_progress_cases(spark):
    got = evaluate(spark, [
        (1, 1, 1, 0, None, 0, 3, "todo"), (2, 1, 1, 1, "t", 0, 8, None), (3, 1, 1, 2, "t", 0, 0, "todo"), (4, 1, 1, 3, "t", 1, 0, "todo"),
        (5, 1, 1, 4, "t", 2, 0, "todo"), (6, 1, 1, 5, "t", 3, 2, "todo"), (7, 1, 1, 6, "t", 0, 9, "done"), (8, 1, 2, 7, "t", 4, 1, "todo"), (9, 1, 1, 8, "t", 4, 2, "todo"),
    ])
    assert (got[1].title, got[1].current_count, got[1].percent, got[1].status) == ("Task", 4, 100.0, "done")
    assert got[1].start_found_at == D(2020, 1, 1) and got[1].completed_at == D(2020, 1, 7)
    assert (got[2].percent, got[2].status, got[2].completed_at) == (50.0, "todo", None)
    assert (got[3].percent, got[3].status) == (100.0, "done")
    assert (got[4].agg_total, got[4].agg_unit, got[4].status) == (5, "countries", "done")  # four countries and the missing one
    assert (got[5].agg_total, got[5].agg_target, got[5].percent) == (3, 4, 75.0)
    assert (got[6].supported, got[6].current_count, got[6].percent) == (False, 0, 0.0)
    assert (got[7].current_count, got[7].percent, got[7].status) == (9, 100.0, "done")
    assert (got[8].current_count, got[8].percent, got[8].start_found_at) == (0, 0.0, None)
    assert (got[9].agg_total, got[9].percent, got[9].status) == (800, 100.0, "done")
    forced = evaluate(spark, [(7, 1, 1, 6, "t", 0, 9, "done"), (6, 1, 1, 5, "t", 3, 2, "todo")], force=True, and_only=False)
    assert forced[7].status == "done" and forced[7].current_count == 4
    assert forced[6].supported and forced[6].current_count == 4


def test_enrolment_rollup_and_vacuous_completion(spark):
    uc = spark.createDataFrame([(1, 1, "accepted", None), (2, 1, "accepted", None)], "uc_id long, user_id long, status string, computed_status string")
    rows = p.task_progress(
        tasks(spark, [(1, 1, 1, 0, "t", 0, 8, "todo"), (2, 1, 1, 1, "t", 0, 4, "todo"), (3, 1, 1, 2, "t", 3, 50, "todo")]),
        finds(spark, [(1, i, D(2020, 1, 1)) for i in range(10)]), items(spark), RULES,
    )
    got = {r.uc_id: r for r in p.enrolment_progress(uc, rows).collect()}
    assert (got[1].percent, got[1].tasks_done, got[1].tasks_total, got[1].computed_status) == (66.7, 1, 2, None)
    assert (got[2].percent, got[2].tasks_total, got[2].computed_status) == (0.0, 0, "completed")
    strict = {r.uc_id: r for r in p.enrolment_progress(uc, rows, strict=True).collect()}
    assert strict[2].computed_status is None


def test_eta(spark):
    rows = spark.createDataFrame(
        [(1, 1, D(2020, 1, 1), None, 3, 5), (2, 1, D(2020, 1, 1), D(2020, 3, 3), 5, 5), (3, 1, D(2020, 1, 1), None, 1, 5), (4, 2, None, None, 0, 5)],
        "task_id long, uc_id long, start_found_at date, completed_at date, current_count long, min_count long",
    )
    got = {r.task_id: r.eta for r in p.task_eta(rows, "2020-01-11").collect()}
    assert got == {1: D(2020, 1, 21), 2: D(2020, 3, 3), 3: None, 4: None}
    assert {r.uc_id: r.eta for r in p.enrolment_eta(p.task_eta(rows, "2020-01-11")).collect()} == {1: D(2020, 3, 3), 2: None}


@pytest.mark.parametrize("limit,evaluated,skipped", [(1, 1, 2), (2, 2, 2), (10, 2, 2)])
def test_new_candidates(spark, limit, evaluated, skipped):
    uc = spark.createDataFrame([(i, 1, "accepted", D(2020, 1, 1)) for i in range(4)], "uc_id long, user_id long, status string, created_at date")
    snaps = spark.createDataFrame([(0,), (1,)], "uc_id long")
    row = p.new_candidate_counts(p.new_candidates(uc, snaps, limit=limit)).first()
    assert (row.evaluated_count, row.skipped_count) == (evaluated, skipped)


def test_totals_are_made_in_as_many_parts_as_the_finds_ask_for(spark, monkeypatch):
    rows = [(1, 1, 1, 0, None, 0, 3, "todo"), (4, 1, 1, 3, "t", 1, 0, "todo"), (5, 1, 1, 4, "t", 2, 0, "todo")]
    plain = evaluate(spark, rows)
    monkeypatch.setattr(p, "FINDS_PER_PARTITION", 2)
    assert evaluate(spark, rows) == plain
    found = finds(spark, [(1, i, D(2020, 1, 1) + dt.timedelta(days=i)) for i in range(11)])
    measures = p.task_measures(p.with_rules(tasks(spark, rows), RULES), found, items(spark), RULES)
    assert measures._jdf.queryExecution().executedPlan().toString().count(", 6), REPARTITION_BY_NUM") >= 2


def test_totals_are_summed_without_collecting(spark):
    """Countries are counted over days, a missing one as one; nothing is gathered in lists."""
    rows = [(1, 1, 1, 0, None, 0, 3, "todo"), (4, 1, 1, 3, "t", 1, 0, "todo"), (5, 1, 1, 4, "t", 2, 0, "todo")]
    found = finds(spark, [(1, i, D(2020, 1, 1) + dt.timedelta(days=i % 3)) for i in range(11)])
    measures = p.task_measures(p.with_rules(tasks(spark, rows), RULES), found, items(spark), RULES)
    plan = measures._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Window")]
    assert "collect_list" not in after and "ObjectHashAggregate" not in after
    assert "collect_set(coalesce" not in plan
    assert measures.count() == 3
