"""Candidate lists against brute force, with a user who found nearly everything."""

import datetime as dt
import random

import pytest

from cairnwise.operators import targets as g
from cairnwise.operators.rules import RuleSet

RULES = RuleSet({
    0: {"kind": "type_in", "codes": ["a", "b"]},
    1: {"kind": "and", "nodes": [{"kind": "size_in", "codes": ["S"]}, {"kind": "difficulty_between", "min": 1, "max": 3}]},
    2: {"kind": "and", "nodes": [{"kind": "type_in", "codes": ["a"]}, {"kind": "aggregate_dt_matrix_complete", "max_difficulty": 2.5, "max_terrain": 3}]},
    3: {"kind": "and", "nodes": [{"kind": "aggregate_sum_terrain_at_least", "min_total": 9999}]},
    4: {"kind": "or", "nodes": [{"kind": "type_in", "codes": ["a"]}]},
})
HOLDS = {
    0: lambda i: i["type_code"] in "ab",
    1: lambda i: i["size_code"] == "S" and i["difficulty"] <= 3,
    2: lambda i: i["type_code"] == "a",
    3: lambda i: True,
}


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(5)
    items = [
        dict(item_id=k * 3 + 1, code=f"GC{k}", title="t", owner=rnd.choice(["u1", "u2", "x", None]), type_code=rnd.choice("abc"), size_code=rnd.choice("SM"),
             country_id=1, state_id=1, placed_at=dt.date(2010, 1, 1), difficulty=rnd.choice([1.0, 1.5, 2.0, 2.2, 2.5, 4.0]), terrain=rnd.choice([1.0, 1.5, 2.0, 3.0, 3.5]),
             elevation=1, lat=rnd.uniform(45, 46), lon=rnd.uniform(5, 6), status=rnd.choice(["active", "active", None, "archived", "disabled"]), attributes=[])
        for k in range(300)
    ]
    finds = [(1, i["item_id"]) for i in items if rnd.random() < 0.85]
    finds += [(u, i["item_id"]) for u in (2, 3) for i in items if rnd.random() < 0.05]
    tasks = [(u * 100 + r, u * 10, u, r, "t", r, 1, "todo") for u in (1, 2, 3) for r in range(5)]
    schema = ("item_id long, code string, title string, owner string, type_code string, size_code string, country_id int, state_id int, placed_at date,"
              " difficulty double, terrain double, elevation int, lat double, lon double, status string, attributes array<struct<attr_id:int,is_positive:boolean>>")
    frames = dict(
        items=spark.createDataFrame(items, schema),
        finds=spark.createDataFrame([(u, i, dt.date(2020, 1, 1)) for u, i in finds], "user_id long, item_id long, found_date date"),
        users=spark.createDataFrame([(u, f"u{u}", 45.5, 5.5) for u in (1, 2, 3)], "user_id long, username string, centre_lat double, centre_lon double"),
        tasks=spark.createDataFrame(tasks, "task_id long, uc_id long, user_id long, ord int, title string, rule_id int, min_count int, status string"),
        enrolments=spark.createDataFrame([(u * 10, u, "accepted") for u in (1, 2, 3)], "uc_id long, user_id long, status string"),
        percents=spark.createDataFrame([(101, 100.0), (200, 40.0)], "task_id long, percent double"),
    )
    return frames, items, set(finds), tasks


def brute(items, finds, tasks, limit, distance=None):
    out = set()
    for task_id, _, user, rule, *_ in tasks:
        if rule == 4 or task_id == 101:
            continue
        covered = {(i["difficulty"], i["terrain"]) for i in items if (user, i["item_id"]) in finds and HOLDS[rule](i)} if rule == 2 else set()
        pool = []
        for i in items:
            if i["status"] in ("archived", "disabled") or i["owner"] == f"u{user}" or (user, i["item_id"]) in finds or not HOLDS[rule](i):
                continue
            if rule == 2:
                on_grid = (i["difficulty"] * 2) % 1 == 0 and (i["terrain"] * 2) % 1 == 0
                if i["difficulty"] > 2.5 or i["terrain"] > 3 or (on_grid and (i["difficulty"], i["terrain"]) in covered):
                    continue
            key = distance(i) if distance else 0
            if key is not None:
                pool.append((key, i["item_id"]))
        out |= {(task_id, item) for _, item in sorted(pool)[:limit]}
    return out


def opened(world):
    f = world[0]
    return g.open_tasks(f["tasks"], f["enrolments"], f["percents"], RULES)


@pytest.mark.parametrize("limit,block", [(5, 4), (200, 256), (30, 16)])
def test_candidates_by_rank(spark, world, monkeypatch, limit, block):
    monkeypatch.setattr(g, "BLOCK", block)
    monkeypatch.setattr(g, "ID_BUCKETS", 7)
    frames, items, finds, tasks = world
    got = g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, limit)
    assert {(r.task_id, r.item_id) for r in got.collect()} == brute(items, finds, tasks, limit)


def test_candidates_by_distance(spark, world):
    from tests.test_search import haversine

    frames, items, finds, tasks = world

    def near(i):
        d = haversine(45.5, 5.5, i["lat"], i["lon"])
        return d if d <= 30 else None

    got = g.candidates_by_distance(opened(world), frames["users"], frames["users"], frames["finds"], frames["items"], RULES, 30.0, 6)
    assert {(r.task_id, r.item_id) for r in got.collect()} == brute(items, finds, tasks, 6, near)


def test_scores_and_incomplete_count(spark, world):
    frames = world[0]
    rows = g.score(g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 50), frames["items"]).collect()
    for r in rows:
        total = 4 if r.user_id == 1 else 5  # one task of user 1 is done; the 'or' task still counts
        assert r.coverage == r.matched_tasks / total
        assert abs(r.score - (0.4 * r.urgency + 0.3 * r.coverage)) < 1e-12
        if r.user_id == 2 and r.urgency > 0:
            assert r.primary_task_id == 200 and r.urgency == 0.4


def test_hard_limit_keeps_all_tasks_of_kept_items(spark, world):
    frames = world[0]
    cand = g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 50)
    full = {(r.uc_id, r.item_id): r.matched_tasks for r in g.score(cand, frames["items"]).collect()}
    some = {(r.uc_id, r.item_id): r.matched_tasks for r in g.score(cand, frames["items"], hard_limit=7).collect()}
    assert all(full[k] == v for k, v in some.items())
    assert {uc: sum(1 for k in some if k[0] == uc) for uc in (10, 20, 30)} == {10: 7, 20: 7, 30: 7}


def test_merge_twice_changes_nothing(spark, world):
    frames = world[0]
    scored = g.score(g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 10), frames["items"])
    once = g.merge_targets(scored.limit(0), scored)
    again = g.merge_targets(once.drop("change"), scored)
    assert {r.change for r in once.collect()} == {"inserted"} and {r.change for r in again.collect()} == {"same"}
    found = frames["finds"].select("user_id", "item_id")
    assert once.join(found, ["user_id", "item_id"]).count() == 0


def test_an_outlying_id_does_not_crowd_the_buckets(spark):
    ids = [*range(10_000), 10**15]
    lists = spark.createDataFrame([("k", i) for i in ids], "key string, item_id long")
    ranked = g.ranked_postings(lists, lists.select("item_id"))
    assert [(r["item_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [(i, n) for n, i in enumerate(ids, 1)]
    assert g._id_buckets(lists, lists.select("item_id")).groupBy("bucket").count().agg({"count": "max"}).first()[0] < 100


def test_scores_are_grouped_where_the_blocks_were_dealt(spark, world, monkeypatch):
    monkeypatch.setattr(g, "BLOCK", 8)
    monkeypatch.setattr(g, "ROWS_PER_PARTITION", 50)
    monkeypatch.setattr(g, "materialise", lambda df, label: df.localCheckpoint())
    frames = world[0]
    cand = g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 40)
    plan = g.score(cand, frames["items"])._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(dealt) == 1 and "uc_id" in dealt[0], plan


@pytest.mark.parametrize("entries,shown", [(0, 500_000), (4_000_000, 0), (4_000_000, 100)])
def test_lists_and_items_too_many_to_broadcast(spark, world, monkeypatch, entries, shown):
    frames, items, finds, tasks = world
    plain = g.score(g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 30), frames["items"]).collect()
    monkeypatch.setattr(g, "BLOCK", 4)
    monkeypatch.setattr(g, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(g, "BROADCAST_ITEMS", shown)
    got = g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 30)
    assert {(r.task_id, r.item_id) for r in got.collect()} == brute(items, finds, tasks, 30)
    assert sorted(map(repr, g.score(got, frames["items"]).collect())) == sorted(map(repr, plain))


def test_merge_with_coded_items(spark, monkeypatch):
    schema = "uc_id long, item_id long, user_id long, score double, code string, lat double, title string"
    old = spark.createDataFrame([(1, 1, 1, 0.5, "a", 1.0, None), (1, 2, 1, 0.5, "b", 1.0, "t"), (1, 3, 1, 0.5, None, None, "t"), (2, 1, 2, 0.1, "a", 1.0, None), (2, 1, 2, 0.1, "a", 1.0, None), (None, 1, 1, 0.1, "a", 1.0, None)], schema)
    new = spark.createDataFrame([(1, 1, 1, 0.5, "a", 1.0, None), (1, 2, 1, 0.5, "b", 1.5, "t"), (1, 4, 1, 0.5, "d", 2.0, "t"), (2, 1, 2, 0.1, "a", 1.0, None), (None, 1, 1, 0.1, "a", 1.0, None)], schema)
    merged = g.merge_targets(old, new)
    got = sorted(map(repr, merged.collect()))
    assert "variant" in merged._jdf.queryExecution().optimizedPlan().toString()  # item texts do not travel
    monkeypatch.setattr(g, "BROADCAST_ITEMS", 0)
    assert sorted(map(repr, g.merge_targets(old, new).collect())) == got
    assert {(r.uc_id, r.item_id, r.change) for r in merged.collect()} == {
        (1, 1, "same"), (1, 2, "updated"), (1, 3, "kept"), (1, 4, "inserted"), (2, 1, "same"), (None, 1, "kept"), (None, 1, "inserted")}
    assert merged.columns == [*new.columns, "change"]
    assert len(got) == 8
    gone = spark.createDataFrame([(1,), (1,)], "uc_id long")
    assert {r.change for r in g.merge_targets(old, new, evaluated=gone).where("uc_id = 1").collect()} == {"inserted"}


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.fixture
def stored(spark, world, monkeypatch):
    """Scored targets, plain and as stored by enrolment in several parts."""
    monkeypatch.setattr(g, "BLOCK", 8)
    monkeypatch.setattr(g, "ROWS_PER_PARTITION", 50)
    frames = world[0]
    scored = g.score(g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 40), frames["items"])
    kept = g.store_targets(scored, "test-targets")
    assert scored.stored_as.parts > 1
    assert kept.columns == scored.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, scored.collect()))
    return scored, kept


def test_stored_targets_merge_where_they_lie(spark, stored):
    from pyspark.sql import functions as F

    _, kept = stored
    older = kept.where("item_id % 4 > 0").withColumn("score", F.expr("IF(item_id % 2 = 0, score - 0.01, score)")).withColumn("title", F.expr("IF(item_id % 7 = 0, 'old', title)"))
    older = older.select(*[c for c in older.columns if c != "item_id"], F.explode(F.expr("IF(item_id % 5 = 0, array(item_id, item_id, item_id + 1000), array(item_id))")).alias("item_id")).select(*kept.columns)
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    plain = sorted(map(repr, g.merge_targets(older, kept).collect()))
    try:
        merged = g.merge_targets(older, kept, dealt=True)
        assert sorted(map(repr, merged.collect())) == plain
        assert {r.change for r in merged.collect()} == {"inserted", "updated", "same", "kept"}
        assert _exchanges(merged) == []
        gone = kept.select("uc_id").where("uc_id > 10")
        forced = g.merge_targets(older, kept, evaluated=gone, dealt=True)
        assert _exchanges(forced) == []
        assert {r.change for r in forced.where("uc_id > 10").collect()} == {"inserted"}
    finally:
        spark.conf.set(key, "true")


def test_lists_are_ranked_only_as_far_as_tasks_read(spark, monkeypatch):
    monkeypatch.setattr(g, "ID_BUCKETS", 20)
    lists = spark.createDataFrame([(k, i) for i in range(2_000) for k in ("a", "b") if k == "a" or i % 3 == 0], "key string, item_id long")
    deepest = spark.createDataFrame([("a", 150), ("none", 5)], "key string, deepest int")
    counted = []
    monkeypatch.setattr(g, "materialise", lambda df, label: counted.append((label, df.count())) or df)
    got = g.ranked_postings(lists, lists.select("item_id"), deepest)
    assert got.columns == ["key", "item_id", "rank"]
    assert sorted((r["key"], r["item_id"], r["rank"]) for r in got.collect()) == [("a", i, i + 1) for i in range(150)]
    assert counted[0][0] == "read-buckets" and counted[0][1] < 5  # of 40 buckets


def test_items_of_candidates_are_told_by_their_lists(spark, world, monkeypatch):
    frames = world[0]
    written = {}
    real = g.materialise
    monkeypatch.setattr(g, "materialise", lambda df, label: written.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, label))
    monkeypatch.setattr(g, "BROADCAST_ITEMS", 250)  # fewer than the items, more than those on the lists
    cand = g.candidates_by_rank(opened(world), frames["users"], frames["finds"], frames["items"], RULES, 5)
    got = g.score(cand, frames["items"])
    assert got.stored_as is not None and "Generate explode" not in written["candidate-items"]
    ids = {r.item_id for r in cand.select("item_id").collect()}
    assert {r.item_id for r in got.collect()} == ids


def test_targets_nearby_keeps_targets_where_they_lie(spark, stored):
    from tests.test_search import haversine

    _, kept = stored
    rows = [(10, 1, 1, 45.1, 5.1), (10, 1, 1, 45.1, 5.1), (10, 2, 1, 47.0, 5.0), (20, 2, 2, 45.0, 5.0), (None, 3, 1, 45.0, 5.0), (10, 4, 2, 45.0, 5.0), (30, 5, 9, 45.0, 5.0), (40, 6, None, 45.0, 5.0)]
    targets = spark.createDataFrame([(*r, 0.5, "c") for r in rows], "uc_id long, item_id long, user_id long, lat double, lon double, distance_m double, code string")
    places = [(1, 45.0, 5.0), (1, 46.9, 5.0), (2, 45.0, 5.0), (None, 45.0, 5.0)]
    near = g.targets_nearby(targets, spark.createDataFrame(places, "user_id long, place_lat double, place_lon double"), 60.0)
    want = sorted((str(r[2]), r[1], r[0]) for r in rows for p in places if r[2] is not None and r[2] == p[0] and haversine(r[3], r[4], p[1], p[2]) <= 60.0)
    assert sorted((str(r.user_id), r.item_id, r.uc_id) for r in near.collect()) == want
    assert near.columns == ["user_id", "uc_id", "item_id", "lat", "lon", "code", "place_lat", "place_lon", "distance_m"]
    moved = g.targets_nearby(kept, spark.createDataFrame(places, "user_id long, place_lat double, place_lon double"), 60.0)
    assert not any("item_id" in line for line in _exchanges(moved.where("uc_id IS NOT NULL")))


def test_listing_stored_targets_shuffles_only_first_rows(spark, world, stored):
    scored, kept = stored
    enrolments = world[0]["enrolments"]
    got = g.list_targets(kept, sort="-score,code", page=1, size=5, enrolments=enrolments, status="accepted")
    want = g.list_targets(scored, sort="-score,code", page=1, size=5, enrolments=enrolments, status="accepted")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "LeftSemi" in line)
    assert "ShuffledHashJoin" in plan[at] or "Broadcast" in plan[at]
    assert not any("Exchange" in line and "uc_id" in line and k < 3 for k, line in enumerate(plan[at + 1:]))
