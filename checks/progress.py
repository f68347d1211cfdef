"""Rule and progress queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.operators import progress as p
from cairnwise.operators import rules as r
from cairnwise.operators.rule_index import StoredRules
from cairnwise.plans import evaluation
from cairnwise.session import materialise, scratch_path
from cairnwise.sources.versions import Versions
from cairnwise.sources.sample_tables import FIXED_AS_OF, RULE_TEMPLATES, SampleTables
from checks.ingest import _alias_table
from checks.tables import with_tables


class StoredFinds(SampleTables):
    """Within one query finds are written once, as the stored table they stand for, in as many parts as the lines ask for."""

    def finds(self):
        return self._once("finds", self._built_finds)

    def _built_finds(self):
        return super().finds(max(1, -(-self.raw("lineitem").count() // p.FINDS_PER_PARTITION)))

    def _once(self, name, build):
        kept = self.__dict__.setdefault("_stored", {})
        if name not in kept:
            kept[name] = materialise(build(), name)
        return kept[name]


class StoredEnrolments(StoredFinds):
    """Enrolments are written once too; tasks and snapshots are made of them row by row."""

    def enrolments(self):
        return self._once("enrolments", super().enrolments)


def _q(fn, tables=StoredFinds):
    return lambda spark, sf: fn(tables(spark, sf))


# -- single rules -------------------------------------------------------------


def attr_sql(ident, positive):
    sign = "" if positive else "NOT "
    return f"EXISTS (SELECT 1 FROM item_attributes a WHERE a.item_id = i.item_id AND attr_id = {ident} AND {sign}is_positive)"


LEAF_CASES = {
    "rule_type_in": ({"kind": "type_in", "codes": ["ECONOMY", "promo"]}, "type_code IN ('economy','promo')"),
    "rule_type_in_unresolved": ({"kind": "type_in", "codes": []}, "true"),
    "rule_size_in": ({"kind": "size_in", "codes": ["M", "O"]}, "size_code IN ('M','O')"),
    "rule_country_is": ({"kind": "country_is", "country_id": 7}, "country_id = 7"),
    "rule_state_in": ({"kind": "state_in", "state_ids": [13, 14, 15, 28]}, "state_id IN (13,14,15,28)"),
    "rule_placed_year": ({"kind": "placed_year", "year": 2008}, "year(placed_at) = 2008"),
    "rule_placed_before": ({"kind": "placed_before", "date": "2004-03-01"}, "placed_at < DATE '2004-03-01'"),
    "rule_placed_after": ({"kind": "placed_after", "date": "2016-03-01"}, "placed_at > DATE '2016-03-01'"),
    "rule_difficulty_between": ({"kind": "difficulty_between", "min": 2, "max": 3.5}, "difficulty BETWEEN 2 AND 3.5"),
    "rule_terrain_between": ({"kind": "terrain_between", "min": 4, "max": 5}, "terrain BETWEEN 4 AND 5"),
    "rule_attributes": (
        {"kind": "attributes", "attributes": [{"id": 3, "is_positive": True}, {"id": 9, "is_positive": False}]},
        attr_sql(3, True) + " AND " + attr_sql(9, False),
    ),
    "rule_and": (
        {"kind": "and", "nodes": [{"kind": "size_in", "codes": ["S"]}, {"kind": "and", "nodes": [{"kind": "terrain_between", "min": 1, "max": 3}]}]},
        "size_code = 'S' AND terrain BETWEEN 1 AND 3",
    ),
    "rule_or": (
        {"kind": "or", "nodes": [{"kind": "country_is", "country_id": 4}, {"kind": "and", "nodes": [{"kind": "type_in", "codes": ["small"]}, {"kind": "size_in", "codes": ["L"]}]}]},
        "coalesce(country_id = 4, false) OR (type_code = 'small' AND size_code = 'L')",
    ),
    "rule_not": (
        {"kind": "not", "node": {"kind": "or", "nodes": [{"kind": "country_is", "country_id": 4}, {"kind": "placed_year", "year": 2010}]}},
        "NOT (coalesce(country_id = 4, false) OR year(placed_at) = 2010)",
    ),
}


def _leaf_query(rule):
    return _q(lambda t: r.matching_items(t.items(), rule).select("item_id", "code"))


CHECKS = {
    name: (_leaf_query(rule), with_tables("items", "item_attributes") + f"SELECT item_id, code FROM items i WHERE {sql}")
    for name, (rule, sql) in LEAF_CASES.items()
}

# -- tasks --------------------------------------------------------------------

RULES = r.RuleSet(RULE_TEMPLATES)
TEMPLATE_SQL = {
    0: "type_code IN ('economy','small')",
    1: "size_code = 'M' AND difficulty BETWEEN 1 AND 2.5",
    2: "country_id = 3",
    3: "year(placed_at) = 2010",
    4: "placed_at < DATE '2005-01-01' AND terrain BETWEEN 3 AND 5",
    5: "placed_at > DATE '2015-01-01' AND " + attr_sql(1, True),
    6: attr_sql(2, True) + " AND " + attr_sql(8, True),
    7: "true",
    8: "type_code = 'large'",
    9: "true",
    10: "true",
    11: "type_code = 'promo' OR NOT size_code = 'L'",
}
AGG_SQL = """SELECT * FROM (VALUES (7,'diff_plus_terr',200,'points'),(8,'altitude',20000,'meters'),
 (9,'distinct_countries',15,'countries'),(10,'dt_matrix',25,'cells')) v(rule_id, agg_kind, agg_target, agg_unit)"""
MATCHES = " UNION ALL ".join(f"SELECT {k} AS rule_id, item_id FROM items i WHERE {v}" for k, v in TEMPLATE_SQL.items())
HITS = """SELECT t.task_id, t.rule_id, t.min_count, f.item_id, f.found_date, difficulty, terrain, elevation, country_id
 FROM tasks t JOIN finds f USING (user_id) JOIN matches m ON m.rule_id = t.rule_id AND m.item_id = f.item_id JOIN items i ON i.item_id = f.item_id"""
MEASURES = """SELECT task_id, count(*) AS matched, sum(difficulty) AS sd, sum(terrain) AS st, sum(coalesce(elevation,0)) AS sa,
 count(DISTINCT country_id) + max(CASE WHEN country_id IS NULL THEN 1 ELSE 0 END) AS countries,
 count(DISTINCT (difficulty, terrain)) FILTER (WHERE difficulty <= 3 AND terrain <= 3) AS cells,
 min(found_date) AS first_date, CASE WHEN min_count > 0 AND count(*) >= min_count THEN list_sort(list(found_date))[min_count] END AS nth_date
 FROM hits GROUP BY task_id, min_count"""
PROGRESS = """SELECT task_id, uc_id, user_id, ord, coalesce(title, 'Task') AS title, rule_id, supported, CAST(min_count AS BIGINT) AS min_count,
 CASE WHEN old = 'done' THEN min_count WHEN live THEN cur ELSE 0 END AS current_count,
 CAST(CASE WHEN old = 'done' THEN 100 WHEN NOT live THEN 0 WHEN agg_kind IS NULL THEN cp WHEN min_count > 0 THEN least(cp, ap) ELSE ap END AS DOUBLE) AS percent,
 CASE WHEN live AND agg_kind IS NOT NULL THEN total END AS agg_total, CASE WHEN live THEN CAST(agg_target AS BIGINT) END AS agg_target, CASE WHEN live THEN agg_unit END AS agg_unit,
 CASE WHEN live AND (min_count = 0 OR cur >= min_count) AND (agg_kind IS NULL OR total >= agg_target) THEN 'done' ELSE old END AS status,
 CASE WHEN live THEN first_date END AS start_found_at, CASE WHEN live THEN nth_date END AS completed_at
 FROM (SELECT *, 100.0::DOUBLE * (least(cur, min_count)::DOUBLE / nullif(min_count, 0)) AS cp0, coalesce(cp0, 100.0) AS cp,
  least(100.0::DOUBLE, 100.0::DOUBLE * (total::DOUBLE / agg_target)) AS ap FROM (
  SELECT t.*, t.status AS old, t.rule_id <> 11 OR t.status = 'done' AS supported, t.rule_id <> 11 AND t.status <> 'done' AS live,
   coalesce(matched, 0) AS cur, agg_kind, agg_target, agg_unit, first_date, nth_date,
   CAST(trunc(coalesce(CASE agg_kind WHEN 'diff_plus_terr' THEN sd + st WHEN 'altitude' THEN sa WHEN 'distinct_countries' THEN countries WHEN 'dt_matrix' THEN cells END, 0)) AS BIGINT) AS total
  FROM tasks t LEFT JOIN measures USING (task_id) LEFT JOIN aggs ON aggs.rule_id = t.rule_id))"""
TASK_CTES = {"matches": MATCHES, "hits": HITS, "measures": MEASURES, "aggs": AGG_SQL, "progress": PROGRESS}
UC = """SELECT e.uc_id, e.user_id, CASE WHEN coalesce(sum_min, 0) > 0 THEN round_even(100.0::DOUBLE * (sum_current::DOUBLE / sum_min), 1)
  ELSE coalesce(round_even(mean_percent, 1), 0.0) END AS percent, coalesce(tasks_done, 0) AS tasks_done, coalesce(tasks_total, 0) AS tasks_total,
 CASE WHEN coalesce(tasks_done,0) = coalesce(tasks_total,0) AND coalesce(e.computed_status,'') <> 'completed' THEN 'completed' ELSE e.status END AS status,
 CASE WHEN coalesce(tasks_done,0) = coalesce(tasks_total,0) THEN 'completed' ELSE e.computed_status END AS computed_status
 FROM enrolments e LEFT JOIN (SELECT uc_id, CAST(sum(min_count) FILTER (WHERE supported) AS BIGINT) AS sum_min,
  sum(CASE WHEN min_count > 0 THEN least(current_count, min_count) ELSE current_count END) FILTER (WHERE supported) AS sum_current,
  count(*) FILTER (WHERE supported) AS tasks_total, count(*) FILTER (WHERE supported AND status = 'done') AS tasks_done,
  avg(percent) FILTER (WHERE supported) AS mean_percent FROM progress GROUP BY uc_id) s USING (uc_id)"""
WITH_TASKS = with_tables("items", "item_attributes", "finds", "tasks", "snapshots", extra=TASK_CTES)
ETA = f"""SELECT task_id, uc_id, CASE WHEN completed_at IS NOT NULL THEN completed_at
 WHEN start_found_at IS NOT NULL AND current_count > 1 AND min_count > current_count THEN
 CAST(DATE '{FIXED_AS_OF}' + CAST(ceil((min_count - current_count) / ((current_count - 1) / greatest(date_diff('day', start_found_at, DATE '{FIXED_AS_OF}'), 1))) AS INT) AS DATE) END AS eta FROM progress"""


def _measures(t):
    tasks = p.with_rules(t.tasks(), RULES, and_only=False)
    return tasks.select("task_id", "agg_kind").join(p.task_measures(tasks, t.finds(), t.items(), RULES), "task_id", "left")


def task_match_count(t):
    return _measures(t).select("task_id", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def task_aggregate(t):
    """All six aggregate values for every task, whatever its own kind."""
    every = {k: {"kind": "and", "nodes": [v]} for k, v in RULE_TEMPLATES.items() if k not in (7, 8, 9, 10)}
    every.update({
        7: {"kind": "aggregate_sum_difficulty_at_least", "min_total": 100},
        8: {"kind": "and", "nodes": [{"kind": "aggregate_sum_terrain_at_least", "min_total": 100}, {"kind": "type_in", "codes": ["large"]}]},
        9: {"kind": "aggregate_count_distinct_countries_at_least", "min_total": 15},
        10: {"kind": "aggregate_dt_matrix_complete", "max_difficulty": 3, "max_terrain": 3},
    })
    rules = r.RuleSet(every)
    tasks = p.with_rules(t.tasks(), rules, and_only=False)
    rows = p.task_measures(tasks, t.finds(), t.items(), rules)
    return rows.select(
        "task_id", F.col("sum_difficulty"), F.col("sum_terrain"),
        (F.col("sum_difficulty") + F.col("sum_terrain")).alias("sum_diff_plus_terr"),
        F.col("sum_altitude"), "countries", "cells",
    )


def _agg(rule, column):
    """One aggregate for every user over all of their finds of an item rule."""

    def run(t):
        rules = r.RuleSet({0: rule})
        # Every user gets rule 0; written as a column so that the rule join stays an equi join.
        zero = (F.col("user_id") - F.col("user_id")).cast("int")
        tasks = t.users().select(F.col("user_id").alias("task_id"), "user_id", zero.alias("rule_id"), F.lit(0).alias("min_count"))
        tasks = p.with_rules(tasks, rules)
        rows = tasks.join(p.task_measures(tasks, t.finds(), t.items(), rules), "task_id", "left")
        total = p.aggregate_total(F.col("agg_kind"))
        return rows.select("user_id", total.alias(column), (total >= F.col("agg_target")).alias("reached"))

    return _q(run)


def nth_find_date(t):
    tasks = p.with_rules(t.tasks(), RULES, and_only=False)
    return p.task_measures(tasks, t.finds(), t.items(), RULES).select("task_id", "first_date", "nth_date")


def first_find_date(t):
    """The first matching find of every task, null where there is none yet."""
    tasks = p.with_rules(t.tasks(), RULES, and_only=False)
    dates = p.task_measures(tasks, t.finds(), t.items(), RULES).select("task_id", "first_date")
    return tasks.select("task_id").join(dates, "task_id", "left")


def task_progress(t):
    return p.task_progress(t.tasks(), t.finds(), t.items(), RULES)


# Every task's own rule as JSON, with numbers of its own and labels for some ids.
STORED = """CASE task_id % 7
 WHEN 0 THEN format_string('{"kind":"and","nodes":[{"kind":"type_in","types":[{"code":"ECONOMY"}]},{"kind":"difficulty_between","min":1,"max":%d}]}', 1 + task_id % 4)
 WHEN 1 THEN format_string('{"kind":"or","nodes":[{"kind":"country_is","country_id":%d},{"kind":"and","nodes":[{"kind":"size_in","names":["micro"]},{"kind":"terrain_between","min":3,"max":5}]}]}', task_id % 25)
 WHEN 2 THEN format_string('{"kind":"not","node":{"kind":"or","nodes":[{"kind":"placed_year","year":%d},{"kind":"type_in","type_ids":["large","promo"]}]}}', 2000 + task_id % 20)
 WHEN 3 THEN format_string('{"kind":"attributes","attributes":[{"id":%d}]}', task_id % 7)
 WHEN 4 THEN format_string('{"nodes":[{"kind":"aggregate_count_distinct_countries_at_least","min_total":3},{"kind":"placed_before","date":"20%d-01-01"}]}', 10 + task_id % 10)
 WHEN 5 THEN format_string('{"kind":"state_in","states":[{"state_id":%d}],"state_ids":[%d]}', task_id % 100, (task_id + 7) % 100)
 ELSE '{"kind":"moon_phase"}' END"""
STORED_SQL = """CASE t.task_id % 7 WHEN 0 THEN type_code = 'economy' AND difficulty <= 1 + t.task_id % 4
 WHEN 1 THEN country_id = t.task_id % 25 OR (size_code = 'M' AND terrain >= 3)
 WHEN 2 THEN NOT (year(placed_at) = 2000 + t.task_id % 20 OR type_code IN ('large','promo'))
 WHEN 3 THEN EXISTS (SELECT 1 FROM item_attributes a WHERE a.item_id = i.item_id AND attr_id = t.task_id % 7 AND is_positive)
 WHEN 4 THEN placed_at < make_date(CAST(2010 + t.task_id % 10 AS INT), 1, 1)
 WHEN 5 THEN state_id IN (t.task_id % 100, (t.task_id + 7) % 100) END"""
STORED_CTES = {
    "hits": HITS.replace("JOIN matches m ON m.rule_id = t.rule_id AND m.item_id = f.item_id ", "") + f" WHERE {STORED_SQL}",
    "measures": MEASURES,
    "aggs": "SELECT 4 AS rule_id, 'distinct_countries' AS agg_kind, 3 AS agg_target, 'countries' AS agg_unit",
    "progress": PROGRESS.replace("t.rule_id <> 11", "t.task_id % 7 <> 6").replace("aggs.rule_id = t.rule_id", "aggs.rule_id = t.task_id % 7"),
}


WITH_EVALUATED = with_tables(
    "items", "item_attributes", "finds", "tasks", "snapshots",
    extra={**STORED_CTES, "due": "SELECT uc_id FROM enrolments WHERE NOT (coalesce(computed_status = 'completed' OR status = 'completed', false) AND uc_id IN (SELECT uc_id FROM snapshots))"},
)


def task_progress_stored(t):
    """Each task evaluated by the rule in its own row, or/not included."""
    tasks = t.tasks().withColumn("expression", F.expr(STORED))
    return p.task_progress(tasks, t.finds(), t.items(), StoredRules(_alias_table(t)), and_only=False)


def enrolment_progress(t):
    return p.enrolment_progress(t.enrolments(), task_progress(t))


def evaluate_progress(t):
    """Completed enrolments answer with their stored snapshot, the rest is computed."""
    fresh, stored = p.split_completed(t.enrolments(), t.snapshots())
    tasks = t.tasks().join(fresh.select("uc_id"), "uc_id", "left_semi")
    computed = p.enrolment_progress(fresh, p.task_progress(tasks, t.finds(), t.items(), RULES))
    return computed.select("uc_id", "percent", "tasks_done", "tasks_total", F.lit(True).alias("evaluated")).unionByName(
        stored.select(
            "uc_id", "percent", F.col("tasks_done").cast("long").alias("tasks_done"),
            F.col("tasks_total").cast("long").alias("tasks_total"), F.lit(False).alias("evaluated"),
        )
    )


def evaluate_new(t):
    return p.new_candidate_counts(p.new_candidates(t.enrolments(), t.snapshots(), include_pending=True, limit=1, since="2001-02-01"))


def history(t):
    return p.progress_history(t.snapshots(), limit=3, before="2001-07-01").select(
        "uc_id", "checked_at", "percent", "tasks_done", "tasks_total", "position", "is_latest"
    )


def task_eta(t):
    return p.task_eta(task_progress(t), FIXED_AS_OF).select("task_id", "uc_id", "eta")


def enrolment_eta(t):
    return p.enrolment_eta(task_eta(t))


def latest_snapshots(t):
    return p.latest_snapshots(t.snapshots()).select("uc_id", "checked_at", "percent")


def latest_task_progress(t):
    """One row per task, from the entries of each enrolment's newest snapshot."""
    return p.latest_task_progress(t.task_snapshots())


def _evaluated(t):
    """An evaluation over the tasks' own rules, committed, and read again from the tables."""
    tables = Versions(t.spark, scratch_path(t.spark, "tables"))
    rules = StoredRules(_alias_table(t))
    tasks = t.tasks().withColumn("expression", F.expr(STORED))
    tables.commit({"tasks": tasks, "enrolments": t.enrolments()})
    result = evaluation.evaluate(tasks, t.enrolments(), t.snapshots(), t.finds(), t.items(), rules, FIXED_AS_OF, and_only=False)
    evaluation.publish(result, tables)
    return tables


def evaluated_task_snapshots(t):
    rows = p.latest_task_progress(_evaluated(t).read("snapshots"))
    return rows.select("task_id", "uc_id", "checked_at", "ord", "status", "supported", "current_count", "percent", "agg_total", "start_found_at", "completed_at")


def evaluated_tasks(t):
    return _evaluated(t).read("tasks").select("task_id", "status", "start_found_at", "completed_at")


def evaluated_enrolments(t):
    return _evaluated(t).read("enrolments").select(
        "uc_id", "status", "computed_status", F.col("progress.percent").alias("percent"), F.col("progress.tasks_done").alias("tasks_done")
    )


def _agg_sql(expr, target, where="true"):
    return with_tables("items", "finds", "users") + f"""SELECT user_id, total AS VALUE_NAME, total >= {target} AS reached FROM (
 SELECT u.user_id, CAST(trunc(coalesce({expr}, 0)) AS BIGINT) AS total FROM users u
 LEFT JOIN (SELECT f.user_id, i.* FROM finds f JOIN items i USING (item_id) WHERE {where}) h USING (user_id) GROUP BY u.user_id)"""


CHECKS.update({
    "agg_sum_difficulty": (_agg({"kind": "aggregate_sum_difficulty_at_least", "min_total": 100}, "sum_difficulty"),
                           _agg_sql("sum(difficulty)", 100).replace("VALUE_NAME", "sum_difficulty")),
    "agg_sum_terrain": (
        _agg({"kind": "and", "nodes": [{"kind": "aggregate_sum_terrain_at_least", "min_total": 20}, {"kind": "size_in", "codes": ["M"]}]}, "sum_terrain"),
        _agg_sql("sum(terrain)", 20, "size_code = 'M'").replace("VALUE_NAME", "sum_terrain"),
    ),
    "agg_sum_diff_plus_terr": (
        _agg({"kind": "aggregate_sum_diff_plus_terr_at_least", "min_total": 200}, "sum_diff_plus_terr"),
        _agg_sql("sum(difficulty) + sum(terrain)", 200).replace("VALUE_NAME", "sum_diff_plus_terr"),
    ),
    "agg_sum_altitude": (_agg({"kind": "aggregate_sum_altitude_at_least", "min_total": 20000}, "sum_altitude"),
                         _agg_sql("sum(coalesce(elevation,0))", 20000).replace("VALUE_NAME", "sum_altitude")),
    "agg_distinct_countries": (
        _agg({"kind": "aggregate_count_distinct_countries_at_least", "min_total": 15}, "countries"),
        _agg_sql("count(DISTINCT h.country_id) + max(CASE WHEN h.item_id IS NOT NULL AND h.country_id IS NULL THEN 1 ELSE 0 END)", 15).replace("VALUE_NAME", "countries"),
    ),
    "agg_dt_matrix": (
        _agg({"kind": "aggregate_dt_matrix_complete", "max_difficulty": 2.5, "max_terrain": 4}, "cells"),
        _agg_sql("count(DISTINCT (difficulty, terrain)) FILTER (WHERE difficulty <= 2.5 AND terrain <= 4)", 28).replace("VALUE_NAME", "cells"),
    ),
    "task_match_count": (_q(task_match_count), WITH_TASKS + "SELECT task_id, coalesce(matched, 0) AS matched FROM tasks LEFT JOIN measures USING (task_id)"),
    "task_aggregate": (
        _q(task_aggregate),
        WITH_TASKS
        + """SELECT task_id, sd AS sum_difficulty, st AS sum_terrain, sd + st AS sum_diff_plus_terr, CAST(sa AS BIGINT) AS sum_altitude,
 CASE WHEN rule_id = 9 THEN countries END AS countries, CASE WHEN rule_id = 10 THEN cells END AS cells FROM measures JOIN tasks USING (task_id)""",
    ),
    "nth_find_date": (_q(nth_find_date), WITH_TASKS + "SELECT task_id, first_date, nth_date FROM measures"),
    "first_find_date": (_q(first_find_date), WITH_TASKS + "SELECT task_id, first_date FROM tasks LEFT JOIN measures USING (task_id)"),
    "task_progress": (_q(task_progress), WITH_TASKS + "SELECT * FROM progress"),
    "task_progress_stored": (_q(task_progress_stored), with_tables("items", "item_attributes", "finds", "tasks", extra=STORED_CTES) + "SELECT * FROM progress"),
    "enrolment_progress": (_q(enrolment_progress), WITH_TASKS + UC),
    "evaluate_progress": (
        _q(evaluate_progress),
        WITH_TASKS
        + f"""SELECT u.uc_id, CASE WHEN stored THEN l.percent ELSE u.percent END AS percent,
 CASE WHEN stored THEN l.tasks_done ELSE u.tasks_done END AS tasks_done, CASE WHEN stored THEN l.tasks_total ELSE u.tasks_total END AS tasks_total, NOT stored AS evaluated
 FROM (SELECT e.uc_id, coalesce(e.computed_status = 'completed', false) AND s.uc_id IS NOT NULL AS stored FROM enrolments e LEFT JOIN (SELECT DISTINCT uc_id FROM snapshots) s USING (uc_id))
 JOIN ({UC}) u USING (uc_id) LEFT JOIN (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY uc_id ORDER BY checked_at DESC) = 1) l USING (uc_id)""",
    ),
    "evaluate_new_progress": (
        _q(evaluate_new),
        with_tables("snapshots")
        + """SELECT user_id, count(*) FILTER (WHERE ev) AS evaluated_count, count(*) FILTER (WHERE NOT ev) AS skipped_count FROM (
 SELECT user_id, uc_id, NOT has AND sum(CASE WHEN has THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY uc_id) <= 1 AS ev FROM (
 SELECT user_id, uc_id, uc_id IN (SELECT uc_id FROM snapshots) AS has FROM enrolments WHERE status IN ('accepted','pending') AND created_at >= DATE '2001-02-01'
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY uc_id) <= 3)) GROUP BY user_id""",
    ),
    "progress_history": (
        _q(history),
        with_tables("snapshots")
        + """SELECT uc_id, checked_at, percent, tasks_done, tasks_total, CAST(row_number() OVER (PARTITION BY uc_id ORDER BY checked_at DESC) AS INT) AS position, position = 1 AS is_latest
 FROM snapshots WHERE checked_at < DATE '2001-07-01' QUALIFY position <= 3""",
    ),
    "task_eta": (_q(task_eta), WITH_TASKS + ETA),
    "enrolment_eta": (_q(enrolment_eta), WITH_TASKS + f"SELECT uc_id, max(eta) AS eta FROM ({ETA}) GROUP BY uc_id"),
    "latest_task_progress": (
        _q(latest_task_progress),
        with_tables("task_snapshots") + "SELECT uc_id, checked_at, ord, task_id, current_count, percent FROM task_snapshots QUALIFY checked_at = max(checked_at) OVER (PARTITION BY uc_id)",
    ),
    "evaluated_task_snapshots": (
        _q(evaluated_task_snapshots, StoredEnrolments),
        WITH_EVALUATED
        + f"""SELECT task_id, uc_id, DATE '{FIXED_AS_OF}' AS checked_at, ord, status, supported, current_count, percent, agg_total, start_found_at, completed_at FROM progress SEMI JOIN due USING (uc_id)""",
    ),
    "evaluated_tasks": (
        _q(evaluated_tasks, StoredEnrolments),
        WITH_EVALUATED
        + """SELECT t.task_id, CASE WHEN d.uc_id IS NULL THEN t.status ELSE p.status END AS status, CASE WHEN d.uc_id IS NOT NULL THEN p.start_found_at END AS start_found_at,
 CASE WHEN d.uc_id IS NOT NULL THEN p.completed_at END AS completed_at FROM tasks t JOIN progress p USING (task_id) LEFT JOIN due d ON d.uc_id = t.uc_id""",
    ),
    "evaluated_enrolments": (
        _q(evaluated_enrolments, StoredEnrolments),
        WITH_EVALUATED
        + f"""SELECT e.uc_id, CASE WHEN d.uc_id IS NULL THEN e.status ELSE u.status END AS status, CASE WHEN d.uc_id IS NULL THEN e.computed_status ELSE u.computed_status END AS computed_status,
 CASE WHEN d.uc_id IS NOT NULL THEN u.percent END AS percent, CASE WHEN d.uc_id IS NOT NULL THEN u.tasks_done END AS tasks_done FROM enrolments e JOIN ({UC}) u USING (uc_id) LEFT JOIN due d USING (uc_id)""",
    ),
    "latest_snapshots": (
        _q(latest_snapshots),
        with_tables("snapshots") + "SELECT uc_id, max(checked_at) AS checked_at, max_by(percent, checked_at) AS percent FROM snapshots GROUP BY uc_id",
    ),
})
