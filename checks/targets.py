"""Target queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.functions import grids
from cairnwise.operators import progress as p
from cairnwise.operators import targets as g
from cairnwise.session import materialise
from cairnwise.operators.rule_index import StoredRules
from checks.ingest import _alias_table
from checks.progress import RULES, STORED, STORED_SQL, TASK_CTES, StoredEnrolments
from checks.search import haversine_sql
from checks.tables import with_tables

SMALL = 200


def _q(fn):
    return lambda spark, sf: fn(StoredTables(spark, sf))


class StoredTables(StoredEnrolments):
    """Within one query finds and enrolments, and scored targets that are read more
    than once, are written once, as the stored tables they stand for."""

    def scored(self):
        if "_targets" not in self.__dict__:
            self._targets = g.store_targets(_scored(self), "scored")
        return self._targets


def _open(t):
    percents = p.task_progress(t.tasks(), t.finds(), t.items(), RULES)
    return g.open_tasks(t.tasks(), t.enrolments(), percents, RULES)


def _stored_open(t):
    """Open tasks with the percent of the newest stored snapshot."""
    latest = p.latest_snapshots(t.snapshots()).select("uc_id", "percent")
    percents = t.tasks().select("task_id", "uc_id").join(latest, "uc_id")
    return g.open_tasks(t.tasks(), t.enrolments(), percents, RULES)


def _candidates(t, limit=SMALL):
    return g.candidates_by_rank(_stored_open(t), t.users(), t.finds(), t.items(), RULES, limit)


def _scored(t, limit=SMALL, hard=g.HARD_LIMIT):
    return g.score(_candidates(t, limit), t.items(), hard)


def _older(rows):
    """An older target table: a third of today's rows, some with another score,
    and some rows that no longer qualify."""
    older = F.expr("CASE WHEN (uc_id + item_id) % 3 = 0 THEN struct(item_id, CASE WHEN item_id % 2 = 0 THEN score - 0.01 ELSE score END AS score) END")
    stale = F.expr("CASE WHEN item_id % 5 = 0 THEN struct(item_id + 1000000000 AS item_id, score) END")
    rest = [c for c in rows.columns if c not in ("item_id", "score")]
    return rows.select(*rest, F.inline(F.array_compact(F.array(older, stale)))).select(*rows.columns)


def target_candidates(t):
    return _candidates(t).select("task_id", "uc_id", "item_id")


def covered_dt_cells(t):
    tasks = _stored_open(t)
    rows = g.covered_cells(tasks, t.finds(), t.items(), RULES)
    cells = grids.cells_within(F.col("cells_low"), F.col("cells_high"), F.lit(3.0), F.lit(3.0))
    return rows.select("user_id", F.explode(cells).alias("i")).select(
        "user_id", (1 + F.floor(F.col("i") / 9) * 0.5).cast("double").alias("difficulty"), (1 + (F.col("i") % 9) * 0.5).cast("double").alias("terrain")
    )


def _rounded(df, *extra):
    return df.select(
        "uc_id", "item_id", "matched_tasks", "primary_task_id", *extra,
        *[F.round(c, 6).alias(c) for c in ("urgency", "coverage", "geographic", "score")],
    )


def evaluate_targets(t):
    """Default limits, percents from a fresh progress evaluation."""
    cand = g.candidates_by_rank(_open(t), t.users(), t.finds(), t.items(), RULES)
    return _rounded(g.score(cand, t.items()), "code", "type_code")


def score_urgency(t):
    return _scored(t).select("uc_id", "item_id", F.round("urgency", 6).alias("urgency"))


def score_coverage(t):
    return _scored(t).select("uc_id", "item_id", "matched_tasks", F.round("coverage", 6).alias("coverage"))


def score_composite(t):
    """Other weights than the default, without a centre."""
    rows = g.score(_candidates(t), t.items(), weights={"urgency": 0.9, "coverage": 0.4})
    return rows.select("uc_id", "item_id", F.round("score", 6).alias("score"))


def primary_task(t):
    return _scored(t).select("uc_id", "item_id", "primary_task_id")


def evaluate_targets_hard_limit(t):
    return _rounded(_scored(t, SMALL, hard=25))


def evaluate_targets_geo(t):
    centres = t.users().select("user_id", F.col("home_lat").alias("centre_lat"), F.col("home_lon").alias("centre_lon"))
    cand = g.candidates_by_distance(_stored_open(t), centres, t.users(), t.finds(), t.items(), RULES, 90.0, SMALL)
    return _rounded(g.score(cand, t.items(), radius_km=90.0, weights={"geographic": 0.5}), F.round("distance_m", 1).alias("distance_m"))


def evaluate_all(t):
    """Upsert of the small-limit targets into an older table, counted per user."""
    return g.evaluation_counts(g.merge_targets(_older(t.scored()), t.scored(), dealt=True))


def evaluate_all_forced(t):
    accepted = t.enrolments().where("status = 'accepted'")
    return g.evaluation_counts(g.merge_targets(_older(t.scored()), t.scored(), evaluated=accepted, dealt=True))


def needs_evaluation(t):
    return g.needs_evaluation(t.enrolments(), _older(_scored(t)), limit=2, hard_limit=2000).select("uc_id")


def clear_targets(t):
    gone = t.enrolments().where("seed % 3 = 1")
    return g.clear_targets(_older(_scored(t)), gone).select("uc_id", "item_id")


def list_targets(t):
    rows = g.list_targets(t.scored(), sort="-score,code", page=2, size=15, enrolments=t.enrolments(), status="accepted")
    return rows.select("user_id", "uc_id", "item_id", F.round("score", 6).alias("score"), "position", "nb_items", "nb_pages")


def targets_nearby(t):
    places = t.users().select("user_id", F.col("home_lat").alias("place_lat"), F.col("home_lon").alias("place_lon"))
    near = materialise(g.targets_nearby(t.scored(), places, 120.0), "near-targets")
    rows = g.list_targets(near, sort="distance", page=1, size=10)
    return rows.select("user_id", "uc_id", "item_id", F.round("distance_m", 1).alias("distance_m"), "position", "nb_items", "nb_pages")


# Every task's own rule, and/or/not and a matrix included.
OWN_RULES = STORED.replace("% 7\n", "% 8\n").replace(
    "ELSE", """WHEN 7 THEN '{"nodes":[{"kind":"aggregate_dt_matrix_complete","max_difficulty":3,"max_terrain":3},{"kind":"size_in","codes":["M","S"]}]}' ELSE"""
)
OWN_RULES_SQL = STORED_SQL.replace("t.task_id % 7 WHEN 0", "o.task_id % 8 WHEN 0").replace("t.task_id", "o.task_id").replace(
    " END", " WHEN 7 THEN size_code IN ('M', 'S') END"
)


def _own(t):
    """(rules, open tasks) by the tasks' own expressions, with each task's percent of the newest snapshot."""
    rules = StoredRules(_alias_table(t))
    tasks = t.tasks().withColumn("expression", F.expr(OWN_RULES))
    percents = p.latest_task_progress(t.task_snapshots()).select("task_id", "percent")
    return rules, g.open_tasks(tasks, t.enrolments(), percents, rules, and_only=False)


def _own_candidates(t, limit=SMALL):
    rules, tasks = _own(t)
    return g.candidates_by_rank(tasks, t.users(), t.finds(), t.items(), rules, limit)


def target_candidates_stored(t):
    return _own_candidates(t).select("task_id", "uc_id", "item_id")


def target_candidates_stored_few(t):
    """So few per task that several lists of a matrix task have to be read together."""
    return _own_candidates(t, 7).select("task_id", "uc_id", "item_id")


def evaluate_targets_stored(t):
    return _rounded(g.score(_own_candidates(t), t.items()))


def evaluate_targets_stored_geo(t):
    rules, tasks = _own(t)
    centres = t.users().select("user_id", F.col("home_lat").alias("centre_lat"), F.col("home_lon").alias("centre_lon"))
    cand = g.candidates_by_distance(tasks, centres, t.users(), t.finds(), t.items(), rules, 90.0, SMALL)
    return _rounded(g.score(cand, t.items(), radius_km=90.0, weights={"geographic": 0.5}), F.round("distance_m", 1).alias("distance_m"))


def evaluate_all_stored(t):
    """Targets by the tasks' own rules, merged into an older table of them."""
    scored = g.store_targets(g.score(_own_candidates(t), t.items()), "own-targets")
    return g.evaluation_counts(g.merge_targets(_older(scored), scored, dealt=True))


def refresh_status(t):
    return g.refresh_status(t.users())


def _ctes(limit, percents="stored", candidate_extra=""):
    source = {
        "stored": "SELECT t.*, coalesce(l.percent, 0) AS percent FROM tasks t LEFT JOIN (SELECT uc_id, max_by(percent, checked_at) AS percent FROM snapshots GROUP BY uc_id) l USING (uc_id)",
        "live": "SELECT task_id, uc_id, user_id, ord, rule_id, percent FROM progress",
    }[percents]
    ctes = dict(TASK_CTES)
    ctes["pct"] = source
    ctes["opened"] = """SELECT * FROM (SELECT p.task_id, p.uc_id, p.user_id, p.ord, p.rule_id, p.percent / 100.0::DOUBLE AS ratio, count(*) OVER (PARTITION BY p.uc_id) AS incomplete
 FROM pct p JOIN enrolments e USING (uc_id) WHERE e.status = 'accepted' AND p.percent < 100) WHERE rule_id <> 11"""
    ctes["cov"] = "SELECT DISTINCT user_id, difficulty, terrain FROM finds JOIN items USING (item_id)"
    ctes["pool"] = """SELECT o.*, i.item_id, i.lat, i.lon FROM opened o JOIN matches m USING (rule_id) JOIN items i ON i.item_id = m.item_id
 ANTI JOIN finds f ON f.user_id = o.user_id AND f.item_id = i.item_id
 WHERE coalesce(i.status, '') NOT IN ('disabled','archived') AND (o.rule_id <> 10 OR (i.difficulty <= 3 AND i.terrain <= 3 AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.user_id = o.user_id AND cov.difficulty = i.difficulty AND cov.terrain = i.terrain)))"""
    ctes["cand"] = f"SELECT *, CAST(NULL AS DOUBLE) AS distance_m FROM pool QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY item_id) <= {limit}"
    ctes["scored"] = _scored_sql(0.3, "0.0::DOUBLE", g.HARD_LIMIT)
    ctes["existing"] = """SELECT user_id, uc_id, item_id, CASE WHEN item_id % 2 = 0 THEN score - 0.01 ELSE score END AS score FROM scored WHERE (uc_id + item_id) % 3 = 0
 UNION ALL SELECT user_id, uc_id, item_id + 1000000000, score FROM scored WHERE item_id % 5 = 0"""
    return ctes


def _own_ctes(limit):
    """The same with the tasks' own rules and the percents of their snapshot entries."""
    ctes = _ctes(limit)
    ctes["pct"] = """SELECT t.*, coalesce(l.percent, 0) AS percent FROM tasks t LEFT JOIN (SELECT task_id, max_by(percent, checked_at) AS percent FROM task_snapshots GROUP BY task_id) l USING (task_id)"""
    ctes["opened"] = ctes["opened"].replace("rule_id <> 11", "task_id % 8 <> 6")
    ctes["pool"] = f"""SELECT o.*, i.item_id, i.lat, i.lon FROM opened o JOIN items i ON {OWN_RULES_SQL}
 ANTI JOIN finds f ON f.user_id = o.user_id AND f.item_id = i.item_id
 WHERE coalesce(i.status, '') NOT IN ('disabled','archived') AND (o.task_id % 8 <> 7 OR (i.difficulty <= 3 AND i.terrain <= 3 AND NOT EXISTS (SELECT 1 FROM cov
  WHERE cov.user_id = o.user_id AND cov.difficulty = i.difficulty AND cov.terrain = i.terrain AND cov.size_code IN ('M', 'S'))))"""
    ctes["cov"] = "SELECT DISTINCT user_id, difficulty, terrain, size_code FROM finds JOIN items USING (item_id)"
    return ctes


def _with_own(limit=SMALL, **replaced):
    ctes = _own_ctes(limit)
    ctes.update(replaced)
    return with_tables("items", "item_attributes", "finds", "users", "tasks", "snapshots", "task_snapshots", extra=ctes)


def _scored_sql(geo_weight, geographic, hard):
    return f"""SELECT s.*, i.code, i.title, i.type_code, i.lat, i.lon, least(urgency * 0.4::DOUBLE + coverage * 0.3::DOUBLE + geographic * {geo_weight}::DOUBLE, 1.0) AS score FROM (
 SELECT *, least(best, 1.0::DOUBLE) AS urgency, least(matched_tasks::DOUBLE / incomplete, 1.0::DOUBLE) AS coverage, {geographic} AS geographic FROM (
 SELECT uc_id, user_id, item_id, count(*) AS matched_tasks, max(ratio) AS best, arg_max(task_id, ratio * 10 - ord) AS primary_task_id, max(incomplete) AS incomplete,
  min(ord) AS first_ord, min(distance_m) AS distance_m FROM cand GROUP BY uc_id, user_id, item_id)
 QUALIFY row_number() OVER (PARTITION BY uc_id ORDER BY first_ord, distance_m NULLS FIRST, item_id) <= {hard}) s JOIN items i USING (item_id)"""


def _with(limit=SMALL, percents="stored", **replaced):
    ctes = _ctes(limit, percents)
    ctes.update(replaced)
    return with_tables("items", "item_attributes", "finds", "users", "tasks", "snapshots", extra=ctes)


# The primary task is the best ratio, then the lower order: ratios of the two
# tasks are compared exactly here rather than through a combined number.
PRIMARY = "arg_max(task_id, ratio * 10 - ord)"
EXACT_PRIMARY = "list(task_id ORDER BY ratio DESC, ord)[1]"
ROUNDED = "round(urgency, 6) AS urgency, round(coverage, 6) AS coverage, round(geographic, 6) AS geographic, round(score, 6) AS score"
D = haversine_sql("home_lat", "home_lon", "lat", "lon")
GEO = "1.0::DOUBLE / (1.0::DOUBLE + pow(distance_m / (300.0::DOUBLE * 90), 2))"


def _sql(text):
    return text.replace(PRIMARY, EXACT_PRIMARY)


MERGED = """SELECT coalesce(s.user_id, e.user_id) AS user_id, coalesce(s.uc_id, e.uc_id) AS uc_id,
 CASE WHEN e.uc_id IS NULL THEN 'inserted' WHEN s.uc_id IS NULL THEN 'kept' WHEN s.score = e.score THEN 'same' ELSE 'updated' END AS change
 FROM scored s FULL JOIN existing e ON s.uc_id = e.uc_id AND s.item_id = e.item_id"""
COUNTS = "SELECT user_id, count(DISTINCT uc_id) AS enrolments, count(*) FILTER (WHERE change='inserted') AS inserted, count(*) FILTER (WHERE change='updated') AS updated, count(*) AS total FROM ({}) GROUP BY user_id"

CHECKS = {
    "target_candidates": (_q(target_candidates), _sql(_with() + "SELECT task_id, uc_id, item_id FROM cand")),
    "covered_dt_cells": (
        _q(covered_dt_cells),
        _sql(_with() + "SELECT DISTINCT c.user_id, c.difficulty, c.terrain FROM cov c JOIN opened o USING (user_id) WHERE o.rule_id = 10 AND c.difficulty <= 3 AND c.terrain <= 3"),
    ),
    "evaluate_targets": (
        _q(evaluate_targets),
        _sql(_with(g.LIMIT_PER_TASK, "live") + f"SELECT uc_id, item_id, matched_tasks, primary_task_id, code, type_code, {ROUNDED} FROM scored"),
    ),
    "evaluate_targets_hard_limit": (
        _q(evaluate_targets_hard_limit),
        _sql(_with(scored=_scored_sql(0.3, "0.0::DOUBLE", 25)) + f"SELECT uc_id, item_id, matched_tasks, primary_task_id, {ROUNDED} FROM scored"),
    ),
    "score_composite_geo": (
        _q(evaluate_targets_geo),
        _sql(
            _with(
                cand=f"""SELECT p.*, {D} * 1000 AS distance_m FROM pool p JOIN users USING (user_id) WHERE {D} * 1000 <= 90000
 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY {D} * 1000, item_id) <= {SMALL}""",
                scored=_scored_sql(0.5, GEO, g.HARD_LIMIT),
            )
            + f"SELECT uc_id, item_id, matched_tasks, primary_task_id, round(distance_m, 1) AS distance_m, {ROUNDED} FROM scored"
        ),
    ),
    "score_urgency": (_q(score_urgency), _sql(_with() + "SELECT uc_id, item_id, round(urgency, 6) AS urgency FROM scored")),
    "score_coverage": (_q(score_coverage), _sql(_with() + "SELECT uc_id, item_id, matched_tasks, round(coverage, 6) AS coverage FROM scored")),
    "score_composite": (
        _q(score_composite),
        _sql(_with() + "SELECT uc_id, item_id, round(least(urgency * 0.9::DOUBLE + coverage * 0.4::DOUBLE, 1.0), 6) AS score FROM scored"),
    ),
    "primary_task": (_q(primary_task), _sql(_with() + "SELECT uc_id, item_id, primary_task_id FROM scored")),
    "evaluate_all_targets": (_q(evaluate_all), _sql(_with() + COUNTS.format(MERGED))),
    "evaluate_all_targets_forced": (
        _q(evaluate_all_forced),
        _sql(_with() + "SELECT user_id, count(DISTINCT uc_id) AS enrolments, count(*) AS inserted, 0::BIGINT AS updated, count(*) AS total FROM scored GROUP BY user_id"),
    ),
    "targets_needing_evaluation": (
        _q(needs_evaluation),
        _sql(_with() + "SELECT uc_id FROM enrolments WHERE status = 'accepted' AND uc_id NOT IN (SELECT uc_id FROM existing GROUP BY uc_id HAVING count(*) >= 10)"),
    ),
    "clear_targets": (
        _q(clear_targets),
        _sql(_with() + "SELECT uc_id, item_id FROM existing WHERE uc_id NOT IN (SELECT uc_id FROM enrolments WHERE seed % 3 = 1)"),
    ),
    "list_targets": (
        _q(list_targets),
        _sql(_with() + """SELECT user_id, uc_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, code, uc_id, item_id) AS INT) AS position,
 count(*) OVER (PARTITION BY user_id) AS nb_items, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 15) AS BIGINT) AS nb_pages FROM scored QUALIFY position BETWEEN 16 AND 30"""),
    ),
    "targets_nearby": (
        _q(targets_nearby),
        _sql(_with() + f"""SELECT user_id, uc_id, item_id, round(d, 1) AS distance_m, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d, uc_id, item_id) AS INT) AS position,
 count(*) OVER (PARTITION BY user_id) AS nb_items, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 10) AS BIGINT) AS nb_pages
 FROM (SELECT s.*, {D} * 1000 AS d FROM scored s JOIN users USING (user_id)) WHERE d <= 120000 QUALIFY position <= 10"""),
    ),
    "target_candidates_stored": (_q(target_candidates_stored), _with_own() + "SELECT task_id, uc_id, item_id FROM cand"),
    "target_candidates_stored_few": (_q(target_candidates_stored_few), _with_own(7) + "SELECT task_id, uc_id, item_id FROM cand"),
    "evaluate_targets_stored": (
        _q(evaluate_targets_stored), _sql(_with_own() + f"SELECT uc_id, item_id, matched_tasks, primary_task_id, {ROUNDED} FROM scored")
    ),
    "evaluate_targets_stored_geo": (
        _q(evaluate_targets_stored_geo),
        _sql(
            _with_own(
                cand=f"""SELECT p.*, {D} * 1000 AS distance_m FROM pool p JOIN users USING (user_id) WHERE {D} * 1000 <= 90000
 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY {D} * 1000, item_id) <= {SMALL}""",
                scored=_scored_sql(0.5, GEO, g.HARD_LIMIT),
            )
            + f"SELECT uc_id, item_id, matched_tasks, primary_task_id, round(distance_m, 1) AS distance_m, {ROUNDED} FROM scored"
        ),
    ),
    "evaluate_all_targets_stored": (_q(evaluate_all_stored), _sql(_with_own() + COUNTS.format(MERGED))),
    "targets_refresh_status": (
        _q(refresh_status),
        with_tables("users") + "SELECT user_id, coalesce(last_import_at IS NOT NULL AND (last_evaluated_at IS NULL OR last_import_at > last_evaluated_at), false) AS needs_refresh, last_import_at, last_evaluated_at FROM users",
    ),
}
