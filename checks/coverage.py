"""Coverage and statistics queries with their SQL."""

from __future__ import annotations

from cairnwise.operators import coverage as cov
from cairnwise.operators import stats
from cairnwise.sources.sample_tables import FIXED_AS_OF, SampleTables
from checks.tables import with_tables

DAYS = (
    "SELECT strftime(DATE '2000-01-01' + CAST(i AS INT), '%m-%d') AS day FROM (SELECT unnest(range(0,366)) AS i)"
)
CELLS = (
    "SELECT 1.0+0.5*a AS difficulty, 1.0+0.5*b AS terrain FROM"
    " (SELECT unnest(range(0,9)) AS a), (SELECT unnest(range(0,9)) AS b)"
)


def _day_counts(t, finds, **filters):
    return cov.calendar_day_counts(cov.matching_finds(finds, t.items(), [], **filters))


def _cell_counts(t, finds, **filters):
    return cov.matrix_cell_counts(cov.matching_finds(finds, t.items(), ["difficulty", "terrain"], **filters))


def _type(t, label):
    return cov.resolve_label(t.item_types(), "type_code", label)


def _size(t, label):
    return cov.resolve_label(t.item_sizes(), "size_code", label)


def q_calendar(spark, sf):
    t = SampleTables(spark, sf)
    return cov.calendar_coverage(_day_counts(t, t.finds()), t.users())


def q_calendar_teams(spark, sf):
    t = SampleTables(spark, sf)
    return cov.calendar_coverage(_day_counts(t, t.team_finds()))


def q_calendar_filtered(spark, sf):
    t = SampleTables(spark, sf)
    counts = _day_counts(t, t.finds(), type_keys=_type(t, "ECONOMY"), size_keys=_size(t, "micro"))
    return cov.calendar_coverage(counts, t.users())


def q_calendar_unknown_filter(spark, sf):
    t = SampleTables(spark, sf)
    return cov.calendar_coverage(_day_counts(t, t.finds(), type_keys=_type(t, "no such type")), t.users())


def q_calendar_months(spark, sf):
    t = SampleTables(spark, sf)
    return cov.calendar_months(_day_counts(t, t.finds()), t.users())


def q_calendar_day_counts(spark, sf):
    t = SampleTables(spark, sf)
    return _day_counts(t, t.finds())


def q_matrix(spark, sf):
    t = SampleTables(spark, sf)
    return cov.matrix_coverage(_cell_counts(t, t.finds()), t.users())


def q_matrix_teams(spark, sf):
    t = SampleTables(spark, sf)
    return cov.matrix_coverage(_cell_counts(t, t.team_finds()))


def q_matrix_filtered(spark, sf):
    t = SampleTables(spark, sf)
    return cov.matrix_coverage(_cell_counts(t, t.finds(), size_keys=_size(t, "R")), t.users())


def q_matrix_missing(spark, sf):
    t = SampleTables(spark, sf)
    return cov.matrix_missing_by_difficulty(_cell_counts(t, t.finds()), t.users())


def q_matrix_grid(spark, sf):
    t = SampleTables(spark, sf)
    return cov.matrix_grid(_cell_counts(t, t.finds()), t.users())


def q_user_stats(spark, sf):
    t = SampleTables(spark, sf)
    return stats.user_stats(t.users(), t.finds(), t.enrolments())


def q_user_type_stats(spark, sf):
    t = SampleTables(spark, sf)
    return stats.user_type_stats(t.finds(), t.items(), t.item_types())


def q_user_derived(spark, sf):
    return stats.derived_stats(q_user_stats(spark, sf), FIXED_AS_OF)


def _calendar_sql(day_counts: str, users: str) -> str:
    return f"""SELECT u.user_id,
 count(*) FILTER (WHERE n > 0 AND day <> '02-29') AS completed_365,
 count(*) FILTER (WHERE n > 0 AND day <> '02-29') / 365 AS rate_365,
 count(*) FILTER (WHERE n > 0) AS completed_366, count(*) FILTER (WHERE n > 0) / 366 AS rate_366,
 count(*) FILTER (WHERE n IS NULL) AS missing_count,
 coalesce(string_agg(day, ',' ORDER BY day) FILTER (WHERE n IS NULL), '') AS missing_days,
 CASE WHEN count(*) FILTER (WHERE n > 0 AND day <> '02-29') = 365 THEN min(n) ELSE 0 END AS tours
 FROM ({users}) u CROSS JOIN days LEFT JOIN ({day_counts}) c USING (user_id, day) GROUP BY u.user_id"""


def _day_sql(finds: str, where: str = "true") -> str:
    return f"""SELECT user_id, strftime(found_date, '%m-%d') AS day, count(*) AS n
 FROM {finds} JOIN items USING (item_id) WHERE {where} GROUP BY ALL"""


def _matrix_sql(finds: str, users: str, where: str = "true") -> str:
    return f"""SELECT user_id, completed, completed / 81 AS rate, missing_cells,
 CASE WHEN completed = 81 THEN fewest ELSE 0 END AS tours,
 CASE WHEN completed = 81 THEN above ELSE completed END AS next_round_completed,
 CASE WHEN completed = 81 THEN above ELSE completed END / 81 AS next_round_rate FROM (
 SELECT user_id, count(n) AS completed, min(n) AS fewest, count(*) FILTER (WHERE n > m) AS above,
  coalesce(string_agg(format('{{:.1f}}/{{:.1f}}', difficulty, terrain), ',' ORDER BY difficulty, terrain) FILTER (WHERE n IS NULL), '') AS missing_cells
 FROM (SELECT u.user_id, difficulty, terrain, n, min(n) OVER (PARTITION BY u.user_id) AS m
  FROM ({users}) u CROSS JOIN cells LEFT JOIN (
   SELECT user_id, round_even(difficulty*2,0)/2 AS difficulty, round_even(terrain*2,0)/2 AS terrain, count(*) AS n
   FROM {finds} JOIN items USING (item_id) WHERE {where} GROUP BY ALL) c USING (user_id, difficulty, terrain))
 GROUP BY user_id)"""


ALL_USERS = "SELECT user_id FROM users"
SQL_STATS = """SELECT user_id, username, created_at, coalesce(total_finds,0) AS total_finds,
 coalesce(total_challenges,0) AS total_challenges, coalesce(active_challenges,0) AS active_challenges,
 coalesce(completed_challenges,0) AS completed_challenges, first_find, last_find,
 greatest(last_find, last_enrolment) AS last_activity
 FROM users LEFT JOIN (SELECT user_id, count(*) AS total_finds, min(found_date) AS first_find, max(found_date) AS last_find FROM finds GROUP BY user_id) USING (user_id)
 LEFT JOIN (SELECT user_id, count(*) AS total_challenges, count(*) FILTER (WHERE status='accepted') AS active_challenges,
  count(*) FILTER (WHERE status='completed' OR computed_status='completed') AS completed_challenges, max(created_at) AS last_enrolment
  FROM enrolments GROUP BY user_id) USING (user_id)"""

_base = {"days": DAYS}
CHECKS = {
    "calendar_coverage": (
        q_calendar,
        with_tables("items", "finds", "users", extra=_base) + _calendar_sql(_day_sql("finds"), ALL_USERS),
    ),
    "calendar_coverage_teams": (
        q_calendar_teams,
        with_tables("items", "team_finds", extra=_base)
        + _calendar_sql(_day_sql("team_finds"), "SELECT DISTINCT user_id FROM team_finds"),
    ),
    "calendar_coverage_filtered": (
        q_calendar_filtered,
        with_tables("items", "finds", "users", extra=_base)
        + _calendar_sql(_day_sql("finds", "type_code = 'economy' AND size_code = 'M'"), ALL_USERS),
    ),
    "calendar_coverage_unknown_filter": (
        q_calendar_unknown_filter,
        with_tables("items", "finds", "users", extra=_base) + _calendar_sql(_day_sql("finds", "false"), ALL_USERS),
    ),
    "calendar_day_counts": (
        q_calendar_day_counts,
        with_tables("items", "finds") + "SELECT user_id, day, n AS finds FROM (" + _day_sql("finds") + ")",
    ),
    "calendar_months": (
        q_calendar_months,
        with_tables("items", "finds", "users", extra=_base)
        + f"""SELECT user_id, CAST(substr(day,1,2) AS INT) AS month, count(n) AS completed, count(*) - count(n) AS missing,
 count(n) / count(*) * 100 AS rate FROM users CROSS JOIN days LEFT JOIN ({_day_sql('finds')}) USING (user_id, day) GROUP BY ALL""",
    ),
    "matrix_coverage": (
        q_matrix,
        with_tables("items", "finds", "users", extra={"cells": CELLS}) + _matrix_sql("finds", ALL_USERS),
    ),
    "matrix_coverage_teams": (
        q_matrix_teams,
        with_tables("items", "team_finds", extra={"cells": CELLS})
        + _matrix_sql("team_finds", "SELECT DISTINCT user_id FROM team_finds"),
    ),
    "matrix_coverage_filtered": (
        q_matrix_filtered,
        with_tables("items", "finds", "users", extra={"cells": CELLS})
        + _matrix_sql("finds", ALL_USERS, "size_code = 'R'"),
    ),
    "matrix_missing_by_difficulty": (
        q_matrix_missing,
        with_tables("items", "finds", "users", extra={"cells": CELLS})
        + """SELECT user_id, CAST(difficulty AS DOUBLE) AS difficulty,
 string_agg(format('{:.1f}', terrain), ',' ORDER BY terrain) AS missing_terrains
 FROM users CROSS JOIN cells ANTI JOIN (SELECT DISTINCT user_id, difficulty, terrain FROM finds JOIN items USING (item_id)) USING (user_id, difficulty, terrain)
 GROUP BY user_id, difficulty""",
    ),
    "matrix_grid": (
        q_matrix_grid,
        with_tables("items", "finds", "users", extra={"cells": CELLS})
        + """SELECT user_id, CAST(difficulty AS DOUBLE) AS difficulty, CAST(terrain AS DOUBLE) AS terrain,
 coalesce(n, 0) AS finds, coalesce(n, 0) > 0 AS is_completed
 FROM users CROSS JOIN cells LEFT JOIN (SELECT user_id, difficulty, terrain, count(*) AS n FROM finds JOIN items USING (item_id) GROUP BY ALL) USING (user_id, difficulty, terrain)""",
    ),
    "user_stats": (q_user_stats, with_tables("users", "finds", "enrolments") + SQL_STATS),
    "user_type_stats": (
        q_user_type_stats,
        with_tables("items", "finds", "item_types")
        + """SELECT user_id, type_code, coalesce(n,0) AS finds,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(n,0) DESC, type_code) AS INT) AS position
 FROM (SELECT DISTINCT user_id FROM finds JOIN items USING (item_id)) CROSS JOIN item_types
 LEFT JOIN (SELECT user_id, type_code, count(*) AS n FROM finds JOIN items USING (item_id) GROUP BY ALL) USING (user_id, type_code)""",
    ),
    "user_derived_stats": (
        q_user_derived,
        with_tables("users", "finds", "enrolments")
        + f"""SELECT user_id,
 CASE WHEN total_challenges=0 THEN 0 ELSE CAST(floor(completed_challenges/total_challenges*100 + 0.5) AS BIGINT) END AS completion_percent,
 abs(date_diff('day', last_find, DATE '{FIXED_AS_OF}')) AS days_since_last_find,
 CASE WHEN active_challenges=0 THEN 0 ELSE CAST(floor(total_finds/active_challenges + 0.5) AS BIGINT) END AS finds_per_active_challenge
 FROM ({SQL_STATS})""",
    ),
}
