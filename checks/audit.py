"""Audit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.operators import audit as a
from cairnwise.operators import referentials as ref
from cairnwise.session import scratch_path
from cairnwise.sources.sample_tables import SampleTables
from checks.progress import StoredEnrolments
from checks.tables import with_tables


def _q(fn, tables=SampleTables):
    return lambda spark, sf: fn(tables(spark, sf))


# Every table with an id; parents lack the rows whose key divides by 101 (and some dimension rows).
FULL = {
    "countries": "SELECT country_id AS id FROM countries WHERE country_id % 101 <> 0",
    "types": "SELECT type_code AS id FROM item_types WHERE type_code <> 'promo'",
    "sizes": "SELECT size_code AS id FROM item_sizes WHERE size_code <> 'O'",
    "attributes": "SELECT DISTINCT attr_id AS id FROM item_attributes WHERE attr_id <> 5",
    "users": "SELECT user_id AS id FROM users WHERE user_id % 101 <> 0",
    "states": "SELECT state_id AS id, country_id FROM states WHERE state_id % 10 <> 7",
    "items": "SELECT item_id AS id, country_id, state_id, type_code AS type_id, size_code AS size_id FROM items WHERE item_id % 101 <> 0",
    "challenges": "SELECT challenge_id AS id, item_id FROM challenges",
    "enrolments": "SELECT uc_id AS id, user_id, challenge_id FROM enrolments WHERE seed % 101 <> 0",
    "finds": "SELECT user_id * 1000000000 + item_id AS id, user_id, item_id FROM finds",
    "tasks": "SELECT task_id AS id, uc_id FROM tasks WHERE task_id % 103 <> 0",
    "snapshots": "SELECT uc_id * 10 + CAST(percent AS BIGINT) AS id, uc_id FROM snapshots",
    "targets": "SELECT task_id AS id, user_id, uc_id, task_id % 977 AS item_id, CASE WHEN task_id % 3 > 0 THEN task_id END AS primary_task_id FROM tasks",
}
_SOURCES = {
    "countries": "countries", "types": "item_types", "sizes": "item_sizes", "attributes": "item_attributes", "users": "users", "states": "states", "items": "items",
    "challenges": "challenges", "enrolments": "enrolments", "finds": "finds", "tasks": "tasks", "snapshots": "snapshots", "targets": "tasks",
}


def _tables(t):
    out = {}
    for name, sql in FULL.items():
        source = _SOURCES[name]
        df = getattr(t, source)()
        view = f"cairnwise_audit_{source}"
        df.createOrReplaceTempView(view)
        if name == "items":
            sql = sql.replace("AS size_id", "AS size_id, attributes")
        out[name] = t.spark.sql(sql.replace(f"FROM {source}", f"FROM {view}"))
    return out


def orphan_report(t):
    return a.orphans(_tables(t))


def orphan_report_counts(t):
    return a.orphan_counts(orphan_report(t))


def orphan_cleanup(t):
    """Rows left and rows backed up per table."""
    tables = _tables(t)
    backup = scratch_path(t.spark, "orphans")
    cleaned = a.clean(tables, a.orphans(tables), backup)
    out = None
    for name, df in cleaned.items():
        saved = t.spark.read.schema(df.schema).parquet(f"{backup}/{name}").groupBy().agg(F.count(F.lit(1))).scalar()
        row = df.groupBy().agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("table"), "kept").withColumn("removed", saved)
        out = row if out is None else out.unionByName(row)
    return out


def _al_items(t):
    return t.items().withColumn("code", F.expr("CASE WHEN item_id % 3 = 1 THEN concat('AL', item_id) ELSE code END"))


def geo_anomalies(t):
    return a.geo_anomalies(_al_items(t))


def geo_anomaly_sample(t):
    return a.geo_anomaly_sample(_al_items(t))


def table_snapshot_counts(t):
    return a.user_counts(t.users(), t.finds(), t.enrolments(), t.items(), t.challenges())


def _named(t):
    return t.raw("supplier").selectExpr(
        "s_suppkey AS id", "s_suppkey % 2 AS scope",
        "CASE s_suppkey % 3 WHEN 0 THEN concat('Île ', s_suppkey % 50) WHEN 1 THEN concat('ILE-', s_suppkey % 50) ELSE concat('zone ', s_suppkey) END AS name",
    )


def dimension_duplicates(t):
    return ref.duplicates(_named(t), "id", "name")


def dimension_duplicates_scoped(t):
    return ref.duplicates(_named(t), "id", "name", "scope")


NAMED = """SELECT s_suppkey AS id, s_suppkey % 2 AS scope, CASE s_suppkey % 3 WHEN 0 THEN concat('Île ', s_suppkey % 50) WHEN 1 THEN concat('ILE-', s_suppkey % 50) ELSE concat('zone ', s_suppkey) END AS name FROM supplier"""
NORM = "regexp_replace(lower(strip_accents(name)), '[^a-z0-9]', '', 'g')"
_F = {f"x_{k}": v for k, v in FULL.items()}
ORPHANS = {
    **_F,
    "o_states": "SELECT id FROM x_states WHERE country_id IS NOT NULL AND country_id NOT IN (SELECT id FROM x_countries)",
    "v_states": "SELECT id FROM x_states WHERE id NOT IN (SELECT id FROM o_states)",
    "o_items": """SELECT id, 'country_id' AS col FROM x_items WHERE country_id NOT IN (SELECT id FROM x_countries) UNION ALL SELECT id, 'state_id' FROM x_items WHERE state_id NOT IN (SELECT id FROM v_states)
 UNION ALL SELECT id, 'type_id' FROM x_items WHERE type_id NOT IN (SELECT id FROM x_types) UNION ALL SELECT id, 'size_id' FROM x_items WHERE size_id NOT IN (SELECT id FROM x_sizes)
 UNION ALL SELECT DISTINCT x.id, 'attributes.attr_id' FROM x_items x JOIN item_attributes a ON a.item_id = x.id WHERE attr_id NOT IN (SELECT id FROM x_attributes)""",
    "v_items": "SELECT id FROM x_items WHERE id NOT IN (SELECT id FROM o_items)",
    "o_challenges": "SELECT id, 'item_id' AS col FROM x_challenges WHERE item_id NOT IN (SELECT id FROM v_items)",
    "v_challenges": "SELECT id FROM x_challenges WHERE id NOT IN (SELECT id FROM o_challenges)",
    "o_enrolments": "SELECT id, 'user_id' AS col FROM x_enrolments WHERE user_id NOT IN (SELECT id FROM x_users) UNION ALL SELECT id, 'challenge_id' FROM x_enrolments WHERE challenge_id NOT IN (SELECT id FROM v_challenges)",
    "v_enrolments": "SELECT id FROM x_enrolments WHERE id NOT IN (SELECT id FROM o_enrolments)",
    "o_finds": "SELECT id, 'user_id' AS col FROM x_finds WHERE user_id NOT IN (SELECT id FROM x_users) UNION ALL SELECT id, 'item_id' FROM x_finds WHERE item_id NOT IN (SELECT id FROM v_items)",
    "o_tasks": "SELECT id, 'uc_id' AS col FROM x_tasks WHERE uc_id NOT IN (SELECT id FROM v_enrolments)",
    "v_tasks": "SELECT id FROM x_tasks WHERE id NOT IN (SELECT id FROM o_tasks)",
    "o_snapshots": "SELECT id, 'uc_id' AS col FROM x_snapshots WHERE uc_id NOT IN (SELECT id FROM v_enrolments)",
    "o_targets": """SELECT id, 'user_id' AS col FROM x_targets WHERE user_id NOT IN (SELECT id FROM x_users) UNION ALL SELECT id, 'uc_id' FROM x_targets WHERE uc_id NOT IN (SELECT id FROM v_enrolments)
 UNION ALL SELECT id, 'item_id' FROM x_targets WHERE item_id NOT IN (SELECT id FROM v_items) UNION ALL SELECT id, 'primary_task_id' FROM x_targets WHERE primary_task_id NOT IN (SELECT id FROM v_tasks)""",
    "report": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", {col} AS \"column\", CAST(id AS VARCHAR) AS id FROM o_{name}"
        for name, col in [("states", "'country_id'")] + [(n, "col") for n in ("items", "challenges", "enrolments", "finds", "tasks", "snapshots", "targets")]
    ),
}
WITH_ORPHANS = with_tables(
    "countries", "item_types", "item_sizes", "item_attributes", "users", "states", "items", "challenges", "enrolments", "finds", "tasks", "snapshots", extra=ORPHANS
)
AL = "SELECT * REPLACE (CASE WHEN item_id % 3 = 1 THEN concat('AL', item_id) ELSE code END AS code) FROM items"

CHECKS = {
    "orphan_report": (_q(orphan_report, StoredEnrolments), WITH_ORPHANS + "SELECT * FROM report"),
    "orphan_report_counts": (_q(orphan_report_counts, StoredEnrolments), WITH_ORPHANS + 'SELECT "table", "column", count(*) AS orphans FROM report GROUP BY ALL'),
    "orphan_cleanup": (
        _q(orphan_cleanup, StoredEnrolments),
        WITH_ORPHANS
        + " UNION ALL ".join(
            f"SELECT '{n}' AS \"table\", count(*) FILTER (WHERE CAST(id AS VARCHAR) NOT IN (SELECT id FROM report r WHERE r.\"table\" = '{n}')) AS kept,"
            f" count(*) FILTER (WHERE CAST(id AS VARCHAR) IN (SELECT id FROM report r WHERE r.\"table\" = '{n}')) AS removed FROM x_{n}"
            for n in FULL
        ),
    ),
    "geo_anomalies": (
        _q(geo_anomalies),
        with_tables("items", extra={"al": AL})
        + """SELECT count(*) AS total, count(*) FILTER (WHERE country_id IS NULL) AS null_country, count(*) FILTER (WHERE state_id IS NULL) AS null_state, count(*) FILTER (WHERE country_id IS NULL AND state_id IS NULL) AS null_both,
 count(*) FILTER (WHERE country_id IS NULL AND state_id IS NOT NULL) AS null_country_only, count(*) FILTER (WHERE country_id IS NOT NULL AND state_id IS NULL) AS null_state_only,
 count(*) FILTER (WHERE country_id IS NULL AND lat IS NOT NULL) AS null_country_with_coords, count(*) FILTER (WHERE country_id IS NULL AND code LIKE 'AL%') AS null_country_al,
 count(*) FILTER (WHERE country_id IS NULL AND code NOT LIKE 'AL%') AS null_country_not_al, count(*) FILTER (WHERE country_id IS NULL AND code NOT LIKE 'AL%') = 0 AS hypothesis_confirmed FROM al""",
    ),
    "geo_anomalies_sample": (
        _q(geo_anomaly_sample),
        with_tables("items", extra={"al": AL}) + "SELECT code, title, lat, lon FROM al WHERE country_id IS NULL AND code NOT LIKE 'AL%' ORDER BY code LIMIT 20",
    ),
    "table_snapshot_counts": (
        _q(table_snapshot_counts),
        with_tables("users", "finds", "enrolments", "items", "challenges")
        + """SELECT u.user_id, coalesce(f.n, 0) AS finds, coalesce(e.n, 0) AS enrolments, coalesce(e.c, 0) AS completed, coalesce(e.x, 0) AS not_computed,
 (SELECT count(*) FROM users) AS all_users, (SELECT count(*) FROM items) AS all_items, (SELECT count(*) FROM challenges) AS all_challenges
 FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM finds GROUP BY user_id) f USING (user_id)
 LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE computed_status = 'completed') AS c, count(*) FILTER (WHERE computed_status IS NULL) AS x FROM enrolments GROUP BY user_id) e USING (user_id)""",
    ),
    "dimension_duplicates": (
        _q(dimension_duplicates),
        f"WITH named AS ({NAMED}) SELECT {NORM} AS normalized, count(*) AS entries, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM named GROUP BY 1 HAVING count(*) > 1",
    ),
    "dimension_duplicates_scoped": (
        _q(dimension_duplicates_scoped),
        f"WITH named AS ({NAMED}) SELECT {NORM} AS normalized, scope, count(*) AS entries, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM named GROUP BY 1, 2 HAVING count(*) > 1",
    ),
}
