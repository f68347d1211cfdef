"""Zone queries with their SQL (test zones are boxes, so SQL compares bounds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.operators import coverage, zones as z
from cairnwise.sources.sample_tables import SampleTables
from checks.tables import with_tables


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


def _points(t):
    return t.items().select("item_id", "lat", "lon")


def lookup_table(t):
    """Every second point outside the level-2 zones, some of them abroad."""
    return t.items().where("item_id % 2 = 0").selectExpr(
        "round(lat, 3) AS lat_key", "round(lon, 3) AS lon_key",
        "CASE WHEN item_id % 3 > 0 THEN concat('Z2-', item_id % 25) END AS level2",
        "CASE WHEN item_id % 8 = 0 THEN 'YY' ELSE 'XX' END AS country",
    ).groupBy("lat_key", "lon_key").agg(F.min("level2").alias("level2"), F.min("country").alias("country"))


def exact(t):
    return z.assign_exact(_points(t), t.zones())


def nearest(t):
    return z.assign_nearest(_points(t), t.zones())


def assign(t):
    return z.assign_zones(_points(t), t.zones(), lookup_table(t))


def crowded(t):
    """The zones of every single visit: popular places repeat their point for each of their finds."""
    visits = t.finds().join(t.items().select("item_id", "lat", "lon"), "item_id").select(
        F.concat_ws(":", "user_id", "item_id").alias("item_id"), "lat", "lon"
    )
    return z.containing_zones(visits, t.zones(), z.cell_tree(visits, limit=500))


def parents(t):
    """Service boxes of suppliers and nations, each in its region's strip."""
    return z.zone_parents(supplier_zones(t))


def supplier_zones(t):
    """Level-2 boxes per supplier (some poking out of the outer box) plus the level-1 strips."""
    ring = "array(array({}))".format(
        ",".join(f"named_struct('x', {x}, 'y', {y})" for x, y in [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")])
    )
    boxes = t.raw("supplier").selectExpr(
        "concat('S-', s_suppkey) AS code", "2 AS level", "s_name AS name", "'XX' AS country", "CAST(NULL AS STRING) AS parent_code",
        "CAST((s_suppkey * 7919) % 11000 - 500 AS DOUBLE) / 1000 AS x0", "CAST((s_suppkey * 104729) % 11000 + 39500 AS DOUBLE) / 1000 AS y0",
    ).selectExpr("*", "x0 + 0.25 AS x1", "y0 + 0.25 AS y1")
    return boxes.selectExpr("code", "level", "name", "country", "parent_code", f"{ring} AS rings").unionByName(
        t.zones().where("level = 1")
    )


def _zoned(t, columns):
    items = t.items().withColumn("item_code", F.col("code"))
    return z.zoned_finds(t.finds(), items, z.containing_zones(_points(t), t.zones()), columns)


def counts_level1(t):
    keys = coverage.resolve_label(t.item_types(), "type_code", "economy")
    return z.zone_counts(_zoned(t, ["type_code"]), t.zones(), 1, "XX", keys)


def counts_level2(t):
    return z.zone_counts(_zoned(t, ["type_code"]), t.zones(), 2, "XX")


def detail(t):
    rows = z.zone_detail(_zoned(t, ["item_code", "title", "type_code", "difficulty", "terrain"]), t.zones())
    return rows.select("user_id", "code", "zone_name", "finds", "position", "item_code", "title", "type_code", "difficulty", "terrain")


def type_stats(t):
    return z.zone_type_stats(_zoned(t, ["type_code"]), t.zones(), t.item_types())


IN = "lon > x0 AND lon < x1 AND lat > y0 AND lat < y1"
GAP = "sqrt(pow(greatest(x0 - lon, 0, lon - x1), 2) + pow(greatest(y0 - lat, 0, lat - y1), 2))"
EXACT = {
    "hits": f"SELECT item_id, lat, lon, level, min(code) AS code FROM items JOIN zones ON {IN.replace('lon >', 'items.lon >')} GROUP BY ALL"
    .replace("items.lon", "lon"),
    "exact": "SELECT item_id, max(code) FILTER (WHERE level=1) AS level1, max(code) FILTER (WHERE level=2) AS level2 FROM hits GROUP BY item_id",
}
NEAR = {
    **EXACT,
    "gaps": f"SELECT item_id, level, zones.code, {GAP} AS d FROM items, zones WHERE {GAP} <= 0.1",
    "near": """SELECT item_id, min(code) FILTER (WHERE level=1) AS n1, min(code) FILTER (WHERE level=2) AS n2 FROM (
 SELECT item_id, level, min(code) AS code FROM gaps g WHERE d = (SELECT min(d) FROM gaps h WHERE h.item_id = g.item_id AND h.level = g.level) GROUP BY ALL) GROUP BY item_id""",
}
_hits = f"SELECT item_id, zones.level, min(zones.code) AS code FROM items JOIN zones ON {IN} GROUP BY ALL"
EXACT["hits"] = NEAR["hits"] = _hits
BASE = with_tables("items", "zones", extra=EXACT)
ZONED = {
    **EXACT,
    "zoned": "SELECT user_id, item_id, i.code AS item_code, title, type_code, difficulty, terrain, level1, level2 FROM finds JOIN items i USING (item_id) JOIN exact USING (item_id)",
    "zoned_long": "SELECT z.*, level1 AS zcode FROM zoned z WHERE level1 IS NOT NULL UNION ALL SELECT z.*, level2 FROM zoned z WHERE level2 IS NOT NULL",
}
WITH_ZONED = with_tables("items", "zones", "finds", "item_types", extra=ZONED)

CHECKS = {
    "assign_zones_exact": (_q(exact), BASE + "SELECT item_id, level1, level2 FROM items LEFT JOIN exact USING (item_id)"),
    "assign_zones_nearest": (
        _q(nearest),
        with_tables("items", "zones", extra=NEAR)
        + """SELECT item_id, coalesce(level1, n1) AS level1, coalesce(level2, n2) AS level2
 FROM items LEFT JOIN exact USING (item_id) LEFT JOIN near USING (item_id)""",
    ),
    "assign_zones": (
        _q(assign),
        with_tables("items", "zones", extra={
            **NEAR,
            "lk": """SELECT lat_key, lon_key, min(level2) AS l2, min(country) AS country FROM (
 SELECT round(lat,3) AS lat_key, round(lon,3) AS lon_key, CASE WHEN item_id % 3 > 0 THEN concat('Z2-', item_id % 25) END AS level2,
 CASE WHEN item_id % 8 = 0 THEN 'YY' ELSE 'XX' END AS country FROM items WHERE item_id % 2 = 0) GROUP BY ALL""",
            "j": """SELECT i.item_id, level1, level2, l2, p.parent_code AS l1, coalesce(lk.country <> 'XX', false) AS abroad, n1, n2,
 CASE WHEN level1 IS NOT NULL AND level2 IS NOT NULL THEN 'exact' WHEN l2 IS NOT NULL THEN 'lookup' WHEN coalesce(lk.country <> 'XX', false) THEN 'foreign' ELSE 'nearest' END AS via
 FROM items i LEFT JOIN exact USING (item_id) LEFT JOIN lk ON lat_key = round(lat,3) AND lon_key = round(lon,3)
 LEFT JOIN zones p ON p.code = l2 AND p.level = 2 LEFT JOIN near USING (item_id)""",
        })
        + """SELECT item_id, CASE via WHEN 'exact' THEN level1 WHEN 'lookup' THEN l1 WHEN 'nearest' THEN coalesce(level1, n1) END AS level1,
 CASE via WHEN 'exact' THEN level2 WHEN 'lookup' THEN l2 WHEN 'nearest' THEN coalesce(level2, n2) END AS level2, via FROM j""",
    ),
    "assign_zones_crowded": (
        _q(crowded),
        with_tables("items", "zones", "finds", extra=EXACT)
        + "SELECT concat(user_id, ':', item_id) AS item_id, level1, level2 FROM finds JOIN exact USING (item_id)",
    ),
    "zone_parents": (
        _q(parents),
        with_tables("zones", extra={
            "s": "SELECT concat('S-', s_suppkey) AS scode, CAST((s_suppkey * 7919) % 11000 - 500 AS DOUBLE) / 1000 AS sx, CAST((s_suppkey * 104729) % 11000 + 39500 AS DOUBLE) / 1000 AS sy FROM supplier",
            "c": "SELECT scode, (sx + (sx + 0.25)) / 2 AS lon, (sy + (sy + 0.25)) / 2 AS lat FROM s",
            "r": f"SELECT scode, code, NOT ({IN}) AS outside, {GAP} AS d FROM c, zones WHERE level = 1",
        })
        + "SELECT scode AS code, code AS parent_code FROM r QUALIFY row_number() OVER (PARTITION BY scode ORDER BY outside, round(d, 9), code) = 1",
    ),
    "zone_counts": (
        _q(counts_level2),
        WITH_ZONED + "SELECT user_id, z.level2 AS code, name, count(*) AS finds FROM zoned z JOIN zones ON zones.code = level2 AND level = 2 GROUP BY ALL",
    ),
    "zone_counts_by_type": (
        _q(counts_level1),
        WITH_ZONED + "SELECT user_id, z.level1 AS code, name, count(*) AS finds FROM zoned z JOIN zones ON zones.code = level1 AND level = 1 WHERE type_code = 'economy' GROUP BY ALL",
    ),
    "zone_detail": (
        _q(detail),
        WITH_ZONED
        + """SELECT user_id, zcode AS code, name AS zone_name, count(*) OVER (PARTITION BY user_id, zcode) AS finds,
 CAST(row_number() OVER (PARTITION BY user_id, zcode ORDER BY item_code) AS INT) AS position, item_code, title, type_code, difficulty, terrain
 FROM zoned_long JOIN zones ON zones.code = zcode QUALIFY position <= 10""",
    ),
    "zone_type_stats": (
        _q(type_stats),
        WITH_ZONED
        + """SELECT p.user_id, p.code, p.zone_name, t.type_code, t.name AS type_name, count(z.item_id) AS finds, CAST(t.sort_order + 1 AS INT) AS position
 FROM (SELECT DISTINCT user_id, zcode AS code, name AS zone_name FROM zoned_long JOIN zones ON zones.code = zcode) p CROSS JOIN item_types t
 LEFT JOIN zoned_long z ON z.user_id = p.user_id AND z.zcode = p.code AND z.type_code = t.type_code GROUP BY ALL""",
    ),
}
