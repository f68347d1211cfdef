"""Source and import queries. Their input files are written by Spark from the
given tables into the shared folder, so they grow with those tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.operators import audit
from cairnwise.plans import importing
from cairnwise.session import scratch_path
from cairnwise.sources import documents, snapshots, waypoints
from cairnwise.sources.versions import Versions
from cairnwise.sources.sample_tables import FIXED_AS_OF, SampleTables
from checks import ingest as ing
from checks.tables import with_tables
from checks.zones import NEAR

PER_FILE = 500


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


# -- waypoint files --------------------------------------------------------------------

# Per file number modulo 5: which dialect it is written in and how that shows.
HEADS = [
    '<gpx version="1.0" creator="c:geo - http://www.cgeo.org/" xmlns="http://www.topografix.com/GPX/1/0" xmlns:groundspeak="http://www.groundspeak.com/cache/1/0/1" xmlns:gsak="http://www.gsak.net/xmlv1/6">',
    '<gpx version="1.0" creator="Groundspeak Pocket Query" xmlns="http://www.topografix.com/GPX/1/0" xmlns:groundspeak="http://www.groundspeak.com/cache/1/0">',
    '<gpx version="1.0" creator="other" xmlns="http://www.topografix.com/GPX/1/0" xmlns:groundspeak="http://www.groundspeak.com/cache/1/0/1" xmlns:gsak="http://www.gsak.net/xmlv1/6">',
    '<gpx version="1.0" creator="other" xmlns="http://www.topografix.com/GPX/1/0" xmlns:groundspeak="http://www.groundspeak.com/cache/1/0">',
    '<gpx version="1.0" creator="none" xmlns="http://www.topografix.com/GPX/1/0"><desc>made from a Pocket Query</desc>',
]
PQ_SQL = "file_id % 5 IN (1, 3, 4)"


def write_waypoints(t):
    """GPX documents of at most 500 waypoints each; every ninth waypoint is a
    plain one without an item element."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("file_id") % 5 + 1).cast("int"))
    text = """concat('<wpt lat="', lat, '" lon="', lon, '"><time>', placed_at, 'T08:00:00', IF(item_id % 2 = 0, 'Z', ''), '</time><name>', code, '</name><desc> ', title, ' </desc>',
 IF(item_id % 9 = 8, '', concat('<groundspeak:cache id="', item_id, '"><groundspeak:name>n</groundspeak:name><groundspeak:owner id="1">', owner, '</groundspeak:owner><groundspeak:type>',
 IF(item_id % 6 = 5, 'Event Cache', type_code), '</groundspeak:type><groundspeak:container>', size_code, '</groundspeak:container><groundspeak:attributes>',
 array_join(transform(attributes, a -> concat('<groundspeak:attribute id="', a.attr_id, '" inc="', IF(a.is_positive, 1, 0), '">Attr ', a.attr_id, '</groundspeak:attribute>')), ''),
 '</groundspeak:attributes><groundspeak:difficulty>', difficulty, '</groundspeak:difficulty><groundspeak:terrain>', terrain, '</groundspeak:terrain><groundspeak:country>NATION_', item_id % 25,
 '</groundspeak:country><groundspeak:state></groundspeak:state><groundspeak:long_description html="True">&lt;p&gt;', description, '&lt;/p&gt;</groundspeak:long_description><groundspeak:logs>',
 CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<groundspeak:log id="1"><groundspeak:date>2001-01-02T10:00:00</groundspeak:date><groundspeak:type>Write note</groundspeak:type></groundspeak:log>'
 WHEN 2 THEN '<groundspeak:log id="1"><groundspeak:date>2001-03-02T10:00:00Z</groundspeak:date><groundspeak:type>Found it</groundspeak:type></groundspeak:log><groundspeak:log id="2"><groundspeak:date>2001-04-02T10:00:00Z</groundspeak:date><groundspeak:type>Found it</groundspeak:type></groundspeak:log><groundspeak:log id="3"><groundspeak:date>2001-05-02T10:00:00Z</groundspeak:date><groundspeak:type>Write note</groundspeak:type></groundspeak:log>'
 ELSE '<groundspeak:log id="1"><groundspeak:date>2001-03-02T10:00:00Z</groundspeak:date><groundspeak:type>Write note</groundspeak:type></groundspeak:log><groundspeak:log id="2"><groundspeak:date>2001-04-02T10:00:00Z</groundspeak:date><groundspeak:type>Needs care</groundspeak:type></groundspeak:log>' END,
 '</groundspeak:logs></groundspeak:cache><gsak:wptExtension xmlns:gsak="http://www.gsak.net/xmlv1/6">', IF(item_id % 3 = 0, '<gsak:UserFound>2001-06-07T00:00:00Z</gsak:UserFound>', ''), '<gsak:FavPoints>', favorites, '</gsak:FavPoints><gsak:GcNote>note ', item_id, '</gsak:GcNote></gsak:wptExtension>')), '</wpt>')"""
    # An undeclared prefix would not be well-formed XML: the last head declares it here.
    wpts = t.items().selectExpr("CAST(item_id DIV 500 AS INT) AS file_id", "item_id", f"{text} AS w")
    docs = wpts.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "w"))).alias("ws"))
    body = F.array_join(F.transform("ws", lambda w: w["w"]), "\n")
    path = scratch_path(t.spark, "waypoints")
    docs.select("file_id", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), head, F.lit("\n"), body, F.lit("\n</gpx>")).alias("value")).write.partitionBy("file_id").text(path)
    return path


def _file_id(column):
    return F.regexp_extract(column, r"file_id=(\d+)", 1).cast("int")


def detect_dialect(t):
    rows = waypoints.read_dialects(t.spark, write_waypoints(t))
    return rows.select(_file_id(F.col("source_file")).alias("file_id"), "dialect")


def read_waypoints(t):
    rows = waypoints.read_waypoints(t.spark, write_waypoints(t))
    attrs = F.array_join(F.transform(F.sort_array("attributes"), lambda a: F.concat_ws(":", a["attr_id"].cast("string"), a["is_positive"].cast("string"), a["name"])), ",")
    return rows.select(
        "code", "title", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "type", "size", "owner", "difficulty", "terrain",
        "country", "state", "description", "placed_date", "favorites", "notes", attrs.alias("attributes"), "dialect",
    )


def derive_found_date(t):
    return waypoints.read_waypoints(t.spark, write_waypoints(t)).select("code", "dialect", "found_date")


# -- documents ---------------------------------------------------------------------------


def read_referential(t):
    """Supplier names as JSON array documents of a hundred entries."""
    entries = t.raw("supplier").selectExpr("s_suppkey DIV 100 AS doc", "struct(s_suppkey AS id, concat('S', s_suppkey) AS code, s_name AS name, array(lower(s_name), 'x') AS aliases) AS e")
    docs = entries.groupBy("doc").agg(F.to_json(F.sort_array(F.collect_list("e"))).alias("value"))
    path = scratch_path(t.spark, "referential")
    docs.write.partitionBy("doc").text(path)
    rows = documents.read_referential(t.spark, path, "id bigint, code string, name string, aliases array<string>")
    return rows.select("id", "code", "name", F.array_join("aliases", ",").alias("aliases"))


def read_zones(t):
    """Supplier boxes as FeatureCollections; some without a code, some as multi-polygons."""
    box = "array(array(x, y), array(x + 0.5D, y), array(x + 0.5D, y + 0.5D), array(x, y + 0.5D), array(x, y))"
    rows = t.raw("supplier").selectExpr("s_suppkey AS k", "s_suppkey DIV 100 AS doc", "CAST(s_suppkey % 300 AS DOUBLE) / 4 AS x", "CAST(s_suppkey % 77 AS DOUBLE) / 4 AS y")
    feature = f"""concat('{{"type":"Feature","properties":{{', IF(k % 10 = 3, '', concat('"code":"', k, '",')), '"nom":"Zone ', k, '"}},"geometry":{{"type":"', IF(k % 4 = 0, 'MultiPolygon', 'Polygon'), '","coordinates":',
 IF(k % 4 = 0, to_json(array(array({box}), array({box.replace('x', '(x + 2)')}))), to_json(array({box}))), '}}}}')"""
    docs = rows.selectExpr("doc", f"{feature} AS f").groupBy("doc").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("f")), ","), F.lit("]}")).alias("value"))
    path = scratch_path(t.spark, "zones")
    docs.write.partitionBy("doc").text(path)
    zones = documents.read_zones(t.spark, path, "XX", 2)
    return zones.select("code", "level", "name", "x0", "y0", "x1", "y1", F.size("rings").alias("nb_rings"))


# -- snapshots ---------------------------------------------------------------------------


def _tables(t):
    return {"items": t.items(), "users": t.users(), "finds": t.finds(), "enrolments": t.enrolments()}


def snapshot_tables(t):
    return snapshots.write_snapshot(_tables(t), scratch_path(t.spark, "backup"), "2002-01-01")


def list_snapshots(t):
    base = scratch_path(t.spark, "backup")
    snapshots.write_snapshot(_tables(t), base, "2002-01-01")
    snapshots.write_snapshot({"items": t.items(), "users": t.users()}, base, "2002-02-01")
    return snapshots.list_snapshots(t.spark, base)


def restore_dry_run(t):
    base = scratch_path(t.spark, "backup")
    snapshots.write_snapshot(_tables(t), base, "2002-01-01")
    return snapshots.restore_counts(t.spark, base, "2002-01-01")


def restore_snapshot(t):
    """A table that lost a third of its rows and gained others gets its rows back."""
    base = scratch_path(t.spark, "backup")
    snapshots.write_snapshot({"finds": t.finds()}, base, "2002-01-01")
    current = t.finds().where("item_id % 3 > 0").unionByName(t.finds().where("item_id % 7 = 0").withColumn("item_id", F.col("item_id") + 1000000))
    return snapshots.restore_table(current, base, "2002-01-01", "finds", ["user_id", "item_id"])


def restore_snapshot_drop(t):
    base = scratch_path(t.spark, "backup")
    snapshots.write_snapshot({"finds": t.finds()}, base, "2002-01-01")
    return snapshots.restore_table(t.finds().where("item_id % 3 > 0"), base, "2002-01-01", "finds", ["user_id", "item_id"], drop_existing=True)


# -- import --------------------------------------------------------------------------------


def _import(t, mode="both"):
    """Raw rows against a table that already holds two thirds of the items."""
    raw = ing.raw_items(t).selectExpr("*", "item_id % 50 AS user_id", "item_id AS ord", "concat('f', item_id % 20) AS source_file").drop("item_id")
    stored = t.items().where("item_id % 3 > 0").withColumn("url", F.lit(None).cast("string"))
    finds = t.items().where("item_id % 4 = 0").selectExpr("item_id % 50 AS user_id", "item_id", "DATE '2000-06-01' AS found_date", "'old' AS notes")
    dims = importing.Dimensions(t.item_types(), t.item_sizes(), t.countries(), t.states(), ing._attributes(t))
    return importing.import_rows(raw, stored, finds, dims, FIXED_AS_OF, mode)


def import_counters(t):
    return _import(t).counters


def import_items(t):
    items = _import(t).items
    return items.select("code", "title", "lat", "lon", "difficulty", "terrain", "owner", "type_code", "size_code", "country_id", "favorites", "status", "placed_at", "change")


def import_finds(t):
    result = _import(t)
    return result.finds.join(result.items.select("item_id", "code"), "item_id").select("user_id", "code", "found_date", F.md5("notes").alias("notes_md5"), "change")


def import_quarantine(t):
    return _import(t, "found").quarantine.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def _pipeline(t):
    """A whole import over stored tables, with zones, elevations and places, read back from its commit."""
    tables = Versions(t.spark, scratch_path(t.spark, "tables"))
    tables.commit({
        "items": t.items().where("item_id % 3 > 0").withColumn("url", F.lit(None).cast("string")),
        "finds": t.items().where("item_id % 4 = 0 AND item_id % 3 > 0").selectExpr("item_id % 50 AS user_id", "item_id", "DATE '2000-06-01' AS found_date", "'old' AS notes"),
        "countries": t.countries(), "states": t.states(), "users": t.users(),
    })
    raw = ing.raw_items(t).selectExpr("*", "item_id % 50 AS user_id", "item_id AS ord", "concat('f', item_id % 20) AS source_file").drop("item_id")
    places = t.items().where("country_id IS NULL").selectExpr(
        "round(lat, 3) AS lat_key", "round(lon, 3) AS lon_key", "concat('NATION_', item_id % 25) AS country",
        *[f"CAST(NULL AS STRING) AS {c}" for c in ("state", "region", "county")],
    )
    importing.import_job(
        tables, raw, t.item_types(), t.item_sizes(), ing._attributes(t), FIXED_AS_OF,
        zones=t.zones(), elevation=ing._elevation_lookup(t), places=places,
    )
    return tables


def import_pipeline(t):
    return _pipeline(t).read("items").select(
        "code", "title", "lat", "lon", "difficulty", "terrain", "type_code", "size_code", "country_id", "elevation", "favorites", "status",
        "placed_at", "zone_level1", "zone_level2",
    )


def import_pipeline_users(t):
    return _pipeline(t).read("users").select("user_id", "last_import_at")


def import_pipeline_tables(t):
    return _pipeline(t).listing().select("name", "docs", "folders", "version")


def import_statistics(t):
    return audit.import_statistics(t.users(), t.finds(), {"items": t.items(), "types": t.item_types(), "sizes": t.item_sizes(), "countries": t.countries(), "states": t.states()})


ATTRS = "(SELECT string_agg(concat(attr_id, ':', is_positive, ':Attr ', attr_id), ',' ORDER BY attr_id) FROM item_attributes a WHERE a.item_id = i.item_id)"
WPT = f"""SELECT i.*, CAST(item_id // {PER_FILE} AS INT) AS file_id, CASE WHEN item_id % 6 = 5 THEN 'Event Cache' ELSE type_code END AS wtype, concat(placed_at, 'T08:00:00', CASE WHEN item_id % 2 = 0 THEN 'Z' ELSE '' END) AS wtime FROM items i WHERE item_id % 9 <> 8"""
WITH_WPT = with_tables("items", "item_attributes", extra={"wpt": WPT})
DIALECT = f"CASE WHEN {PQ_SQL} THEN 'pocket_query' ELSE 'cgeo' END"
_valid = ing.validated_sql("record").replace("AS reject_reason", "AS bad")
GOOD = f"""SELECT r.*, v.title AS vtitle, v.lat AS vlat, v.lon AS vlon, v.difficulty AS vd, v.terrain AS vt, v.owner AS vowner, v.placed_at AS vplaced, v.favorites AS vfav, v.status AS vstatus,
 CASE WHEN r.code IS NULL THEN 'no code' WHEN v.bad IS NOT NULL THEN v.bad WHEN found_at > TIMESTAMP '{ing.AS_OF}' THEN 'found_in_future' WHEN found_at < v.placed_at THEN 'found_before_placed' END AS why
 FROM record r JOIN ({_valid}) v USING (item_id)"""
PLAIN = ing._PLAIN
IMPORT = {
    "raw": ing.RAW_SQL, "record": ing.RECORD, "good0": GOOD, "good": "SELECT * FROM good0 WHERE why IS NULL",
    "newc": ing.NEW_COUNTRIES.replace("FROM record", "FROM good"), "allc": "SELECT country_id, name FROM countries UNION ALL SELECT * FROM newc",
    "stored": "SELECT * FROM items WHERE item_id % 3 > 0",
    "mapped": f"""SELECT g.*, c.country_id AS cid, t.type_code AS tcode, z.size_code AS zcode FROM good g LEFT JOIN allc c ON {PLAIN.format('c.name')} = {PLAIN.format('g.country')}
 LEFT JOIN item_types t ON {PLAIN.format('t.name')} = {PLAIN.format('g.type')} LEFT JOIN item_sizes z ON {PLAIN.format('z.name')} = {PLAIN.format('g.size')}""",
    "batch": "SELECT code, arg_max(item_id, item_id) AS item_id FROM mapped GROUP BY code",
    "merged": """SELECT coalesce(s.code, m.code) AS code, coalesce(m.vtitle, s.title) AS title, coalesce(m.vlat, s.lat) AS lat, coalesce(m.vlon, s.lon) AS lon, coalesce(m.vd, s.difficulty) AS difficulty,
 coalesce(m.vt, s.terrain) AS terrain, coalesce(m.vowner, s.owner) AS owner, coalesce(m.tcode, s.type_code) AS type_code, coalesce(m.zcode, s.size_code) AS size_code, coalesce(m.cid, s.country_id) AS country_id,
 coalesce(m.vfav, s.favorites) AS favorites, coalesce(m.vstatus, s.status) AS status, coalesce(CAST(m.vplaced AS DATE), s.placed_at) AS placed_at,
 CASE WHEN s.code IS NULL THEN 'inserted' WHEN m.code IS NULL THEN 'kept' ELSE 'updated' END AS change FROM stored s FULL JOIN mapped m ON m.code = s.code""",
    "oldf": "SELECT item_id % 50 AS user_id, code FROM items WHERE item_id % 4 = 0 AND item_id % 3 > 0",
    "newf": "SELECT item_id % 50 AS user_id, code, CAST(found_at AS DATE) AS found_date, notes FROM good WHERE found_at IS NOT NULL",
    "mf": """SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.code, n.code) AS code, CASE WHEN o.code IS NOT NULL THEN DATE '2000-06-01' ELSE n.found_date END AS found_date,
 md5(CASE WHEN n.notes IS NOT NULL THEN substr(n.notes, 1, 4000) WHEN o.code IS NOT NULL THEN 'old' END) AS notes_md5, CASE WHEN o.code IS NULL THEN 'inserted' WHEN n.code IS NULL THEN 'kept' ELSE 'updated' END AS change
 FROM oldf o FULL JOIN newf n ON n.user_id = o.user_id AND n.code = o.code""",
    "news": f"""SELECT c.country_id, {PLAIN.format('r.state')} AS key FROM good r JOIN allc c ON {PLAIN.format('c.name')} = {PLAIN.format('r.country')} WHERE coalesce(r.state, '') <> '' GROUP BY 1, 2""",
}
# The same import with places, elevations and zones.
_K = "round(lat, 3) AS lat_key, round(lon, 3) AS lon_key"
PIPELINE = {
    **{k: v for k, v in IMPORT.items() if k in ("raw", "record", "good0")},
    "pl": f"SELECT {_K}, max(concat('NATION_', item_id % 25)) AS place FROM items WHERE country_id IS NULL GROUP BY ALL",
    "good1": "SELECT * FROM good0 WHERE why IS NULL",
    "good": "SELECT g.* EXCLUDE (country), coalesce(g.country, pl.place) AS country FROM good1 g LEFT JOIN pl ON lat_key = round(g.vlat, 3) AND lon_key = round(g.vlon, 3)",
    **{k: v for k, v in IMPORT.items() if k in ("newc", "allc", "stored")},
    "el": f"SELECT {_K}, max(lat * 10 + 0.5) AS metres FROM items WHERE item_id % 4 < 2 GROUP BY ALL",
    "mapped0": IMPORT["mapped"],
    "mapped": "SELECT m.*, CAST(round_even(metres, 0) AS INT) AS melev FROM mapped0 m LEFT JOIN el ON lat_key = round(vlat, 3) AND lon_key = round(vlon, 3)",
    "pts": "SELECT item_id, vlat AS lat, vlon AS lon FROM mapped WHERE vlat IS NOT NULL AND vlon IS NOT NULL",
    **{k: v.replace("FROM items", "FROM pts") for k, v in NEAR.items()},
    "placed": "SELECT item_id, coalesce(level1, n1) AS z1, coalesce(level2, n2) AS z2 FROM pts LEFT JOIN exact USING (item_id) LEFT JOIN near USING (item_id)",
    "merged": IMPORT["merged"].replace(" AS placed_at,", " AS placed_at, coalesce(m.melev, s.elevation) AS elevation, z1 AS zone_level1, z2 AS zone_level2,")
    + " LEFT JOIN placed ON placed.item_id = m.item_id",
    **{k: v for k, v in IMPORT.items() if k in ("oldf", "newf", "mf", "news")},
}
WITH_PIPELINE = with_tables("items", "item_types", "item_sizes", "countries", "states", "users", "zones", extra=PIPELINE)
WITH_IMPORT = with_tables("items", "item_types", "item_sizes", "countries", "states", extra=IMPORT)
BACKUP = with_tables("items", "users", "finds", "enrolments")
COUNTS = "SELECT 'items' AS \"table\", count(*) AS docs FROM items UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'finds', count(*) FROM finds UNION ALL SELECT 'enrolments', count(*) FROM enrolments"

CHECKS = {
    "detect_dialect": (_q(detect_dialect), with_tables("items") + f"SELECT file_id, {DIALECT} AS dialect FROM (SELECT DISTINCT CAST(item_id // {PER_FILE} AS INT) AS file_id FROM items)"),
    "read_waypoints_xml": (
        _q(read_waypoints),
        WITH_WPT
        + f"""SELECT code, title, lat AS latitude, lon AS longitude, wtype AS type, size_code AS size, owner, CAST(difficulty AS VARCHAR) AS difficulty, CAST(terrain AS VARCHAR) AS terrain,
 concat('NATION_', item_id % 25) AS country, CAST(NULL AS VARCHAR) AS state, concat('<p>', description, '</p>') AS description, wtime AS placed_date, CASE WHEN {PQ_SQL} THEN '0' ELSE CAST(favorites AS VARCHAR) END AS favorites,
 CASE WHEN NOT {PQ_SQL} THEN concat('note ', item_id) END AS notes, {ATTRS} AS attributes, {DIALECT} AS dialect FROM wpt i""",
    ),
    "derive_found_date": (
        _q(derive_found_date),
        WITH_WPT
        + f"""SELECT code, {DIALECT} AS dialect, CASE WHEN NOT {PQ_SQL} THEN CASE WHEN item_id % 3 = 0 THEN '2001-06-07T00:00:00Z' END
 WHEN item_id % 4 = 1 THEN '2001-01-02T10:00:00Z' WHEN item_id % 4 = 2 THEN '2001-04-02T10:00:00Z' WHEN item_id % 6 = 5 THEN concat(replace(wtime, 'Z', ''), 'Z') END AS found_date FROM wpt""",
    ),
    "read_referential_json": (_q(read_referential), "SELECT s_suppkey AS id, concat('S', s_suppkey) AS code, s_name AS name, concat(lower(s_name), ',x') AS aliases FROM supplier"),
    "read_geojson_zones": (
        _q(read_zones),
        """SELECT concat('XX-', k) AS code, 2 AS level, concat('Zone ', k) AS name, x AS x0, y AS y0, x + CASE WHEN k % 4 = 0 THEN 2.5 ELSE 0.5 END AS x1, y + 0.5 AS y1, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS INT) AS nb_rings
 FROM (SELECT s_suppkey AS k, CAST(s_suppkey % 300 AS DOUBLE) / 4 AS x, CAST(s_suppkey % 77 AS DOUBLE) / 4 AS y FROM supplier) WHERE k % 10 <> 3""",
    ),
    "snapshot_tables": (_q(snapshot_tables), BACKUP + f"SELECT '2002-01-01' AS snapshot, * FROM ({COUNTS})"),
    "list_snapshots": (
        _q(list_snapshots),
        BACKUP + f"""SELECT '2002-01-01' AS snapshot, count(*) AS tables, CAST(sum(docs) AS BIGINT) AS docs FROM ({COUNTS}) UNION ALL SELECT '2002-02-01', count(*), CAST(sum(docs) AS BIGINT) FROM ({COUNTS}) WHERE "table" IN ('items','users')""",
    ),
    "restore_dry_run": (_q(restore_dry_run), BACKUP + COUNTS),
    "restore_snapshot": (_q(restore_snapshot), with_tables("finds") + "SELECT * FROM finds UNION ALL SELECT user_id, item_id + 1000000, found_date FROM finds WHERE item_id % 7 = 0"),
    "restore_snapshot_drop": (_q(restore_snapshot_drop), with_tables("finds") + "SELECT * FROM finds"),
    "import_counters": (
        _q(import_counters),
        WITH_IMPORT
        + f"""SELECT (SELECT count(DISTINCT item_id % 20) FROM raw) AS nb_files, (SELECT count(*) FROM good) AS nb_total_items, (SELECT count(*) FROM good0 WHERE why IS NOT NULL) AS nb_discarded_items,
 (SELECT count(*) FROM merged WHERE change = 'inserted') AS nb_inserted_items, (SELECT count(*) FROM merged WHERE change = 'updated') AS nb_existing_items,
 (SELECT count(*) FROM mf WHERE change = 'inserted') AS nb_inserted_finds, (SELECT count(*) FROM mf WHERE change = 'updated') AS nb_updated_finds, (SELECT count(*) FROM newc) AS nb_new_countries,
 (SELECT count(*) FROM news x WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.country_id = x.country_id AND {PLAIN.format('s.name')} = x.key)) AS nb_new_states""",
    ),
    "import_items": (_q(import_items), WITH_IMPORT + "SELECT * FROM merged"),
    "import_finds": (_q(import_finds), WITH_IMPORT + "SELECT * FROM mf"),
    "import_pipeline": (
        _q(import_pipeline),
        WITH_PIPELINE + "SELECT code, title, lat, lon, difficulty, terrain, type_code, size_code, country_id, elevation, favorites, status, placed_at, zone_level1, zone_level2 FROM merged",
    ),
    "import_pipeline_users": (
        _q(import_pipeline_users),
        WITH_PIPELINE
        + f"""SELECT u.user_id, CASE WHEN unfound > 0 THEN DATE '{FIXED_AS_OF}' ELSE last_import_at END AS last_import_at FROM users u
 LEFT JOIN (SELECT item_id % 50 AS user_id, count(*) - count(found_at) AS unfound FROM good GROUP BY 1) USING (user_id)""",
    ),
    "import_pipeline_tables": (
        _q(import_pipeline_tables),
        WITH_PIPELINE
        + f"""SELECT name, docs, 1 AS folders, 2::BIGINT AS version FROM (SELECT 'items' AS name, count(*) AS docs FROM merged UNION ALL SELECT 'finds', count(*) FROM mf UNION ALL SELECT 'users', count(*) FROM users
 UNION ALL SELECT 'countries', count(*) FROM allc UNION ALL SELECT 'quarantine', count(*) FROM good0 WHERE why IS NOT NULL UNION ALL SELECT 'imports', 1
 UNION ALL SELECT 'states', (SELECT count(*) FROM states) + (SELECT count(*) FROM news x WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.country_id = x.country_id AND {PLAIN.format('s.name')} = x.key)))""",
    ),
    "import_quarantine": (
        _q(import_quarantine),
        WITH_IMPORT
        + f"""SELECT reject_reason, count(*) AS rows FROM (SELECT CASE WHEN r.code IS NULL THEN 'no code' WHEN found_at IS NULL THEN 'outside import mode' ELSE why END AS reject_reason FROM good0 r) WHERE reject_reason IS NOT NULL GROUP BY ALL""",
    ),
    "import_statistics": (
        _q(import_statistics),
        with_tables("items", "users", "finds", "item_types", "item_sizes", "countries", "states")
        + """SELECT 'table' AS scope, 'items' AS name, count(*) AS rows FROM items UNION ALL SELECT 'table', 'types', count(*) FROM item_types UNION ALL SELECT 'table', 'sizes', count(*) FROM item_sizes
 UNION ALL SELECT 'table', 'countries', count(*) FROM countries UNION ALL SELECT 'table', 'states', count(*) FROM states
 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(item_id) FROM users LEFT JOIN finds USING (user_id) GROUP BY user_id""",
    ),
}
