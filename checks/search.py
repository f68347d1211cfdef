"""Search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.functions import geo
from cairnwise.operators import search as s
from cairnwise.operators.search import ItemFilter
from cairnwise.sources.sample_tables import SampleTables
from checks.tables import with_tables

FLAT = ["item_id", "code", "title", "type_code", "size_code", "difficulty", "terrain", "lat", "lon"]
FLAT_SQL = ", ".join(FLAT)


def haversine_sql(lat1, lon1, lat2, lon2):
    return (
        f"2*6371.0*asin(sqrt(least(1.0, pow(sin(radians({lat2}-{lat1})/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))))"
    )


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


def filter_items(t):
    wanted = ItemFilter(
        type_code="economy", difficulty=(1.5, 4.0), terrain=(None, 4.5), placed_after="2003-01-01",
        placed_before="2017-12-31", attr_positive=[1, 2, 3], attr_negative=[7, 8, 9, 10, 11], box=(40.0, 0.0, 49.0, 9.5),
    )
    return s.filter_items(t.items(), wanted).select(*FLAT)


def filter_items_text(t):
    wanted = ItemFilter(text="red PROMO", country_id=3)
    return s.filter_items(t.items(), wanted).select(*FLAT)


def text_search(t):
    return s.filter_items(t.items(), ItemFilter(text="widget, Economy!")).select(*FLAT)


def within_bbox(t):
    wanted = ItemFilter(box=(41.25, 1.5, 46.75, 7.0), size_code="M")
    return s.filter_items(t.items(), wanted).select(*FLAT)


def within_radius(t):
    near = s.within_radius(t.items(), 45.0, 5.0, 100.0)
    return near.select("item_id", "code", F.round("distance_km", 3).alias("distance_km"))


def within_radius_page(t):
    near = s.within_radius(t.items(), 45.0, 5.0, 100.0)
    paged = s.page(near, [F.asc("distance_km"), F.asc("item_id")], number=1, size=20)
    return paged.select("item_id", F.round("distance_km", 3).alias("distance_km"), "total", "nb_pages")


def haversine(t):
    pairs = t.finds().join(t.items().select("item_id", "lat", "lon"), "item_id").join(
        t.users().select("user_id", "home_lat", "home_lon"), "user_id"
    )
    d = geo.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    return pairs.select("user_id", "item_id", F.round(d, 3).alias("distance_km"))


def _compact_flat(df):
    return df.select(
        "item_id", "code", "title", "difficulty", "terrain", "lat", "lon",
        F.col("type.label").alias("type_label"), F.col("type.code").alias("type_code"),
        F.col("size.label").alias("size_label"), F.col("size.code").alias("size_code"),
    )


def compact(t):
    return _compact_flat(s.compact(t.items(), t.item_types(), t.item_sizes()))


def lookup_by_code(t):
    keys = t.raw("lineitem").selectExpr("concat('GC', lpad(CAST(l_partkey * 2 AS STRING), 6, '0')) AS code")
    return _compact_flat(s.lookup(keys, t.items(), t.item_types(), t.item_sizes(), "code"))


def lookup_by_id(t):
    keys = t.raw("lineitem").selectExpr("l_partkey * 3 AS item_id")
    return _compact_flat(s.lookup(keys, t.items(), t.item_types(), t.item_sizes(), "item_id"))


def _sorted(sort):
    def run(t):
        return s.page(t.items(), s.sort_order(sort), number=1, size=200).select("item_id", "total", "nb_pages")

    return run


def paginate(t):
    rows = s.filter_items(t.items(), ItemFilter(size_code="M"))
    return s.page(rows, s.sort_order("-favorites"), number=2, size=37).select("item_id", "favorites", "total", "nb_pages")


def paginate_deep(t):
    """A page far down all visits, newest first."""
    keys = [("found_date", True), ("user_id", False), ("item_id", False)]
    rows = t.finds().select("user_id", "item_id", "found_date")
    return s.deep_page(rows, keys, number=60, size=50, sorted_rows=1000)


def sort_items_deep(t):
    """A late page of the items by favourites, within one size."""
    rows = s.filter_items(t.items(), ItemFilter(size_code="M"))
    return s.deep_page(rows, s.sort_keys("-favorites"), number=4, size=7, sorted_rows=20).select("item_id", "favorites", "total", "nb_pages")


def geo_radius_candidates(t):
    homes = t.users().select(F.col("home_lat").alias("centre_lat"), F.col("home_lon").alias("centre_lon")).distinct()
    centres = homes.withColumn("centre_id", F.concat_ws(":", "centre_lat", "centre_lon"))
    near = s.grid_candidates(centres, t.items().select("item_id", "lat", "lon"), 60.0)
    return near.select("centre_lat", "centre_lon", "item_id", F.round("distance_m", 1).alias("distance_m"))


def geo_score(t):
    homes = t.users().select(F.col("home_lat").alias("centre_lat"), F.col("home_lon").alias("centre_lon")).distinct()
    centres = homes.withColumn("centre_id", F.concat_ws(":", "centre_lat", "centre_lon"))
    near = s.grid_candidates(centres, t.items().select("item_id", "lat", "lon"), 60.0)
    score = geo.proximity_score(F.col("distance_m"), F.lit(60.0))
    return near.select("centre_lat", "centre_lon", "item_id", F.round(score, 6).alias("geo_score"))


ITEMS = with_tables("items", "item_attributes")
COMPACT = """SELECT item_id, code, title, difficulty, terrain, lat, lon, t.name AS type_label, i.type_code,
 s.name AS size_label, i.size_code FROM items i LEFT JOIN item_types t USING (type_code) LEFT JOIN item_sizes s USING (size_code)"""
DIMS = with_tables("items", "item_types", "item_sizes")
DIST = haversine_sql("45.0", "5.0", "lat", "lon")
HOME = haversine_sql("home_lat", "home_lon", "lat", "lon")


def _sort_sql(order):
    return with_tables("items") + (
        "SELECT item_id, (SELECT count(*) FROM items) AS total,"
        " CAST(ceil((SELECT count(*) FROM items) / 200) AS BIGINT) AS nb_pages FROM items"
        f" ORDER BY {order}, item_id LIMIT 200"
    )


CHECKS = {
    "filter_items": (
        _q(filter_items),
        ITEMS
        + f"""SELECT {FLAT_SQL} FROM items i WHERE type_code = 'economy' AND difficulty BETWEEN 1.5 AND 4.0 AND terrain <= 4.5
 AND placed_at >= DATE '2003-01-01' AND placed_at <= DATE '2017-12-31' AND lat BETWEEN 40 AND 49 AND lon BETWEEN 0 AND 9.5
 AND EXISTS (SELECT 1 FROM item_attributes a WHERE a.item_id = i.item_id AND attr_id IN (1,2,3) AND is_positive)
 AND EXISTS (SELECT 1 FROM item_attributes a WHERE a.item_id = i.item_id AND attr_id IN (7,8,9,10,11) AND NOT is_positive)""",
    ),
    "filter_items_text": (
        _q(filter_items_text),
        ITEMS + f"SELECT {FLAT_SQL} FROM items WHERE country_id = 3 AND regexp_matches(lower(concat(title, ' ', description)), '\\b(red|promo)\\b')",
    ),
    "text_search": (
        _q(text_search),
        ITEMS + f"SELECT {FLAT_SQL} FROM items WHERE regexp_matches(lower(concat(title, ' ', description)), '\\b(widget|economy)\\b')",
    ),
    "within_bbox": (
        _q(within_bbox),
        ITEMS + f"SELECT {FLAT_SQL} FROM items WHERE lat BETWEEN 41.25 AND 46.75 AND lon BETWEEN 1.5 AND 7 AND size_code = 'M'",
    ),
    "within_radius": (
        _q(within_radius),
        ITEMS + f"SELECT item_id, code, round({DIST}, 3) AS distance_km FROM items WHERE {DIST} <= 100",
    ),
    "within_radius_page": (
        _q(within_radius_page),
        ITEMS
        + f"""SELECT item_id, round({DIST}, 3) AS distance_km, count(*) OVER () AS total,
 CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS nb_pages FROM items WHERE {DIST} <= 100 ORDER BY {DIST}, item_id LIMIT 20""",
    ),
    "haversine_km": (
        _q(haversine),
        with_tables("items", "users", "finds")
        + f"SELECT user_id, item_id, round({HOME}, 3) AS distance_km FROM finds JOIN items USING (item_id) JOIN users USING (user_id)",
    ),
    "compact_projection": (_q(compact), DIMS + COMPACT),
    "lookup_by_code": (
        _q(lookup_by_code),
        DIMS + COMPACT + " WHERE code IN (SELECT concat('GC', lpad(CAST(l_partkey * 2 AS VARCHAR), 6, '0')) FROM lineitem)",
    ),
    "lookup_by_id": (_q(lookup_by_id), DIMS + COMPACT + " WHERE item_id IN (SELECT l_partkey * 3 FROM lineitem)"),
    "sort_items": (_q(_sorted("no such order")), _sort_sql("placed_at DESC")),
    "sort_items_placed": (_q(_sorted("-placed_at")), _sort_sql("placed_at DESC")),
    "sort_items_favorites": (_q(_sorted("-favorites")), _sort_sql("favorites DESC")),
    "sort_items_difficulty": (_q(_sorted("difficulty")), _sort_sql("difficulty")),
    "sort_items_terrain": (_q(_sorted("terrain")), _sort_sql("terrain")),
    "paginate": (
        _q(paginate),
        ITEMS
        + """SELECT item_id, favorites, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 37) AS BIGINT) AS nb_pages
 FROM items WHERE size_code = 'M' ORDER BY favorites DESC, item_id LIMIT 37 OFFSET 37""",
    ),
    "paginate_deep": (
        _q(paginate_deep),
        with_tables("finds")
        + """SELECT user_id, item_id, found_date, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50) AS BIGINT) AS nb_pages
 FROM finds ORDER BY found_date DESC, user_id, item_id LIMIT 50 OFFSET 2950""",
    ),
    "sort_items_deep": (
        _q(sort_items_deep),
        ITEMS
        + """SELECT item_id, favorites, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS nb_pages
 FROM items WHERE size_code = 'M' ORDER BY favorites DESC, item_id LIMIT 7 OFFSET 21""",
    ),
    "geo_radius_candidates": (
        _q(geo_radius_candidates),
        with_tables("items", "users")
        + f"""SELECT home_lat AS centre_lat, home_lon AS centre_lon, item_id, round({HOME} * 1000, 1) AS distance_m
 FROM (SELECT DISTINCT home_lat, home_lon FROM users), items WHERE {HOME} * 1000 <= 60000""",
    ),
    "geo_score": (
        _q(geo_score),
        with_tables("items", "users")
        + f"""SELECT home_lat AS centre_lat, home_lon AS centre_lon, item_id,
 round(1.0 / (1.0 + pow({HOME} * 1000 / (300.0 * 60), 2)), 6) AS geo_score
 FROM (SELECT DISTINCT home_lat, home_lon FROM users), items WHERE {HOME} * 1000 <= 60000""",
    ),
}
