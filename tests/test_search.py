import datetime
import math
import random

import pytest

from cairnwise.functions import geo
from cairnwise.operators import search


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def test_grid_join_equals_brute_force_everywhere(spark):
    rnd = random.Random(11)
    centres = [(0, 45.0, 5.0), (1, 0.0, 179.9), (2, 70.0, -179.95), (3, 89.5, 10.0), (4, -33.0, 18.0), (5, -89.9, 0.0)]
    items = []
    for _, lat, lon in centres:
        for _ in range(60):
            y = max(-90.0, min(90.0, lat + rnd.uniform(-1.2, 1.2)))
            spread = 1.2 / max(math.cos(math.radians(y)), 0.01)
            x = (lon + rnd.uniform(-spread, spread) + 180) % 360 - 180
            items.append((len(items), y, x))
    c = spark.createDataFrame(centres, "centre_id int, centre_lat double, centre_lon double")
    i = spark.createDataFrame(items, "item_id int, lat double, lon double")
    got = {(r.centre_id, r.item_id) for r in search.grid_candidates(c, i, 80.0).collect()}
    want = {(a, b) for a, la, lo in centres for b, y, x in items if haversine(la, lo, y, x) <= 80.0}
    assert got == want and len(want) > 100


def test_radius_box_contains_circle(spark):
    for lat, lon, r in [(45, 5, 100), (0, 0, 10), (80, 179, 100), (-89.9, 0, 100)]:
        lo_lat, lo_lon, hi_lat, hi_lon = geo.radius_box(lat, lon, r)
        for k in range(72):
            b = math.radians(5 * k)
            d = r / 6371.0
            p = math.radians(lat)
            y = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
            x = math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(y))
            x = (math.degrees(x) + 180) % 360 - 180
            assert lo_lat <= math.degrees(y) <= hi_lat and lo_lon <= x <= hi_lon


def test_missing_coordinates_have_no_distance(spark):
    df = spark.createDataFrame([(None, 1.0)], "lat double, lon double")
    from pyspark.sql import functions as F

    assert df.select(geo.haversine_km(F.lit(1.0), F.lit(1.0), F.col("lat"), F.col("lon"))).first()[0] is None


def test_page_limits(spark):
    rows = spark.range(0, 500).withColumnRenamed("id", "item_id")
    from pyspark.sql import functions as F

    got = search.page(rows, [F.asc("item_id")], number=2, size=300).collect()
    assert [r.item_id for r in got] == list(range(300, 500))
    assert got[0].total == 500 and got[0].nb_pages == 2
    assert search.page(rows, [F.asc("item_id")], number=1, size=1000).count() == 500
    with pytest.raises(ValueError):
        search.page(rows, [F.asc("item_id")], number=1, size=0)


def test_wide_radius_is_honoured(spark):
    items = spark.createDataFrame([(1, 1.2, 0.0), (2, 1.4, 0.0)], "item_id bigint, lat double, lon double")
    assert [r.item_id for r in search.within_radius(items, 0.0, 0.0, 150.0).collect()] == [1]


def test_proximity_score(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (-1.0,), (15000.0,)], "d double")
    values = [r[0] for r in df.select(geo.proximity_score(F.col("d"), F.lit(50.0))).collect()]
    assert values[:2] == [1.0, 1.0] and abs(values[2] - 0.5) < 1e-12


def test_deep_pages_against_a_plain_sort(spark):
    """Nulls, heavy ties, NaN, dates and timestamps; every page of every order, both narrowed and sorted whole."""
    rnd = random.Random(5)
    rows = []
    for i in range(1, 3001):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=int(rnd.expovariate(0.02)))
        number = None if i % 11 == 0 else 7.5 if i % 3 == 0 else math.nan if i % 50 == 0 else rnd.choice([-1, 1]) * 10 ** rnd.uniform(-200, 200)
        stamp = datetime.datetime(2021, 10, 31) + datetime.timedelta(seconds=rnd.randrange(8 * 3600))
        rows.append((i, day if i % 7 else None, number, stamp, i % 2 == 0, None))
    rnd.shuffle(rows)
    schema = "item_id long, day date, number double, stamp timestamp, flag boolean, empty int"
    df = spark.createDataFrame(rows, schema).repartition(5).cache()
    for keys in (
        [("day", True), ("item_id", False)],
        [("number", False), ("item_id", True)],
        [("number", True), ("item_id", False)],
        [("stamp", False), ("item_id", False)],
        [("flag", True), ("empty", False), ("day", False), ("item_id", False)],
    ):
        want = [r.item_id for r in df.orderBy(*search.order_of(keys)).select("item_id").collect()]
        for number, size in ((1, 40), (20, 40), (7, 300), (75, 40), (1, 5000)):
            got = search.deep_page(df, keys, number, size, sorted_rows=200).collect()
            assert [r.item_id for r in got] == want[(number - 1) * size : number * size], (keys, number, size)
            assert all(r.total == 3000 and r.nb_pages == -(-3000 // size) for r in got)
    assert search.deep_page(df, [("item_id", False)], 9, 1000).count() == 0
    assert search.deep_page(df.limit(0), [("item_id", False)], 1, 10).count() == 0
    with pytest.raises(ValueError):
        search.deep_page(df.withColumn("word", df.item_id.cast("string")), [("word", False)], 1, 10)


def test_deep_page_sorts_only_its_range(spark):
    """Of a million rows with one value on a third of them, no range handed to the sort is large."""
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("favorites"))
    for first in (0, 333_000, 500_000, 700_000, 999_900):
        ranges = search._ranges(df, F.lit(True), [("favorites", True), ("item_id", False)], first, first + 100, 1_000_000, 1_000_000, 5_000)
        assert sum(take for _, _, take, _ in ranges) == 100
        assert all(df.where(condition).count() <= 5_000 for condition, _, _, _ in ranges)


def test_values_too_close_for_quantiles(spark):
    from pyspark.sql import functions as F

    df = spark.range(600).select((F.col("id") + F.lit(2**62)).alias("item_id"))
    got = [r.item_id - 2**62 for r in search.deep_page(df, [("item_id", False)], 30, 10, sorted_rows=20).collect()]
    assert got == list(range(290, 300))
