import unicodedata
import re

import pytest
from pyspark.sql import functions as F

from cairnwise.functions import normalise as n
from cairnwise.operators import enrolments as e
from cairnwise.operators import ingest, merge
from cairnwise.operators import audit
from cairnwise.sources import waypoints


def test_upsert_twice_equals_once(spark):
    old = spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "code string, title string, n int")
    batch = spark.createDataFrame([("B", None, 5, 1), ("C", "z", 6, 1), ("C", None, 7, 2)], "code string, title string, n int, ord int")
    once = merge.upsert(old, batch, ["code"], "ord")
    rows = {r.code: (r.title, r.n, r.change) for r in once.collect()}
    assert rows == {"A": ("x", 1, "kept"), "B": ("y", 5, "updated"), "C": ("z", 7, "inserted")}
    again = merge.upsert(once.drop("change"), batch, ["code"], "ord").drop("change")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.drop("change").collect()))


def test_extract_codes(spark):
    df = spark.createDataFrame([(1, "gc1a, GC2B xGC3 GC1A (GC4)GC"), (2, None)], "k int, text string")
    assert [(r.k, r.code) for r in merge.extract_codes(df).orderBy("k", "position").collect()] == [(1, "GC1A"), (1, "GC2B"), (1, "GC4")]


def test_missing_enrolments_against_brute_force(spark):
    challenges = spark.createDataFrame([(c,) for c in range(40)], "challenge_id long")
    uc = spark.createDataFrame([(u, c) for u in range(5) for c in range(40) if (u + c) % 3 == 0], "user_id long, challenge_id long")
    asked = spark.createDataFrame([(1,), (3,), (9,)], "user_id long")
    got = {(r.user_id, r.challenge_id) for r in e.missing_enrolments(asked, challenges, uc, "2020-01-01", shards=8).collect()}
    have = {(r.user_id, r.challenge_id) for r in uc.collect()}
    assert got == {(u, c) for u in (1, 3, 9) for c in range(40)} - have
    counts = {r.user_id: r.created for r in e.missing_counts(asked, challenges, uc).collect()}
    assert counts == {u: sum(1 for x in got if x[0] == u) for u in (1, 3, 9)}


@pytest.mark.parametrize("text", ["Île-de-France", "STRASSE ß", "ﬁne ½ Ǆ", "Škoda Łódź", "K ℃ ™", "Ångström①", "日本 Tokyo", ""])
def test_plain_name_key_equals_unicode_folding(spark, text):
    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(n.plain_name_key(F.col("t"))).first()[0] == re.sub("[^a-z0-9]", "", folded)


@pytest.mark.parametrize(
    "text,lat,lon",
    [
        ("48.8566 2.3522", 48.8566, 2.3522), ("43.1234, 5.6789", 43.1234, 5.6789), ("-33.8688 151.2093", -33.8688, 151.2093),
        ("N48.8566 E2.3522", 48.8566, 2.3522), ("S33.86 W70.67", -33.86, -70.67), ("N 40° 42.768 W 074° 00.360", 40.7128, -74.006), ("48° 30' 36\"N 2° 20' 24\" W", 48.51, -2.34),
        ("2.5E, 48.5N", 48.5, 2.5), ("48,5 N 2,25 W", 48.5, -2.25), ("-10.5, -20.5", -10.5, -20.5),
    ],
)
def test_positions(spark, text, lat, lon):
    row = ingest.parse_positions(spark.createDataFrame([(text,)], "p string"), "p").first()
    assert row.position_error is None and abs(row.lat - lat) < 1e-6 and abs(row.lon - lon) < 1e-6


@pytest.mark.parametrize("text", ["200.0 300.0", "not a coordinate at all xyz", "N 48 75.5, E 2 10", None, ""])
def test_bad_positions(spark, text):
    row = ingest.parse_positions(spark.createDataFrame([(text,)], "p string"), "p").first()
    assert row.position_error is not None and row.lat is None and row.lon is None


@pytest.mark.parametrize(
    "text,ok",
    [("2023-05-15T14:30:45.123Z", True), ("2023-05-15T14:30:45Z", True), ("2023-05-15 14:30:45", True), (" 2023-05-15 ", True), ("15/05/2023", False), ("2023-02-30", False), ("", False), (None, False)],
)
def test_timestamps(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert (df.select(n.timestamp(F.col("t"))).first()[0] is not None) == ok


def test_dialects(spark):
    cases = {
        '<gpx creator="c:geo - x">': "cgeo", '<gpx creator="a" xsi:schemaLocation="http://cgeo.org/x">': "cgeo", '<gpx creator="Pocket Query gen">': "pocket_query",
        '<gpx xmlns:g="http://www.groundspeak.com/cache/1/0/1">': "cgeo", '<gpx xmlns:g="http://www.groundspeak.com/cache/1/0">': "pocket_query",
        "<gpx><desc>a Pocket Query</desc></gpx>": "pocket_query", "<gpx/>": "cgeo", "nothing": "cgeo",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.d for r in df.select("t", waypoints.detect_dialect(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_orphan_cleanup_is_idempotent(spark, tmp_path):
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    ids = lambda *v: t([(x,) for x in v], "id int")
    tables = dict(
        countries=ids(1), types=ids(1), sizes=ids(1), attributes=ids(1), users=ids(1), states=t([(1, 1), (2, 9)], "id int, country_id int"),
        items=t([(1, 1, 1, 1, 1, [(1,)]), (2, 1, 2, 1, 1, []), (3, None, None, 1, 1, [(7,)])], "id int, country_id int, state_id int, type_id int, size_id int, attributes array<struct<attr_id:int>>"),
        challenges=t([(1, 1), (2, 2)], "id int, item_id int"), enrolments=t([(1, 1, 1), (2, 1, 2)], "id int, user_id int, challenge_id int"),
        finds=t([(1, 1, 1), (2, 1, 3)], "id int, user_id int, item_id int"), tasks=t([(1, 1), (2, 2)], "id int, uc_id int"), snapshots=t([(1, 2)], "id int, uc_id int"),
        targets=t([(1, 1, 1, 1, 2), (2, 1, 1, 1, None)], "id int, user_id int, uc_id int, item_id int, primary_task_id int"),
    )
    report = audit.orphans(tables)
    got = sorted((r.table, r.column, r.id) for r in report.collect())
    assert got == [
        ("challenges", "item_id", "2"), ("enrolments", "challenge_id", "2"), ("finds", "item_id", "2"), ("items", "attributes.attr_id", "3"), ("items", "state_id", "2"),
        ("snapshots", "uc_id", "1"), ("states", "country_id", "2"), ("targets", "primary_task_id", "1"), ("tasks", "uc_id", "2"),
    ]
    cleaned = audit.clean(tables, report, str(tmp_path / "backup"))
    assert audit.orphans(cleaned).count() == 0


def _references(spark, **given):
    """All tables of the audit, empty unless given."""
    columns = {name: [] for name in audit.ORDER}
    for source, column, _ in audit.REFERENCES:
        columns[source].append("attributes array<struct<attr_id:int>>" if "." in column else f"{column} int")
    return {n: spark.createDataFrame(given.get(n, []), ", ".join(["id int", *columns[n]])) for n in audit.ORDER}


def test_orphans_of_repeated_and_missing_keys(spark):
    """A marked id counts for all its rows, each orphan once; missing references are none, missing ids are reported."""
    got = audit.orphans(_references(
        spark, users=[(1,), (1,), (None,)], countries=[(1,)], states=[(5, 1), (5, 2), (6, None), (None, 3)],
        items=[(7, None, 5, None, None, [(4,), (4,), (None,)]), (7, None, 5, None, None, None), (8, 1, 6, None, None, [])],
        finds=[(1, 7, 1), (1, 7, 1), (2, 8, 1), (3, None, 2), (4, 8, None)], targets=[(9, 2, None, 7, None), (9, 1, None, 7, None)],
    ))
    want = [
        ("finds", "item_id", "1"), ("finds", "user_id", "3"), ("items", "attributes.attr_id", "7"), ("items", "state_id", "7"),
        ("states", "country_id", "5"), ("states", "country_id", None), ("targets", "item_id", "9"), ("targets", "user_id", "9"),
    ]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_orphans_of_text_keys(spark):
    """Keys of unlike types are compared as text, and cleaned as text."""
    tables = _references(spark, items=[(1, None, None, 7, None, None), (2, None, None, 8, None, None)])
    tables["types"] = spark.createDataFrame([("07",), ("8",)], "id string")
    report = audit.orphans(tables)
    assert [tuple(r) for r in report.collect()] == [("items", "type_id", "1")]
    more = report.unionByName(spark.createDataFrame([("items", "x", "02"), ("items", "x", "no number")], report.schema))
    assert [r.id for r in audit.clean(tables, more)["items"].collect()] == [2]


def test_orphans_move_ids_alone(spark, tmp_path, monkeypatch):
    """Nothing but the ids of parents and their reports is written, and no row is sorted by its parent's name."""
    labels = []
    monkeypatch.setattr(audit, "materialise", lambda df, label: labels.append((label, df.columns)) or df)
    plan = audit.orphans(_references(spark))._jdf.queryExecution().executedPlan().toString()
    assert set(map(str, labels)) == {str(("orphans", ["table", "column", "id"])), str(("parents", ["id"]))}
    assert "Sort [parent" not in plan and plan.count("LeftAnti") >= len(audit.REFERENCES)


def test_blank_status_leaves_the_status_alone(spark):
    uc = spark.createDataFrame([(1, 1, "accepted", None), (2, 1, "accepted", "completed")], "uc_id long, user_id long, status string, computed_status string")
    patches = spark.createDataFrame(
        [(1, 1, "  ", "x", None, 1), (2, 1, "", None, None, 1), (1, 1, "gone", None, None, 2)],
        "uc_id long, user_id long, status string, notes string, reason string, ord int",
    )
    got = {(r.uc_id, r.ord): (r.status, r.error) for r in e.check_patches(uc, patches).collect()}
    assert got == {(1, 1): (None, None), (2, 1): (None, None), (1, 2): ("gone", "status_unknown: gone")}


def test_dialects_of_files_over_several_splits(spark, tmp_path):
    """Tag by tag over small splits, and equal to the detection on whole texts."""
    body = "".join(f'<wpt lat="1" lon="{i}"><name>GC{i}</name><desc>text {i}\n more</desc></wpt>\n' for i in range(200))
    pocket, cgeo = '<gpx creator="Groundspeak Pocket Query">', '<gpx creator="c:geo - x">'
    other = '<gpx\n version="1.0"\n creator="other"\n xmlns:g="http://www.groundspeak.com/cache/1/0">'
    texts = {
        "first_root_wins.gpx": f'<?xml version="1.0"?>\n{pocket}{body}{cgeo}{body}',
        "first_root_wins_too.gpx": f"{cgeo}{body}{pocket}{body}{pocket}",
        "late_root.gpx": f"<!-- {'x' * 3000} -->{body}<k:gpx creator='pocket query'>{cgeo}",
        "several_lines.gpx": f"{other}{body}",
        "late_words.gpx": f"<gpx>{body}{body}<desc>Made by C:GEO</desc></gpx>",
        "late_pocket.gpx": f"<gpx>{body}{body}<desc>my Pocket Query</desc></gpx>",
        "words_over_lines.gpx": f"<gpx>{body}<desc>pocket\nquery</desc></gpx>",
        "no_root.gpx": "words only, a pocket query",
        "not_a_root.gpx": '<gpxx creator="pocket query">',
        "empty.gpx": "",
        "sub/deeper.gpx": f"{pocket}{body}",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    whole = spark.createDataFrame(list(texts.items()), "name string, text string").coalesce(1)
    want = {r["name"]: r.d for r in whole.select("name", waypoints.detect_dialect(F.col("text")).alias("d")).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = waypoints.read_dialects(spark, str(tmp_path))
        got = {r.source_file.split(f"{tmp_path}/")[1]: r.dialect for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert want.pop("empty.gpx") == "cgeo" and got == want
    assert want["first_root_wins.gpx"] == want["late_root.gpx"] == want["late_pocket.gpx"] == "pocket_query"


def test_enrolment_table_after_sync(spark):
    """New rows for the users who ask, completion of old and new ones, nothing doubled."""
    schema = "uc_id long, user_id long, challenge_id long, status string, computed_status string, percent double"
    uc = spark.createDataFrame(
        [(1, 1, 10, "accepted", None, 5.0), (2, 1, 11, "completed", None, 7.0), (3, 2, 10, None, "completed", 9.0),
         (4, 2, 99, "pending", None, None), (5, None, 10, "pending", None, 1.0), (6, 3, 11, "dismissed", None, 2.0)], schema)
    challenges = spark.createDataFrame([(10, 100), (11, 110), (12, 100), (12, 100), (13, None)], "challenge_id long, item_id long")
    finds = spark.createDataFrame([(1, 100), (1, 100), (2, 100), (3, 110), (None, 100), (4, 110)], "user_id long, item_id long")
    asked = spark.createDataFrame([(1,), (1,), (4,)], "user_id long")
    rows = e.sync(uc, challenges, finds, asked, "2024-01-01").collect()
    got = {(r.uc_id, r.user_id, r.challenge_id, r.status, r.computed_status, r.percent, r.created, r.auto_completed) for r in rows}
    assert len(rows) == 12 and got == {
        (1, 1, 10, "accepted", "completed", 100.0, False, True), (2, 1, 11, "completed", None, 7.0, False, False),
        (3, 2, 10, None, "completed", 9.0, False, False), (4, 2, 99, "pending", None, None, False, False),
        (5, None, 10, "pending", None, 1.0, False, False), (6, 3, 11, "dismissed", "completed", 100.0, False, True),
        (None, 1, 12, "pending", "completed", 100.0, True, True), (None, 1, 13, "pending", None, None, True, False),
        (None, 4, 10, "pending", None, None, True, False), (None, 4, 11, "pending", "completed", 100.0, True, True),
        (None, 4, 12, "pending", None, None, True, False), (None, 4, 13, "pending", None, None, True, False),
    }
    assert e.sync(uc, challenges, finds).count() == 6
    with pytest.raises(ValueError):
        e.sync(uc, challenges, finds, asked)


def test_a_batch_in_one_file_is_not_the_work_of_one_task(spark, monkeypatch):
    from cairnwise.plans import importing

    texts = ["title", "description", "url", "type", "size", "owner", "difficulty", "terrain", "country", "state", "placed_date", "favorites", "status", "found_date", "notes"]
    raw = spark.range(0, 90, 1, 1).selectExpr(
        "concat('GC', 1000 + id) AS code", "'45.5' AS latitude", "'5.5' AS longitude", *[f"CAST(NULL AS STRING) AS {c}" for c in texts],
        "array(named_struct('attr_id', 1, 'is_positive', true)) AS attributes", "id AS ord", "1L AS user_id", "'f' AS source_file",
    )
    items = spark.createDataFrame([], "item_id long, code string, title string, description string, url string, owner string, type_code string, size_code string, country_id int, state_id int,"
                                      " lat double, lon double, elevation int, difficulty double, terrain double, favorites int, status string, placed_at date, attributes array<struct<attr_id:int,is_positive:boolean>>")
    empty = lambda schema: spark.createDataFrame([], schema)
    dims = importing.Dimensions(
        empty("type_code string, name string"), empty("size_code string, name string"), empty("country_id int, name string"),
        empty("state_id int, name string, country_id int"), spark.createDataFrame([(1,)], "attr_id int"),
    )
    parts = {}
    written = importing.materialise

    def counted(df, label):
        kept = written(df, label)
        parts[label] = df.select(F.spark_partition_id()).distinct().count()
        return kept

    monkeypatch.setattr(importing, "materialise", counted)
    monkeypatch.setattr(importing, "ROWS_PER_PARTITION", 20)
    result = importing.import_rows(raw, items, empty("user_id long, item_id long, found_date date, notes string"), dims, "2002-01-01")
    assert parts["conformed"] == 5
    assert sorted(r["code"] for r in result.items.collect()) == sorted(f"GC{1000 + k}" for k in range(90))
