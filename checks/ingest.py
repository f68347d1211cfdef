"""Ingest queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.functions import normalise as n
from cairnwise.operators import ingest as g
from cairnwise.operators import referentials as ref
from cairnwise.sources.sample_tables import FIXED_AS_OF, SampleTables
from checks.tables import with_tables

AS_OF = f"{FIXED_AS_OF} 00:00:00"


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

# -- raw rows: items as text with broken values injected -----------------------------

# The same expressions serve both engines; only the type name of text differs.
RAW = {
    "code": "CASE item_id % 23 WHEN 5 THEN concat('  ', lower(code), ' ') WHEN 6 THEN concat('XX', code) WHEN 7 THEN NULL WHEN 8 THEN 'GC1' ELSE code END",
    "title": "CASE item_id % 19 WHEN 3 THEN NULL WHEN 4 THEN concat('  ', title, ' ') ELSE title END",
    "description": "CASE item_id % 7 WHEN 1 THEN NULL WHEN 2 THEN '<p> </p>' ELSE concat('<p class=\"d\">', description, '</p><br/>') END",
    "url": "CASE WHEN item_id % 3 = 0 THEN concat('http://x/', code) END",
    "latitude": "CASE item_id % 29 WHEN 1 THEN NULL WHEN 2 THEN '95.5' WHEN 3 THEN 'abc' WHEN 4 THEN '0' ELSE CAST(lat AS TEXT) END",
    "longitude": "CASE item_id % 29 WHEN 4 THEN '0' WHEN 5 THEN '-180.5' ELSE CAST(lon AS TEXT) END",
    "type": "CASE item_id % 59 WHEN 1 THEN 'Unheard Of' WHEN 2 THEN NULL ELSE concat(' ', upper(type_code)) END",
    "size": "CASE item_id % 61 WHEN 1 THEN 'gigantic' WHEN 2 THEN NULL ELSE CASE size_code WHEN 'M' THEN 'Mícro' WHEN 'S' THEN 'small' WHEN 'R' THEN 'Regular' WHEN 'L' THEN 'LARGE' ELSE 'Other' END END",
    "owner": "CASE item_id % 31 WHEN 1 THEN repeat('o', 101) WHEN 2 THEN '   ' ELSE owner END",
    "difficulty": "CASE item_id % 13 WHEN 1 THEN '7' WHEN 2 THEN '2.25' WHEN 3 THEN 'x' WHEN 4 THEN '1.75' WHEN 5 THEN NULL ELSE CAST(difficulty AS TEXT) END",
    "terrain": "CASE item_id % 13 WHEN 6 THEN '0.5' WHEN 7 THEN '4.24' WHEN 8 THEN '4.26' ELSE CAST(terrain AS TEXT) END",
    "country": "CASE item_id % 53 WHEN 1 THEN concat('Atlántis ', item_id % 4) WHEN 2 THEN 'nation-' || CAST(country_id AS TEXT) ELSE 'NATION_' || CAST(country_id AS TEXT) END",
    "state": "CASE item_id % 6 WHEN 1 THEN concat('Stâte ', item_id % 4) WHEN 2 THEN NULL WHEN 3 THEN concat('New État ', item_id % 5) ELSE concat('STATE ', item_id % 4) END",
    "placed_date": "CASE item_id % 17 WHEN 1 THEN '2031-01-01' WHEN 2 THEN '1999-05-05T00:00:00Z' WHEN 3 THEN 'garbage' WHEN 4 THEN NULL WHEN 5 THEN concat('1999-12-', 10 + item_id % 20) ELSE concat(CAST(old_placed AS TEXT), 'T10:00:00Z') END",
    "favorites": "CASE item_id % 37 WHEN 1 THEN '-4' WHEN 2 THEN '20000' WHEN 3 THEN 'many' WHEN 4 THEN NULL ELSE CAST(favorites AS TEXT) END",
    "status": "CASE item_id % 41 WHEN 1 THEN 'Disabled' WHEN 2 THEN 'weird' WHEN 3 THEN NULL ELSE status END",
    "found_date": "CASE WHEN item_id % 43 = 1 THEN '2030-07-01T00:00:00' WHEN item_id % 43 = 2 THEN '1998-01-01 10:00:00' WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN '2001-09-09T12:30:00.5Z' ELSE '2001-10-10' END",
    "notes": "CASE item_id % 47 WHEN 1 THEN repeat('n', 4100) WHEN 2 THEN '<i></i>' ELSE concat('<b>nice ', item_id, '</b>') END",
}


def _raw_columns(text: str) -> str:
    return ", ".join(f"{v.replace('AS TEXT', 'AS ' + text)} AS {k}" for k, v in RAW.items())


def raw_items(t):
    base = t.items().withColumn("old_placed", F.expr("date_add(DATE '2000-01-01', CAST((item_id * 37) % 600 AS INT))"))
    attributes = F.expr(
        "concat(transform(attributes, a -> named_struct('attr_id', a.attr_id, 'is_positive', IF(item_id % 5 = 0, CAST(NULL AS BOOLEAN), a.is_positive))),"
        " array(named_struct('attr_id', 900, 'is_positive', true)))"
    )
    return base.withColumn("attrs", attributes).selectExpr(
        "item_id", *[f"{v.replace('AS TEXT', 'AS STRING')} AS {k}" for k, v in RAW.items()], "attrs AS attributes"
    )


RAW_SQL = f"SELECT item_id, {_raw_columns('VARCHAR')} FROM (SELECT *, CAST(DATE '2000-01-01' + CAST((item_id * 37) % 600 AS INT) AS DATE) AS old_placed FROM items)"


def _stamp(column):
    shape = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z?| \d{1,2}:\d{1,2}:\d{1,2})?$"
    return f"CASE WHEN regexp_matches(trim({column}), '{shape}') THEN try_cast(regexp_replace(trim({column}), 'Z$', '') AS TIMESTAMP) END"


def _rating(column):
    return f"CASE WHEN try_cast({column} AS DOUBLE) BETWEEN 1 AND 5 THEN round_even(try_cast({column} AS DOUBLE) * 2, 0) / 2 END"


_IN_RANGE = "try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(longitude AS DOUBLE) BETWEEN -180 AND 180"
_CODE = "CASE WHEN regexp_matches(upper(trim(code)), '^GC[A-Z0-9]+$') THEN upper(trim(code)) END"
_FAV = "CASE WHEN regexp_matches(coalesce(favorites, '0'), '^[+-]?\\d+$') AND CAST(coalesce(favorites, '0') AS INT) >= 0 THEN CAST(coalesce(favorites, '0') AS INT) END"
_STATUS = "CASE WHEN lower(coalesce(status, 'active')) IN ('active','disabled','archived') THEN lower(coalesce(status, 'active')) END"
_PLAIN = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"


def _clean(column):
    return "nullif(" + TRIM.format(f"regexp_replace({column}, '<[^>]+>', '', 'g')") + ", '')"


RECORD = f"""SELECT item_id, {_CODE} AS code, nullif(trim(title), '') AS title, {_clean('description')} AS description, url,
 CASE WHEN {_IN_RANGE} THEN CAST(latitude AS DOUBLE) END AS lat, CASE WHEN {_IN_RANGE} THEN CAST(longitude AS DOUBLE) END AS lon,
 trim(type) AS type, size, nullif(trim(owner), '') AS owner, {_rating('difficulty')} AS difficulty, {_rating('terrain')} AS terrain, country, state,
 {_stamp('placed_date')} AS placed_at, {_FAV} AS favorites, {_STATUS} AS status,
 {_stamp('found_date')} AS found_at, CASE WHEN {_stamp('found_date')} IS NOT NULL THEN {_clean('notes')} END AS notes FROM raw"""


def _reason(strict):
    def only(text):
        return text if strict else ""

    return f"""CASE WHEN coalesce(code, '') = '' THEN 'code_missing' WHEN NOT regexp_matches(upper(code), '^GC[A-Z0-9]{{3,}}$') THEN 'code_malformed'
 {only("WHEN title IS NULL THEN 'title_missing'")} WHEN lat IS NULL OR lon IS NULL THEN 'position_missing'
 WHEN NOT lat BETWEEN -90 AND 90 THEN 'latitude_out_of_range' WHEN NOT lon BETWEEN -180 AND 180 THEN 'longitude_out_of_range'
 {only("WHEN lat = 0 AND lon = 0 THEN 'position_is_origin'")}
 WHEN NOT difficulty BETWEEN 1 AND 5 THEN 'difficulty_out_of_range' WHEN NOT terrain BETWEEN 1 AND 5 THEN 'terrain_out_of_range'
 WHEN length(trim(owner)) > 100 THEN 'owner_long' WHEN placed_at > TIMESTAMP '{AS_OF}' THEN 'placed_in_future'
 {only("WHEN year(placed_at) < 2000 THEN 'placed_too_early'")} WHEN favorites < 0 THEN 'favorites_negative'
 {only("WHEN favorites > 10000 THEN 'favorites_high'")} END"""


def validated_sql(source, strict=False):
    return f"""SELECT item_id, {_reason(strict)} AS reject_reason, code, CASE WHEN coalesce(title, '') = '' THEN 'Cache ' || code ELSE title END AS title,
 CASE WHEN NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN NOT (lat = 0 AND lon = 0) THEN lon END AS lon,
 round_even(difficulty * 2, 0) / 2 AS difficulty, round_even(terrain * 2, 0) / 2 AS terrain, nullif(trim(owner), '') AS owner,
 CASE WHEN NOT coalesce(year(placed_at) < 2000, false) THEN placed_at END AS placed_at, CASE WHEN favorites IS NOT NULL THEN least(favorites, 10000) END AS favorites,
 CASE WHEN lower(status) IN ('active','disabled','archived') THEN lower(status) ELSE 'active' END AS status FROM {source}"""


LOOSE = """SELECT item_id, CASE item_id % 23 WHEN 7 THEN NULL WHEN 8 THEN 'GC1' ELSE code END AS code, CASE WHEN item_id % 19 <> 3 THEN title END AS title,
 CASE item_id % 29 WHEN 1 THEN NULL WHEN 2 THEN 95.5 WHEN 4 THEN 0.0 ELSE lat END AS lat, CASE item_id % 29 WHEN 4 THEN 0.0 WHEN 5 THEN -180.5 ELSE lon END AS lon,
 CASE item_id % 13 WHEN 1 THEN 7.0 WHEN 2 THEN 2.25 WHEN 5 THEN NULL ELSE difficulty END AS difficulty, CASE item_id % 13 WHEN 6 THEN 0.5 ELSE terrain END AS terrain,
 CASE item_id % 31 WHEN 1 THEN repeat('o', 101) WHEN 2 THEN '   ' ELSE owner END AS owner, CAST(CASE item_id % 17 WHEN 1 THEN DATE '2031-01-01' WHEN 2 THEN DATE '1999-05-05' WHEN 3 THEN NULL ELSE DATE '2001-01-01' END AS TIMESTAMPTYPE) AS placed_at,
 CASE item_id % 37 WHEN 1 THEN -4 WHEN 2 THEN 20000 WHEN 3 THEN NULL ELSE favorites END AS favorites, CASE item_id % 41 WHEN 1 THEN 'Disabled' WHEN 2 THEN 'weird' ELSE status END AS status FROM items"""
VALID_COLUMNS = ["item_id", "reject_reason", "code", "title", "lat", "lon", "difficulty", "terrain", "owner", "placed_at", "favorites", "status"]


def loose_items(t):
    t.items().createOrReplaceTempView("cairnwise_items")
    sql = LOOSE.replace("TIMESTAMPTYPE", "TIMESTAMP_NTZ").replace("95.5", "95.5D").replace("0.0 ", "0.0D ").replace("-180.5", "-180.5D")
    sql = sql.replace("7.0", "7.0D").replace("2.25", "2.25D").replace("0.5 ", "0.5D ")
    return t.spark.sql(sql.replace("FROM items", "FROM cairnwise_items"))


def _stamped(df):
    return df.withColumn("placed_at", F.date_format("placed_at", TS)) if "placed_at" in df.columns else df


# -- queries ---------------------------------------------------------------------------


def normalize_name_basic(t):
    return t.raw("documents").select("doc_id", F.md5(n.name_key(F.col("text"))).alias("name_key"))


def normalize_name_accents(t):
    return t.raw("documents").select("doc_id", F.md5(n.plain_name_key(F.col("text"))).alias("name_key"))


def raw_stamps(t):
    return t.raw("orders").selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 9 WHEN 0 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.123'Z'") WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'")
 WHEN 2 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.654321") WHEN 3 THEN date_format(o_orderdate, "yyyy-MM-dd'T'08:09:10") WHEN 4 THEN date_format(o_orderdate, "yyyy-MM-dd 23:59:58")
 WHEN 5 THEN date_format(o_orderdate, "  yyyy-MM-dd ") WHEN 6 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 7 THEN date_format(o_orderdate, "yyyy-13-dd") ELSE '' END AS raw""",
    )


def parse_timestamp_multi(t):
    return raw_stamps(t).select("o_orderkey", F.date_format(n.timestamp(F.col("raw")), TS).alias("parsed"))


def normalize_coordinates(t):
    lat, lon = n.coordinates(F.col("latitude"), F.col("longitude"))
    return raw_items(t).select("item_id", lat.alias("lat"), lon.alias("lon"))


def normalize_dt(t):
    return raw_items(t).select("item_id", n.rating(F.col("difficulty")).alias("difficulty"), n.rating(F.col("terrain")).alias("terrain"))


def normalize_code(t):
    return raw_items(t).select("item_id", n.item_code(F.col("code")).alias("code"))


def strip_html(t):
    return t.raw("pages").select("page_id", F.md5(n.without_tags(F.col("html"))).alias("text_md5"))


def _record(t):
    return g.find_record(g.item_record(raw_items(t)))


def extract_item_record(t):
    return _stamped(_record(t)).select(
        "item_id", "code", "title", "description", "url", "lat", "lon", "type", "size", "owner", "difficulty", "terrain", "country", "state", "placed_at", "favorites", "status"
    )


def extract_find_record(t):
    return _record(t).where("found_at IS NOT NULL").select("item_id", F.date_format("found_at", TS).alias("found_at"), F.md5("notes").alias("notes_md5"))


def filter_import_mode(t):
    record = _record(t)
    modes = [F.when(g.import_mode_filter(m), F.lit(m)) for m in ("both", "all", "found", "other")]
    return record.select("item_id", F.explode(F.array_compact(F.array(*modes))).alias("mode"))


def _validate(strict):
    def run(t):
        return _stamped(g.validate_item(loose_items(t), FIXED_AS_OF, strict)).select(*VALID_COLUMNS)

    return run


def validate_find(t):
    strict = g.find_reason(FIXED_AS_OF, strict=True)
    rows = _record(t).withColumn("strict_reason", strict)
    return g.validate_find(rows, FIXED_AS_OF).select("item_id", "reject_reason", "strict_reason", F.length("notes").alias("notes_length"))


def validate_consistency(t):
    rows = g.validate_item(_record(t), FIXED_AS_OF).withColumn("find_code", F.expr("CASE WHEN item_id % 11 = 0 THEN 'GCOTHER' WHEN item_id % 11 > 4 THEN code END"))
    return rows.select(
        "item_id", g.consistency_reason("both", "find_code").alias("both_reason"), g.consistency_reason("found", "find_code").alias("found_reason")
    )


def _dims(t):
    types = t.item_types().select(F.col("type_code").alias("code"), "name", "sort_order").unionByName(
        t.spark.createDataFrame([("mystery", "Mystery", 50)], "code string, name string, sort_order int")
    ).withColumn("in_db", F.col("code") != "medium")
    sizes = t.item_sizes().select(F.col("size_code").alias("code"), "name", "sort_order").withColumn("in_db", F.col("code") != "O")
    return types, sizes


FUZZY = "CASE item_id % 6 WHEN 0 THEN upper(type_code) WHEN 1 THEN concat(type_code, ' place') WHEN 2 THEN substr(type_code, 1, 3) WHEN 3 THEN 'Unknown thing' WHEN 4 THEN 'zzz' ELSE NULL END"
FUZZY_SIZE = "CASE item_id % 4 WHEN 0 THEN 'MICRO' WHEN 1 THEN 'regular (R)' WHEN 2 THEN 'ther' ELSE 'zzz' END"


def resolve_type_fuzzy(t):
    types, _ = _dims(t)
    rows = t.items().selectExpr("item_id", f"{FUZZY} AS type")
    return g.fuzzy_match(rows, "type", types, "code", "name", "type_key", g.TYPE_SYNONYMS).select("item_id", "type_key")


def resolve_size_fuzzy(t):
    _, sizes = _dims(t)
    rows = t.items().selectExpr("item_id", f"{FUZZY_SIZE} AS size")
    return g.fuzzy_match(rows, "size", sizes, "code", "name", "size_key").select("item_id", "size_key")


def validate_with_reason(t):
    return g.reason_codes(raw_items(t), *_dims(t)).select("item_id", "reason")


def validate_reason_report(t):
    return validate_with_reason(t).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _attributes(t):
    return t.spark.range(0, 12).selectExpr("CAST(id AS INT) AS attr_id", "concat('attr_', id) AS code", "concat('Attribute ', id) AS name").unionByName(
        t.spark.createDataFrame([(71, "challenge", "Challenge cache")], "attr_id int, code string, name string")
    )


def map_referentials(t):
    rows = ref.map_referentials(_record(t), t.item_types(), t.item_sizes(), t.countries(), t.states(), _attributes(t))
    signs = F.transform(F.sort_array("attributes"), lambda a: F.concat_ws(":", a["attr_id"].cast("string"), a["is_positive"].cast("string")))
    return rows.select("item_id", "country_id", "state_id", "type_code", "size_code", F.array_join(signs, ",").alias("attributes"))


def create_missing_countries(t):
    return ref.missing_countries(_record(t), t.countries())


def create_missing_states(t):
    countries = t.countries().unionByName(create_missing_countries(t))
    return ref.missing_states(_record(t), countries, t.states())


def create_missing_countries_states(t):
    """Both in one table, as one import would add them."""
    record = _record(t)
    new_countries = ref.missing_countries(record, t.countries())
    new_states = ref.missing_states(record, t.countries().unionByName(new_countries), t.states())
    return new_countries.select(F.lit("country").alias("kind"), F.col("country_id").alias("id"), "name", F.lit(None).cast("int").alias("country_id")).unionByName(
        new_states.select(F.lit("state").alias("kind"), F.col("state_id").alias("id"), "name", "country_id")
    )


def _alias_table(t):
    sizes = t.item_sizes().withColumn("aliases", F.array(F.concat(F.lit("alias-"), F.col("name"))))
    return ref.alias_table(t.item_types(), sizes, t.countries(), t.states(), _attributes(t))


REQUESTS = """explode(array(
 named_struct('kind', 'type', 'field', 'code', 'value', upper(type_code), 'scope', CAST(NULL AS STRING)),
 named_struct('kind', 'size', 'field', 'alias', 'value', concat('ALIAS-', CASE WHEN size_code = 'M' THEN 'micro' ELSE 'none' END), 'scope', CAST(NULL AS STRING)),
 named_struct('kind', 'country', 'field', 'name', 'value', concat('nation_', country_id), 'scope', CAST(NULL AS STRING)),
 named_struct('kind', 'state', 'field', 'name', 'value', concat('State ', item_id % 5), 'scope', CASE WHEN item_id % 2 = 0 THEN CAST(item_id % 25 AS STRING) END),
 named_struct('kind', 'attribute', 'field', 'code', 'value', concat('ATTR_', item_id % 15), 'scope', CAST(NULL AS STRING)))) AS r"""


def resolve_code(t):
    asked = t.items().selectExpr("item_id", REQUESTS).select("item_id", "r.*")
    return ref.resolve(asked, _alias_table(t)).select("item_id", "kind", "id", "error")


def resolve_alias(t):
    """Size aliases of every item, case ignored, half of them unknown."""
    asked = t.items().selectExpr(
        "item_id", "'size' AS kind", "'alias' AS field",
        "CASE item_id % 4 WHEN 0 THEN 'ALIAS-MICRO' WHEN 1 THEN 'alias-large' WHEN 2 THEN 'Micro' ELSE concat('alias-', item_id) END AS value", "CAST(NULL AS STRING) AS scope",
    )
    return ref.resolve(asked, _alias_table(t)).select("item_id", "id", "error")


def check_ids_exist(t):
    refs = t.finds().selectExpr("item_id + 500 AS item_id")
    return ref.check_ids(refs, t.items(), "item_id")


def _incoming(t):
    return t.countries().where("country_id % 3 < 2").selectExpr("country_id", "CASE WHEN country_id % 3 = 0 THEN name ELSE concat(name, '!') END AS name").unionByName(
        t.raw("supplier").selectExpr("CAST(s_suppkey + 1000 AS INT) AS country_id", "s_name AS name")
    )


def upsert_dimension(t):
    return ref.upsert_dimension(t.countries(), _incoming(t), "country_id")


def upsert_dimension_replace(t):
    return ref.upsert_dimension(t.countries(), _incoming(t), "country_id", replace=True)


POSITION = """CASE item_id % 8 WHEN 0 THEN concat(CAST(lat AS TEXT), ', ', CAST(lon AS TEXT)) WHEN 1 THEN concat(CAST(lat AS TEXT), 'N ', replace(CAST(abs(lon) AS TEXT), '.', ','), CASE WHEN lon < 0 THEN 'W' ELSE 'E' END)
 WHEN 2 THEN concat(CASE WHEN lon < 0 THEN 'w' ELSE 'e' END, CAST(abs(lon) AS TEXT), ', n', CAST(lat AS TEXT))
 WHEN 3 THEN concat(CAST(CAST(floor(lat) AS INT) AS TEXT), '° ', CAST(item_id % 60 AS TEXT), '.5 S ,  ', CAST(item_id % 180 AS TEXT), '° ', CAST(item_id % 60 AS TEXT), chr(39), ' ', CAST(item_id % 60 AS TEXT), chr(34), ' W')
 WHEN 4 THEN CASE WHEN item_id % 16 = 4 THEN concat('N ', CAST(item_id % 90 AS TEXT), '° ', CAST(item_id % 60 AS TEXT), '.250 W ', CAST(item_id % 180 AS TEXT), '° 07.500') ELSE concat('200.', CAST(item_id AS TEXT), ' 300.0') END WHEN 5 THEN 'no position here' WHEN 6 THEN concat('N 48° 75.', CAST(item_id AS TEXT), ', E 2° 10') ELSE concat(CAST(-lat AS TEXT), ' ', CAST(lon AS TEXT)) END"""


def parse_coordinate_text(t):
    rows = t.items().selectExpr("item_id", POSITION.replace("AS TEXT", "AS STRING") + " AS position")
    return g.parse_positions(rows, "position").select("item_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "position_error")


def _elevation_lookup(t):
    return t.items().where("item_id % 4 < 2").selectExpr("round(lat, 3) AS lat_key", "round(lon, 3) AS lon_key", "lat * 10 + 0.5 AS value").groupBy("lat_key", "lon_key").agg(F.max("value").alias("value"))


def enrich_elevation(t):
    return g.enrich_elevation(t.items(), _elevation_lookup(t)).select("item_id", "elevation", "outcome")


def enrich_elevation_counts(t):
    return g.enrichment_counts(g.enrich_elevation(t.items(), _elevation_lookup(t)))


def enrich_country_state(t):
    rows = t.items().selectExpr("item_id", "lat", "lon", "CASE WHEN country_id IS NOT NULL THEN concat('NATION_', country_id) END AS country", "CASE WHEN country_id IS NOT NULL THEN 'kept' END AS state")
    lookup = t.items().where("item_id % 3 > 0").selectExpr(
        "round(lat, 3) AS lat_key", "round(lon, 3) AS lon_key", "'Found' AS country", "CASE WHEN item_id % 4 = 0 THEN 's' END AS state",
        "CASE WHEN item_id % 4 = 1 THEN 'r' END AS region", "CASE WHEN item_id % 4 < 3 THEN 'c' END AS county",
    ).groupBy("lat_key", "lon_key").agg(*[F.max(c).alias(c) for c in ("country", "state", "region", "county")])
    return g.enrich_country_state(rows, lookup).select("item_id", "country", "state", "outcome")


WITH_RAW = with_tables("items", extra={"raw": RAW_SQL})
WITH_RECORD = with_tables("items", "item_attributes", "item_types", "item_sizes", "countries", "states", extra={"raw": RAW_SQL, "record": RECORD})
FMT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
TYPES = "SELECT type_code AS code, name, sort_order FROM item_types UNION ALL SELECT 'mystery', 'Mystery', 50"


def _fuzzy_sql(expr, dim, out, synonym=False):
    text = f"lower(trim(coalesce({expr}, '')))"
    exact = f"(SELECT code FROM {dim} d WHERE lower(d.name) = txt)"
    near = f"(SELECT code FROM {dim} d WHERE contains(txt, lower(d.name)) OR contains(lower(d.name), txt) ORDER BY sort_order LIMIT 1)"
    third = ", CASE WHEN contains(txt, 'unknown') THEN 'mystery' END" if synonym else ""
    return f"SELECT txt, coalesce({exact}, {near}{third}) AS {out} FROM (SELECT DISTINCT {text} AS txt FROM SOURCE)"


_R = "{c} IS NOT NULL AND {c} <> '' AND try_cast({c} AS DOUBLE) IS NULL THEN concat('{c}_invalid_value: ', {c})"
_N = "try_cast({c} AS DOUBLE)"


def _rating_reasons(c):
    num = f"try_cast({c} AS DOUBLE)"
    return (
        f" WHEN {c} <> '' AND {num} IS NULL THEN concat('{c}_invalid_value: ', {c}) WHEN NOT {num} BETWEEN 1 AND 5 THEN concat('{c}_out_of_range: ', CAST({num} AS VARCHAR))"
        f" WHEN round_even({num} * 2, 0) <> {num} * 2 THEN concat('{c}_invalid_increment: ', CAST({num} AS VARCHAR))"
    )


REASON_CTES = {
    "raw": RAW_SQL,
    "tdim": TYPES,
    "sdim": "SELECT size_code AS code, name, sort_order FROM item_sizes",
    "tf": _fuzzy_sql("type", "tdim", "type_key", True).replace("SOURCE", "raw"),
    "sf": _fuzzy_sql("size", "sdim", "size_key").replace("SOURCE", "raw"),
    "reasons": """SELECT item_id, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates' WHEN try_cast(latitude AS DOUBLE) IS NULL OR try_cast(longitude AS DOUBLE) IS NULL THEN 'invalid_coordinate_values'
 WHEN NOT (try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(longitude AS DOUBLE) BETWEEN -180 AND 180) THEN 'invalid_coordinates_range'
 WHEN type_key IS NULL THEN concat('unknown_cache_type: ', coalesce(type, 'None')) WHEN type_key = 'medium' THEN concat('cache_type_not_in_db: ', coalesce(type, 'None'))
 WHEN size_key IS NULL THEN concat('unknown_cache_size: ', coalesce(size, 'None')) WHEN size_key = 'O' THEN concat('cache_size_not_in_db: ', coalesce(size, 'None'))"""
    + _rating_reasons("difficulty") + _rating_reasons("terrain")
    + """ ELSE 'valid' END AS reason FROM raw LEFT JOIN tf ON tf.txt = lower(trim(coalesce(type, ''))) LEFT JOIN sf ON sf.txt = lower(trim(coalesce(size, '')))""",
}
WITH_REASONS = with_tables("items", "item_types", "item_sizes", extra=REASON_CTES)
NEW_COUNTRIES = f"""SELECT CAST(24 + row_number() OVER (ORDER BY CAST('0x' || substr(md5(key), 1, 3) AS INT), key) AS INT) AS country_id, name FROM (
 SELECT {_PLAIN.format('country')} AS key, min(country) AS name FROM record WHERE coalesce(country, '') <> '' GROUP BY 1) WHERE key NOT IN (SELECT {_PLAIN.format('name')} FROM countries)"""
NEW_STATES = f"""SELECT CAST(99 + row_number() OVER (ORDER BY CAST('0x' || substr(md5(pair), 1, 3) AS INT), pair) AS INT) AS state_id, name, country_id FROM (
 SELECT c.country_id, {_PLAIN.format('r.state')} AS key, min(r.state) AS name, concat(c.country_id, ':', key) AS pair FROM record r JOIN allc c ON {_PLAIN.format('c.name')} = {_PLAIN.format('r.country')}
 WHERE coalesce(r.state, '') <> '' GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.country_id = x.country_id AND {_PLAIN.format('s.name')} = x.key)"""
WITH_NEW = with_tables("items", "countries", "states", extra={
    "raw": RAW_SQL, "record": RECORD, "newc": NEW_COUNTRIES, "allc": "SELECT country_id, name FROM countries UNION ALL SELECT * FROM newc",
})
INCOMING = """SELECT country_id, CASE WHEN country_id % 3 = 0 THEN name ELSE concat(name, '!') END AS name FROM countries WHERE country_id % 3 < 2
 UNION ALL SELECT CAST(s_suppkey + 1000 AS INT), s_name FROM supplier"""
DIM_MERGE = """SELECT coalesce(c.country_id, i.country_id) AS country_id, coalesce(i.name, c.name) AS name,
 CASE WHEN c.country_id IS NULL THEN 'inserted' WHEN i.country_id IS NULL THEN 'kept' WHEN i.name = c.name THEN 'same' ELSE 'updated' END AS change
 FROM countries c {} JOIN incoming i ON i.country_id = c.country_id"""
K = "round(lat,3) AS lat_key, round(lon,3) AS lon_key"
ELEVATION = f"""SELECT item_id, coalesce(elevation, CAST(round_even(value, 0) AS INT)) AS elevation, CASE WHEN elevation IS NULL THEN CASE WHEN value IS NULL THEN 'failed' ELSE 'updated' END END AS outcome
 FROM items LEFT JOIN (SELECT {K}, max(lat * 10 + 0.5) AS value FROM items WHERE item_id % 4 < 2 GROUP BY ALL) l ON elevation IS NULL AND lat_key = round(lat,3) AND lon_key = round(lon,3)"""

CHECKS = {
    "normalize_name_basic": (_q(normalize_name_basic), "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS name_key FROM documents"),
    "normalize_name_accents": (_q(normalize_name_accents), "SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS name_key FROM documents"),
    "parse_timestamp_multi": (
        _q(parse_timestamp_multi),
        f"""SELECT o_orderkey, {FMT.format("CASE o_orderkey % 9 WHEN 0 THEN o_orderdate + INTERVAL 123 MILLISECOND WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 654321 MICROSECOND "
        "WHEN 3 THEN CAST(o_orderdate AS DATE) + TIME '08:09:10' WHEN 4 THEN CAST(o_orderdate AS DATE) + TIME '23:59:58' WHEN 5 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END")} AS parsed FROM orders""",
    ),
    "normalize_coordinates": (_q(normalize_coordinates), WITH_RAW + f"SELECT item_id, CASE WHEN {_IN_RANGE} THEN CAST(latitude AS DOUBLE) END AS lat, CASE WHEN {_IN_RANGE} THEN CAST(longitude AS DOUBLE) END AS lon FROM raw"),
    "normalize_dt": (_q(normalize_dt), WITH_RAW + f"SELECT item_id, {_rating('difficulty')} AS difficulty, {_rating('terrain')} AS terrain FROM raw"),
    "normalize_code": (_q(normalize_code), WITH_RAW + f"SELECT item_id, {_CODE} AS code FROM raw"),
    "strip_html": (_q(strip_html), f"SELECT page_id, md5({_clean('html')}) AS text_md5 FROM pages"),
    "extract_item_record": (
        _q(extract_item_record),
        WITH_RECORD + f"SELECT item_id, code, title, description, url, lat, lon, type, size, owner, difficulty, terrain, country, state, {FMT.format('placed_at')} AS placed_at, favorites, status FROM record",
    ),
    "extract_find_record": (_q(extract_find_record), WITH_RECORD + f"SELECT item_id, {FMT.format('found_at')} AS found_at, md5(notes) AS notes_md5 FROM record WHERE found_at IS NOT NULL"),
    "filter_import_mode": (_q(filter_import_mode), WITH_RECORD + "SELECT item_id, unnest(['both','all']) AS mode FROM record UNION ALL SELECT item_id, 'found' FROM record WHERE found_at IS NOT NULL"),
    "validate_item": (_q(_validate(False)), with_tables("items", extra={"loose": LOOSE.replace("TIMESTAMPTYPE", "TIMESTAMP"), "v": validated_sql("loose")}) + f"SELECT * REPLACE ({FMT.format('placed_at')} AS placed_at) FROM v"),
    "validate_item_strict": (_q(_validate(True)), with_tables("items", extra={"loose": LOOSE.replace("TIMESTAMPTYPE", "TIMESTAMP"), "v": validated_sql("loose", True)}) + f"SELECT * REPLACE ({FMT.format('placed_at')} AS placed_at) FROM v"),
    "validate_find": (
        _q(validate_find),
        WITH_RECORD
        + f"""SELECT item_id, CASE WHEN found_at IS NULL THEN 'found_missing' WHEN found_at > TIMESTAMP '{AS_OF}' THEN 'found_in_future' END AS reject_reason,
 CASE WHEN found_at IS NULL THEN 'found_missing' WHEN found_at > TIMESTAMP '{AS_OF}' THEN 'found_in_future' WHEN year(found_at) < 2000 THEN 'found_too_early' WHEN length(notes) > 4000 THEN 'notes_long' END AS strict_reason,
 CAST(CASE WHEN notes IS NOT NULL THEN least(length(notes), 4000) END AS INT) AS notes_length FROM record""",
    ),
    "validate_consistency": (
        _q(validate_consistency),
        WITH_RECORD
        + """SELECT item_id, CASE WHEN found_at < placed THEN 'found_before_placed' WHEN mismatch THEN 'find_of_other_code' END AS both_reason,
 CASE WHEN found_at IS NULL THEN 'mode_needs_find' WHEN found_at < placed THEN 'found_before_placed' WHEN mismatch THEN 'find_of_other_code' END AS found_reason
 FROM (SELECT *, CASE WHEN year(placed_at) >= 2000 THEN placed_at END AS placed, found_at IS NOT NULL AND item_id % 11 = 0 AS mismatch FROM record)""",
    ),
    "validate_with_reason": (_q(validate_with_reason), WITH_REASONS + "SELECT item_id, reason FROM reasons"),
    "validate_reason_report": (_q(validate_reason_report), WITH_REASONS + "SELECT reason, count(*) AS rows FROM reasons GROUP BY reason"),
    "resolve_type_fuzzy": (
        _q(resolve_type_fuzzy),
        with_tables("items", "item_types", extra={"tdim": TYPES, "src": f"SELECT item_id, {FUZZY} AS type FROM items", "tf": _fuzzy_sql("type", "tdim", "type_key", True).replace("SOURCE", "src")})
        + "SELECT item_id, type_key FROM src LEFT JOIN tf ON txt = lower(trim(coalesce(type, '')))",
    ),
    "resolve_size_fuzzy": (
        _q(resolve_size_fuzzy),
        with_tables("items", "item_sizes", extra={"sdim": REASON_CTES["sdim"], "src": f"SELECT item_id, {FUZZY_SIZE} AS size FROM items", "sf": _fuzzy_sql("size", "sdim", "size_key").replace("SOURCE", "src")})
        + "SELECT item_id, size_key FROM src LEFT JOIN sf ON txt = lower(trim(coalesce(size, '')))",
    ),
    "map_referentials": (
        _q(map_referentials),
        WITH_RECORD
        + f"""SELECT item_id, c.country_id, s.state_id, t.type_code, z.size_code,
 (SELECT string_agg(concat(a.attr_id, ':', CASE WHEN r.item_id % 5 = 0 THEN true ELSE a.is_positive END), ',' ORDER BY a.attr_id) FROM item_attributes a WHERE a.item_id = r.item_id AND (a.attr_id < 12 OR a.attr_id = 71)) AS attributes
 FROM record r LEFT JOIN countries c ON {_PLAIN.format('c.name')} = {_PLAIN.format('r.country')} LEFT JOIN states s ON s.country_id = c.country_id AND {_PLAIN.format('s.name')} = {_PLAIN.format('r.state')}
 LEFT JOIN item_types t ON {_PLAIN.format('t.name')} = {_PLAIN.format('r.type')} LEFT JOIN item_sizes z ON {_PLAIN.format('z.name')} = {_PLAIN.format('r.size')}""",
    ),
    "create_missing_countries": (_q(create_missing_countries), WITH_NEW + "SELECT * FROM newc"),
    "create_missing_states": (
        _q(create_missing_states),
        WITH_NEW + NEW_STATES,
    ),
    "create_missing_countries_states": (
        _q(create_missing_countries_states),
        WITH_NEW + "SELECT 'country' AS kind, country_id AS id, name, CAST(NULL AS INT) AS country_id FROM newc UNION ALL SELECT 'state', state_id, name, country_id FROM (" + NEW_STATES + ")",
    ),
    "resolve_alias": (
        _q(resolve_alias),
        with_tables("items") + "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'L' END AS id, CASE WHEN item_id % 4 > 1 THEN 'not found' END AS error FROM items",
    ),
    "resolve_code": (
        _q(resolve_code),
        with_tables("items")
        + """SELECT item_id, 'type' AS kind, type_code AS id, NULL AS error FROM items
 UNION ALL SELECT item_id, 'size', CASE WHEN size_code = 'M' THEN 'M' END, CASE WHEN size_code <> 'M' THEN 'not found' END FROM items
 UNION ALL SELECT item_id, 'country', CAST(country_id AS VARCHAR), CASE WHEN country_id IS NULL THEN 'not found' END FROM items
 UNION ALL SELECT item_id, 'state', CASE WHEN item_id % 5 < 4 AND item_id % 2 = 0 THEN CAST(4 * (item_id % 25) + item_id % 5 AS VARCHAR) END, CASE WHEN item_id % 5 = 4 THEN 'not found' WHEN item_id % 2 = 1 THEN 'ambiguous' END FROM items
 UNION ALL SELECT item_id, 'attribute', CASE WHEN item_id % 15 < 12 THEN CAST(item_id % 15 AS VARCHAR) END, CASE WHEN item_id % 15 >= 12 THEN 'not found' END FROM items""",
    ),
    "check_ids_exist": (_q(check_ids_exist), with_tables("items", "finds") + 'SELECT DISTINCT item_id + 500 AS item_id, item_id + 500 IN (SELECT item_id FROM items) AS "exists" FROM finds'),
    "upsert_dimension": (_q(upsert_dimension), with_tables("countries", extra={"incoming": INCOMING}) + DIM_MERGE.format("FULL")),
    "upsert_dimension_replace": (_q(upsert_dimension_replace), with_tables("countries", extra={"incoming": INCOMING}) + DIM_MERGE.format("RIGHT")),
    "parse_coordinate_text": (
        _q(parse_coordinate_text),
        with_tables("items")
        + """SELECT item_id, round(CASE item_id % 8 WHEN 0 THEN lat WHEN 1 THEN lat WHEN 2 THEN lat WHEN 3 THEN -(floor(lat) + (item_id % 60 + 0.5) / 60) WHEN 4 THEN CASE WHEN item_id % 16 = 4 THEN item_id % 90 + (item_id % 60 + 0.25) / 60 END WHEN 7 THEN -lat END, 6) AS lat,
 round(CASE item_id % 8 WHEN 0 THEN lon WHEN 1 THEN lon WHEN 2 THEN lon WHEN 3 THEN -(item_id % 180 + (item_id % 60) / 60 + (item_id % 60) / 3600) WHEN 4 THEN CASE WHEN item_id % 16 = 4 THEN -(item_id % 180 + 0.125) END WHEN 7 THEN lon END, 6) AS lon,
 CASE item_id % 8 WHEN 4 THEN CASE WHEN item_id % 16 <> 4 THEN 'coordinates out of range' END WHEN 5 THEN 'unable to parse position' WHEN 6 THEN 'minutes or seconds out of range' END AS position_error FROM items""",
    ),
    "enrich_elevation": (_q(enrich_elevation), with_tables("items") + ELEVATION),
    "enrich_elevation_counts": (
        _q(enrich_elevation_counts),
        with_tables("items") + f"SELECT count(outcome) AS scanned, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM ({ELEVATION})",
    ),
    "enrich_country_state": (
        _q(enrich_country_state),
        with_tables("items")
        + f"""SELECT item_id, CASE WHEN country_id IS NOT NULL THEN concat('NATION_', country_id) ELSE l.country END AS country, CASE WHEN country_id IS NOT NULL THEN 'kept' ELSE coalesce(l.state, l.region, l.county) END AS state,
 CASE WHEN country_id IS NULL THEN CASE WHEN l.country IS NULL THEN 'failed' ELSE 'updated' END END AS outcome FROM items i LEFT JOIN (SELECT {K}, 'Found' AS country, max(CASE WHEN item_id % 4 = 0 THEN 's' END) AS state,
 max(CASE WHEN item_id % 4 = 1 THEN 'r' END) AS region, max(CASE WHEN item_id % 4 < 3 THEN 'c' END) AS county FROM items WHERE item_id % 3 > 0 GROUP BY lat_key, lon_key) l ON country_id IS NULL AND lat_key = round(lat,3) AND lon_key = round(lon,3)""",
    ),
}
