"""Waypoint XML files: dialect detection and raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CGEO, POCKET_QUERY = "cgeo", "pocket_query"

# Elements read per waypoint; namespaces are ignored, attributes start with "_".
WAYPOINT_SCHEMA = (
    "_lat string, _lon string, time string, name string, desc string,"
    " cache struct<type:string, container:string, owner:string, difficulty:string, terrain:string,"
    " country:string, state:string, long_description:string,"
    " attributes:struct<attribute:array<struct<_id:string, _inc:string, _VALUE:string>>>,"
    " logs:struct<log:array<struct<date:string, type:string>>>>,"
    " wptExtension struct<UserFound:string, FavPoints:string, GcNote:string>,"
    " extensions struct<wptExtension:struct<UserFound:string, FavPoints:string, GcNote:string>>"
)


def _dialect(root: Column, says_cgeo: Column, says_pocket: Column) -> Column:
    """Dialect from the root tag and from words seen anywhere in the document."""

    def attribute(name: str) -> Column:
        return F.lower(F.regexp_extract(root, rf"(?s)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))

    creator, schema = attribute("creator"), attribute("schemaLocation")
    spaces = F.regexp_extract_all(root, F.lit(r"xmlns(?::\w+)?\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    ours = F.filter(spaces, lambda u: F.contains(u, F.lit("groundspeak.com/cache")))
    version = F.get(F.filter(ours, lambda u: F.contains(u, F.lit("1/0"))), F.lit(0))
    return (
        F.when(creator.contains("cgeo") | creator.contains("c:geo"), CGEO)
        .when(schema.contains("cgeo"), CGEO)
        .when(schema.contains("pocket query") | creator.contains("pocket query"), POCKET_QUERY)
        .when(version.contains("1/0/1"), CGEO)
        .when(version.isNotNull(), POCKET_QUERY)
        .when(says_cgeo, CGEO)
        .when(says_pocket, POCKET_QUERY)
        .otherwise(CGEO)
    )


def detect_dialect(text: Column) -> Column:
    """Dialect of a whole document: root creator, then schema location, then
    namespace version, then words anywhere in it; cgeo when nothing tells."""
    root = F.regexp_extract(text, r"(?s)<(?:\w+:)?gpx\b[^>]*>", 0)
    return _dialect(root, F.lower(text).contains("c:geo"), F.lower(text).contains("pocket query"))


def read_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, dialect), one row per file that holds anything, as ``detect_dialect`` of the whole file.

    No file is held as one string: files are split and read tag by tag, a record
    ending at every ``>``. A tag never crosses records, nor do the words looked
    for; the first root tag is the one with the least offset. Each task keeps
    one row a file. A root tag that the file breaks off counts as complete.
    """
    tags = spark.read.option("recursiveFileLookup", "true").text(path, lineSep=">").select(
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.regexp_extract("value", r"(?s)<(?:\w+:)?gpx\b[^>]*$", 0).alias("root"),
        F.lower("value").alias("words"),
    )
    seen = tags.groupBy("source_file").agg(
        F.min(F.when(F.col("root") != "", F.struct("place", "root")))["root"].alias("root"),
        F.max(F.col("words").contains("c:geo")).alias("says_cgeo"),
        F.max(F.col("words").contains("pocket query")).alias("says_pocket"),
    )
    return seen.select("source_file", _dialect(F.coalesce("root", F.lit("")), F.col("says_cgeo"), F.col("says_pocket")).alias("dialect"))


def _text(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def found_date(dialect: Column, user_found: Column, logs: Column, item_type: Column, time: Column) -> Column:
    """The find date as text.

    cgeo has its own tag. A pocket query has logs: a single one counts with its
    date, otherwise the latest whose type mentions "found"; an event without
    either counts at its own time.
    """

    def zulu(text: Column) -> Column:
        return F.when(text.endswith("Z"), text).otherwise(F.concat(text, F.lit("Z")))

    first = F.get(logs, F.lit(0))
    single = F.when(F.size(logs) == 1, zulu(_text(first["date"])))
    dated = F.filter(logs, lambda g: F.contains(F.lower(F.coalesce(g["type"], F.lit(""))), F.lit("found")) & _text(g["date"]).isNotNull())
    latest = F.array_max(F.transform(dated, lambda g: _text(g["date"])))
    event = F.when(F.contains(F.lower(F.coalesce(item_type, F.lit(""))), F.lit("event")), zulu(_text(time)))
    return F.when(dialect == CGEO, _text(user_found)).otherwise(F.coalesce(single, latest, event))


def read_waypoints(spark: SparkSession, path: str, dialect: str = "auto") -> DataFrame:
    """Raw text rows of every waypoint that has an item element.

    Files are parsed where they lie, in parallel; ``dialect`` other than a
    known name means detection per file.
    """
    rows = (
        spark.read.format("xml").option("rowTag", "wpt").option("ignoreNamespace", "true")
        .option("recursiveFileLookup", "true").schema(WAYPOINT_SCHEMA).load(path)
        .where("cache IS NOT NULL")
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    if dialect in (CGEO, POCKET_QUERY):
        rows = rows.withColumn("dialect", F.lit(dialect))
    else:
        rows = rows.join(read_dialects(spark, path), "source_file")
    cgeo = F.col("dialect") == CGEO

    def extension(name: str) -> Column:
        return F.coalesce(F.col(f"wptExtension.{name}"), F.col(f"extensions.wptExtension.{name}"))

    attributes = F.transform(
        F.coalesce("cache.attributes.attribute", F.expr("CAST(array() AS array<struct<_id:string,_inc:string,_VALUE:string>>)")),
        lambda a: F.struct(
            a["_id"].try_cast("int").alias("attr_id"), (a["_inc"] == "1").alias("is_positive"),
            F.coalesce(_text(a["_VALUE"]), F.lit("")).alias("name"),
        ),
    )
    logs = F.coalesce("cache.logs.log", F.expr("CAST(array() AS array<struct<date:string,type:string>>)"))
    return rows.select(
        _text(F.col("name")).alias("code"),
        _text(F.col("desc")).alias("title"),
        F.col("_lat").alias("latitude"),
        F.col("_lon").alias("longitude"),
        *[_text(F.col(f"cache.{src}")).alias(name) for src, name in (
            ("type", "type"), ("container", "size"), ("owner", "owner"), ("difficulty", "difficulty"), ("terrain", "terrain"),
            ("country", "country"), ("state", "state"), ("long_description", "description"),
        )],
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("status"),
        _text(F.col("time")).alias("placed_date"),
        F.when(cgeo, F.coalesce(_text(extension("FavPoints")), F.lit("0"))).otherwise("0").alias("favorites"),
        F.when(cgeo, _text(extension("GcNote"))).alias("notes"),
        found_date(F.col("dialect"), extension("UserFound"), logs, F.col("cache.type"), F.col("time")).alias("found_date"),
        attributes.alias("attributes"),
        "dialect",
        "source_file",
    )
