"""Dimension tables: resolving names to ids, extending and auditing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnwise.functions import normalise as n


def alias_table(
    types: DataFrame, sizes: DataFrame, countries: DataFrame, states: DataFrame, attributes: DataFrame
) -> DataFrame:
    """All lookup keys in one table: (kind, field, key, scope, id, candidates).

    ``scope`` is the country of a state. ``candidates`` counts the ids sharing
    a key, so an ambiguous name shows as more than one.
    """

    def rows(df: DataFrame, kind: str, field: str, key, ident, scope=None):
        return df.select(
            F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lower(key).alias("key"),
            (F.lit(None) if scope is None else scope).cast("string").alias("scope"), ident.cast("string").alias("id"),
        ).where("key IS NOT NULL AND key <> ''")

    parts = [
        rows(types, "type", "code", F.col("type_code"), F.col("type_code")),
        rows(types, "type", "name", F.col("name"), F.col("type_code")),
        rows(sizes, "size", "code", F.col("size_code"), F.col("size_code")),
        rows(sizes, "size", "name", F.col("name"), F.col("size_code")),
        rows(countries, "country", "name", F.col("name"), F.col("country_id")),
        rows(states, "state", "name", F.col("name"), F.col("state_id"), F.col("country_id")),
        rows(states, "state", "name", F.col("name"), F.col("state_id")),
        rows(attributes, "attribute", "code", F.col("code"), F.col("attr_id")),
        rows(attributes, "attribute", "name", F.col("name"), F.col("attr_id")),
    ]
    if "aliases" in sizes.columns:
        parts.append(rows(sizes.withColumn("alias", F.explode("aliases")), "size", "alias", F.col("alias"), F.col("size_code")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.groupBy("kind", "field", "key", "scope").agg(
        F.max("id").alias("id"), F.countDistinct("id").alias("candidates")
    )


def resolve(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``id`` and ``error`` to (kind, field, value, scope) requests.

    A state asked for without its country must be the only one of that name.
    """
    asked = requests.withColumn("key", F.lower("value"))
    hit = table.withColumnsRenamed({"kind": "t_kind", "field": "t_field", "key": "t_key", "scope": "t_scope"})
    match = (
        (F.col("kind") == F.col("t_kind")) & (F.col("field") == F.col("t_field")) & (F.col("key") == F.col("t_key"))
        & (F.coalesce("scope", F.lit("")) == F.coalesce("t_scope", F.lit("")))
    )
    joined = asked.join(hit, match, "left")
    ambiguous = (F.col("kind") == "state") & (F.col("candidates") > 1)
    error = F.when(F.col("candidates").isNull(), "not found").when(ambiguous, "ambiguous")
    return joined.select(*requests.columns, F.when(error.isNull(), F.col("id")).alias("id"), error.alias("error"))


def check_ids(references: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Distinct referenced ids with whether they exist."""
    known = table.select(key).distinct().withColumn("exists", F.lit(True))
    return references.where(F.col(key).isNotNull()).select(key).distinct().join(known, key, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def new_ids(names: DataFrame, key: str, existing: DataFrame, ident: str) -> DataFrame:
    """Adds consecutive ids after the largest existing one, of its type, without one big sort.

    Names are bucketed by hash; bucket counts give offsets, ranks are taken
    within a bucket.
    """
    bucket = F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")
    rows = names.withColumn("_bucket", bucket)
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 4096 rows
    offsets = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    top = existing.groupBy().agg(F.coalesce(F.max(ident), F.lit(0))).scalar()
    inside = W.partitionBy("_bucket").orderBy(key)
    return (
        rows.withColumn("_rn", F.row_number().over(inside)).join(offsets.drop("_n"), "_bucket").withColumn("_top", top)
        .withColumn(ident, (F.col("_top") + F.col("_offset") + F.col("_rn")).cast(existing.schema[ident].dataType))
        .drop("_bucket", "_offset", "_rn", "_top")
    )


def missing_countries(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries named in ``rows`` that no country row matches, with new ids."""
    named = rows.where(F.coalesce("country", F.lit("")) != "").select("country", n.plain_name_key(F.col("country")).alias("key"))
    firsts = named.groupBy("key").agg(F.min("country").alias("name"))
    known = countries.select(n.plain_name_key(F.col("name")).alias("key")).distinct()
    return new_ids(firsts.join(known, "key", "left_anti"), "key", countries, "country_id").select("country_id", "name")


def missing_states(rows: DataFrame, countries: DataFrame, states: DataFrame) -> DataFrame:
    """(country, state) pairs named in ``rows`` without a state row, with new ids.

    ``countries`` must already contain the new countries.
    """
    placed = with_country(rows.where(F.coalesce("state", F.lit("")) != ""), countries).where("country_id IS NOT NULL")
    named = placed.select("country_id", "state", n.plain_name_key(F.col("state")).alias("key"))
    firsts = named.groupBy("country_id", "key").agg(F.min("state").alias("name"))
    known = states.select("country_id", n.plain_name_key(F.col("name")).alias("key")).distinct()
    fresh = firsts.join(known, ["country_id", "key"], "left_anti").withColumn(
        "pair", F.concat_ws(":", F.col("country_id").cast("string"), "key")
    )
    return new_ids(fresh, "pair", states, "state_id").select("state_id", "name", "country_id")


def with_country(rows: DataFrame, countries: DataFrame) -> DataFrame:
    key = n.plain_name_key(F.col("name"))
    dim = countries.groupBy(key.alias("country_key")).agg(F.max("country_id").alias("country_id"))
    return rows.withColumn("country_key", n.plain_name_key(F.col("country"))).join(dim, "country_key", "left").drop("country_key")


def map_referentials(
    rows: DataFrame, types: DataFrame, sizes: DataFrame, countries: DataFrame, states: DataFrame, attributes: DataFrame
) -> DataFrame:
    """Names to ids: country and state, type, size by normalised name; attributes
    by number, unknown ones dropped, a missing sign counting as positive."""
    out = with_country(rows, countries)
    state_dim = states.groupBy("country_id", n.plain_name_key(F.col("name")).alias("state_key")).agg(F.max("state_id").alias("state_id"))
    out = out.withColumn("state_key", n.plain_name_key(F.col("state"))).join(state_dim, ["country_id", "state_key"], "left").drop("state_key")
    for dim, key, text in ((types, "type_code", "type"), (sizes, "size_code", "size")):
        named = dim.groupBy(n.plain_name_key(F.col("name")).alias("name_key")).agg(F.max(key).alias(key))
        out = out.withColumn("name_key", n.plain_name_key(F.col(text))).join(named, "name_key", "left").drop("name_key")
    known = attributes.groupBy().agg(F.collect_set("attr_id")).scalar()
    kept = F.transform(
        F.filter("attributes", lambda a: F.array_contains("_known", a["attr_id"])),
        lambda a: F.struct(a["attr_id"].alias("attr_id"), F.coalesce(a["is_positive"], F.lit(True)).alias("is_positive")),
    )
    return out.withColumn("_known", known).withColumn("attributes", kept).drop("_known")


def upsert_dimension(existing: DataFrame, incoming: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """The dimension after loading ``incoming``: ``change`` is inserted, updated,
    same or kept; ``replace`` drops rows that are not in the load."""
    payload = [c for c in incoming.columns if c != key]
    old = existing.select(key, F.struct(*payload).alias("old"))
    new = incoming.groupBy(key).agg(F.max(F.struct(*payload)).alias("new"))  # of rows that share a key the largest counts
    change = (
        F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept")
        .when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("updated")
    )
    merged = old.join(new, key, "right" if replace else "full").withColumn("change", change)
    return merged.withColumn("row", F.coalesce("new", "old")).select(key, "row.*", "change")


def duplicates(table: DataFrame, ident: str, name: str, scope: str | None = None) -> DataFrame:
    """Groups of two or more rows whose normalised name (within ``scope``) agrees."""
    keys = [n.plain_name_key(F.col(name)).alias("normalized")] + ([F.col(scope)] if scope else [])
    return table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.array_join(F.sort_array(F.collect_list(F.col(ident).cast("long"))), ",").alias("ids")
    ).where(F.col("entries") > 1)
