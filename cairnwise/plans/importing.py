"""One import as one job: raw rows in, new table versions and counters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnwise.operators import ingest, merge, referentials
from cairnwise.operators.zones import assign_zones
from cairnwise.session import materialise
from cairnwise.sources.versions import Versions

ITEM_FIELDS = [
    "code", "title", "description", "url", "owner", "type_code", "size_code", "country_id", "state_id", "lat", "lon",
    "elevation", "difficulty", "terrain", "favorites", "status", "placed_at", "attributes",
]


# A batch is dealt in as many parts as it has this many rows, however few files it comes in.
ROWS_PER_PARTITION = 20_000


@dataclass
class Dimensions:
    types: DataFrame
    sizes: DataFrame
    countries: DataFrame
    states: DataFrame
    attributes: DataFrame


@dataclass
class ImportResult:
    items: DataFrame
    finds: DataFrame
    quarantine: DataFrame
    countries: DataFrame
    states: DataFrame
    accepted: DataFrame
    counters: DataFrame


def _written(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written once, and metrics taken while it was written."""
    seen = Observation()
    kept = materialise(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), label)
    return kept, seen.get


def _changes(kind: str) -> Column:
    return F.count_if(F.col("change") == kind)


def _with_zones(mapped: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows with ``zone_level1`` and ``zone_level2`` of their place; each code is placed once, where its last row lies."""
    last = mapped.groupBy("code").agg(F.max_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull(), F.col("ord"))).alias("p"))
    points = last.select(F.col("code").alias("item_id"), "p.lat", "p.lon")
    placed = assign_zones(points, zones).select(
        F.col("item_id").alias("code"), F.col("level1").alias("zone_level1"), F.col("level2").alias("zone_level2")
    )
    return mapped.join(placed, "code", "left")


def conform(raw: DataFrame, as_of: str, mode: str = "both", strict: bool = False) -> DataFrame:
    """Raw rows with typed fields and ``reject_reason``; every row is kept."""
    rows = ingest.find_record(ingest.item_record(raw))
    wanted = ingest.import_mode_filter(mode)
    checked = ingest.validate_item(rows.withColumn("wanted", wanted), as_of, strict)
    has_find = F.col("found_at").isNotNull()
    reason = F.coalesce(
        F.when(F.col("code").isNull(), "no code"),
        F.when(~F.col("wanted"), "outside import mode"),
        F.col("reject_reason"),
        F.when(has_find, ingest.find_reason(as_of, strict)),
        ingest.consistency_reason(mode),
    )
    return checked.withColumn("reject_reason", reason).withColumn("notes", F.substring("notes", 1, ingest.MAX_NOTES)).drop("wanted")


def import_rows(
    raw: DataFrame, items: DataFrame, finds: DataFrame, dims: Dimensions, as_of: str, mode: str = "both",
    zones: DataFrame | None = None, elevation: DataFrame | None = None, places: DataFrame | None = None, strict: bool = False,
) -> ImportResult:
    """Conform, map, enrich and merge a batch.

    ``raw`` carries ``user_id`` (whose import it is), ``source_file`` and
    ``ord`` (later rows win). Accepted and rejected rows come from one pass
    that is written to the shared folder, since several outputs read it. New
    items get ids after the largest existing one. With ``zones`` rows get the
    zones of their place before they are merged, so that items carry them as
    ``zone_level1`` and ``zone_level2`` (an ``items`` table without these
    columns gets them); an unplaced row leaves an item's zones alone.
    Counters are observed while the tables are written. The batch is dealt
    anew first, so a batch in one small file is not the work of one task.
    """
    if mode not in ("all", "found", "both"):
        raise ValueError(f"invalid import mode {mode!r}")
    if zones is not None:
        for name in ("zone_level1", "zone_level2"):
            if name not in items.columns:
                items = items.withColumn(name, F.lit(None).cast("string"))
    raw = raw.repartition(max(1, -(-raw.count() // ROWS_PER_PARTITION)))
    good_row = F.col("reject_reason").isNull()
    rows, seen = _written(conform(raw, as_of, mode, strict), "conformed", good=F.count_if(good_row), bad=F.count_if(~good_row))
    quarantine = rows.where("reject_reason IS NOT NULL")
    good = rows.where("reject_reason IS NULL")
    if places is not None:
        good = ingest.enrich_country_state(good, places).drop("outcome")
    new_countries, n_countries = _written(referentials.missing_countries(good, dims.countries), "new-countries", n=F.count(F.lit(1)))
    countries = dims.countries.unionByName(new_countries)
    new_states, n_states = _written(referentials.missing_states(good, countries, dims.states), "new-states", n=F.count(F.lit(1)))
    states = dims.states.unionByName(new_states)
    mapped = referentials.map_referentials(good, dims.types, dims.sizes, countries, states, dims.attributes)
    mapped = mapped.withColumns({"placed_at": F.col("placed_at").cast("date"), "elevation": F.lit(None).cast("int")})
    if elevation is not None:
        mapped = ingest.enrich_elevation(mapped, elevation).drop("outcome")
    mapped = materialise(mapped, "mapped")
    placing = []
    if zones is not None:
        mapped, placing = materialise(_with_zones(mapped, zones), "placed"), ["zone_level1", "zone_level2"]
    merged = merge.upsert(items, mapped.select(*ITEM_FIELDS, *placing, "ord"), ["code"], "ord")
    known = merged.where("item_id IS NOT NULL")
    fresh = referentials.new_ids(merged.where("item_id IS NULL").drop("item_id"), "code", items, "item_id")
    new_items, n_items = _written(
        known.unionByName(fresh.withColumn("item_id", F.col("item_id").cast("long"))), "merged-items",
        inserted=_changes("inserted"), updated=_changes("updated"),
    )
    batch = mapped.where("found_at IS NOT NULL").select(
        "user_id", "code", F.col("found_at").cast("date").alias("found_date"), "notes", F.col("notes").isNotNull().alias("notes_present"), "ord"
    )
    if mode == "all":
        batch = batch.where(F.lit(False))
    new_finds, n_finds = _written(
        merge.upsert_finds(finds, batch, new_items), "merged-finds", inserted=_changes("inserted"), updated=_changes("updated")
    )
    counters = rows.groupBy().agg(F.countDistinct("source_file").alias("nb_files")).withColumns(
        {
            name: F.lit(value).cast("bigint")
            for name, value in {
                "nb_total_items": seen["good"],
                "nb_discarded_items": seen["bad"],
                "nb_inserted_items": n_items["inserted"],
                "nb_existing_items": n_items["updated"],
                "nb_inserted_finds": n_finds["inserted"],
                "nb_updated_finds": n_finds["updated"],
                "nb_new_countries": n_countries["n"],
                "nb_new_states": n_states["n"],
            }.items()
        }
    )
    return ImportResult(new_items, new_finds, quarantine, countries, states, rows.where("reject_reason IS NULL"), counters)


def import_job(
    tables: Versions, raw: DataFrame, types: DataFrame, sizes: DataFrame, attributes: DataFrame, as_of: str, mode: str = "both",
    zones: DataFrame | None = None, elevation: DataFrame | None = None, places: DataFrame | None = None, strict: bool = False,
) -> ImportResult:
    """A whole import: reads the newest tables, merges the batch, publishes all that changed as one version.

    ``tables`` holds items, finds, countries, states and users. Rejected rows
    are appended to ``quarantine`` and the counters to ``imports``, with the
    date of the import. Users who imported more items than finds get
    ``last_import_at``. A run that ends before its commit changes nothing.
    """
    dims = Dimensions(types, sizes, tables.read("countries"), tables.read("states"), attributes)
    result = import_rows(raw, tables.read("items"), tables.read("finds"), dims, as_of, mode, zones, elevation, places, strict)
    stamped = lambda df: df.withColumn("imported_on", F.lit(as_of).cast("date"))
    rejected = result.quarantine.select("user_id", "source_file", "ord", "code", "reject_reason")
    tables.commit(
        {
            "items": result.items.drop("change"),
            "finds": result.finds.drop("change"),
            "countries": result.countries,
            "states": result.states,
            "users": unfound_imports(tables.read("users"), result.accepted, as_of),
        },
        {"quarantine": stamped(rejected), "imports": stamped(result.counters)},
    )
    return result


def unfound_imports(users: DataFrame, accepted: DataFrame, as_of: str) -> DataFrame:
    """Users with ``last_import_at`` set when they imported more items than finds."""
    imported = accepted.groupBy("user_id").agg((F.count(F.lit(1)) - F.count("found_at")).alias("unfound"))
    marked = users.join(imported, "user_id", "left")
    return marked.withColumn(
        "last_import_at", F.when(F.col("unfound") > 0, F.lit(as_of).cast("date")).otherwise(F.col("last_import_at"))
    ).drop("unfound")
