"""Assigning points to administrative zones, and statistics per zone.

Points and zones are cut along one quadtree-like grid: cells of half a degree,
and where points crowd, cells a quarter as wide, down to about fifty metres.
Zones have one row per cell with only the edges that matter there, or none
where the cell lies wholly inside. A point meets its cell in an equi join, so
no point is compared with a zone elsewhere and a polygon of many vertices is
never scanned whole. No cell holds more than a bounded share of the points:
a place too crowded even for the smallest cells is spread over salts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnwise.functions import polygons
from cairnwise.session import materialise

# Fixed value: how far (degrees) a point may lie outside its nearest zone.
NEAREST_LIMIT_DEG = 0.1
CELL_DEG = 0.5
#: Salts of the ring search, whose points are few.
SALTS = 8
#: A crowded cell is cut into FANOUT x FANOUT; powers of two keep the borders of parents and children equal.
FANOUT = 4
DEEPEST = 5
#: A cell is crowded beyond this many points, or beyond its share of all points if that is more.
CELL_POINTS = 50_000
CROWDED_SHARE = 10_000
DETAIL_LIMIT = 10
#: Beyond this distance (degrees) every zone on a map of the earth has been seen.
FARTHEST_DEG = 1024.0


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _strips(zones: DataFrame, size: float, margin: float) -> DataFrame:
    """(level, code, cy, strip): the edges of each zone within ``margin`` of each row of cells.

    Edges travel one by one, so no task copies a whole polygon to every cell.
    """
    edge = zones.select("level", "code", F.explode(polygons.edges(F.col("rings"))).alias("e"))
    rows = F.sequence(
        _cell(F.least("e.y1", "e.y2") - margin, size), _cell(F.greatest("e.y1", "e.y2") + margin, size)
    )
    return edge.withColumn("cy", F.explode(rows)).groupBy("level", "code", "cy").agg(F.collect_list("e").alias("strip"))


def _mattering(edges: str, cx: Column, cy: Column, size: float, margin: float) -> Column:
    """With no margin, the edges a ray to the east can meet from inside the
    cell; with a margin, those within the margin of the cell."""
    west, south = cx * size, cy * size

    def matters(e: Column) -> Column:
        north_side = F.greatest(e["y1"], e["y2"]) >= south - margin
        south_side = F.least(e["y1"], e["y2"]) <= south + size + margin
        east_side = F.greatest(e["x1"], e["x2"]) >= west - margin
        keep = north_side & south_side & east_side
        return keep & (F.least(e["x1"], e["x2"]) <= west + size + margin) if margin else keep

    return F.filter(edges, matters)


def zone_cells(zones: DataFrame, size: float, margin: float) -> DataFrame:
    """(level, code, cx, cy, edges) for every cell of the plain grid that an edge
    matters in (see ``_mattering``)."""

    def reach(pick, end: Column) -> Column:
        return pick(F.transform("strip", lambda e: end(e["x1"], e["x2"])))

    west = _cell(reach(F.array_min, F.least) - margin, size)
    east = _cell(reach(F.array_max, F.greatest) + margin, size)
    return (
        _strips(zones, size, margin)
        .withColumn("cx", F.explode(F.sequence(west, east)))
        .select("level", "code", "cx", "cy", _mattering("strip", F.col("cx"), F.col("cy"), size, margin).alias("edges"))
        .where(F.size("edges") > 0)
    )


@dataclass(frozen=True)
class CellTree:
    """Crowded cells (cx, cy, points) by depth; what is crowded at the last depth is salted, not cut.

    A depth holds at most ``CROWDED_SHARE`` cells, since each holds more than
    that share of all points; so the driver may list and broadcast them.
    """

    spark: SparkSession
    crowded: list[list[tuple[int, int, int]]]
    size: float
    limit: int
    deepest: int

    def width(self, depth: int) -> float:
        return self.size / FANOUT**depth

    def marks(self, depth: int) -> DataFrame:
        rows = [(depth, x, y, -(-n // self.limit)) for x, y, n in self.crowded[depth]]
        return F.broadcast(self.spark.createDataFrame(rows, "depth int, cx int, cy int, parts long"))


def cell_tree(points: DataFrame, size: float = CELL_DEG, limit: int = CELL_POINTS, deepest: int = DEEPEST) -> CellTree:
    """Counts points per cell and, depth by depth, inside the cells found crowded."""
    located = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon")
    spark, crowded = points.sparkSession, []
    whole = materialise(_cell_counts(located, size), "cell-counts")
    total = whole.agg(F.sum("n")).first()[0] or 0
    tree = CellTree(spark, crowded, size, max(limit, -(-total // CROWDED_SHARE)), deepest)
    counts = whole
    for depth in range(deepest + 1):
        found = [tuple(r) for r in counts.where(F.col("n") > tree.limit).select("cx", "cy", "n").collect()]
        if not found:
            break
        crowded.append(found)
        inside = F.broadcast(tree.marks(depth).select("cx", "cy"))
        located = located.withColumns(
            {"cx": _cell(F.col("lon"), tree.width(depth)), "cy": _cell(F.col("lat"), tree.width(depth))}
        ).join(inside, ["cx", "cy"], "left_semi").select("lat", "lon")
        counts = _cell_counts(located, tree.width(depth + 1))
    return tree


def _cell_counts(located: DataFrame, width: float) -> DataFrame:
    return located.groupBy(_cell(F.col("lon"), width).alias("cx"), _cell(F.col("lat"), width).alias("cy")).agg(
        F.count(F.lit(1)).alias("n")
    )


def leaf_points(points: DataFrame, tree: CellTree) -> DataFrame:
    """(item_id, lat, lon, depth, cx, cy, salt): every located point with its cell."""
    out = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "item_id", "lat", "lon", F.lit(0).alias("depth"),
        _cell(F.col("lon"), tree.size).alias("cx"), _cell(F.col("lat"), tree.size).alias("cy"), F.lit(0).alias("salt"),
    )
    for depth in range(len(tree.crowded)):
        out = out.join(tree.marks(depth), ["depth", "cx", "cy"], "left")
        crowded = F.col("parts").isNotNull()
        if depth == tree.deepest:
            salt = F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
            out = out.withColumn("salt", F.when(crowded, salt).otherwise(0))
        else:
            width = tree.width(depth + 1)
            out = out.withColumns({
                "depth": F.when(crowded, depth + 1).otherwise(F.col("depth")),
                "cx": F.when(crowded, _cell(F.col("lon"), width)).otherwise(F.col("cx")),
                "cy": F.when(crowded, _cell(F.col("lat"), width)).otherwise(F.col("cy")),
            })
        out = out.drop("parts")
    return out


def leaf_cells(zones: DataFrame, tree: CellTree, margin: float) -> DataFrame:
    """(level, code, depth, cx, cy, salt, edges, whole): the zones in every cell of the tree.

    ``whole`` cells lie inside the zone and carry no edges; they occur only
    without a margin.
    """
    out = zone_cells(zones, tree.size, margin).withColumns({"depth": F.lit(0), "salt": F.lit(0)})
    for depth in range(len(tree.crowded)):
        out = out.join(tree.marks(depth), ["depth", "cx", "cy"], "left")
        crowded = F.col("parts").isNotNull()
        if depth == tree.deepest:
            last = F.when(crowded, F.col("parts") - 1).otherwise(0).cast("int")
            out = out.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
        else:
            def cut(axis: str) -> Column:
                first = F.col(axis) * FANOUT
                return F.explode(F.when(crowded, F.sequence(first, first + FANOUT - 1)).otherwise(F.array(axis)))

            kept = _mattering("edges", F.col("cx"), F.col("cy"), tree.width(depth + 1), margin)
            out = (
                out.withColumn("cx", cut("cx")).withColumn("cy", cut("cy"))
                .withColumn("edges", F.when(crowded, kept).otherwise(F.col("edges")))
                .withColumn("depth", F.when(crowded, depth + 1).otherwise(F.col("depth")))
                .where(F.size("edges") > 0)
            )
        out = out.drop("parts")
    if margin:
        return out.withColumn("whole", F.lit(False))
    width = F.lit(tree.size) / F.pow(F.lit(float(FANOUT)), F.col("depth"))
    west, south = F.col("cx") * width, F.col("cy") * width
    touched = F.exists("edges", lambda e: polygons.may_touch_box(e, west, south, west + width, south + width))
    inside = polygons.strictly_inside(west + width / 2, south + width / 2, F.col("edges"))
    place = F.when(touched, "border").when(inside, "whole").otherwise("outside")
    return (
        out.withColumn("place", place)
        .where("place <> 'outside'")
        .withColumn("whole", F.col("place") == "whole")
        .withColumn("edges", F.when(F.col("whole"), F.slice("edges", 1, 0)).otherwise(F.col("edges")))
        .drop("place")
    )


def _meet(points: DataFrame, zones: DataFrame, margin: float, tree: CellTree | None) -> DataFrame:
    tree = tree or cell_tree(points)
    return leaf_points(points, tree).join(leaf_cells(zones, tree, margin), ["depth", "cx", "cy", "salt"])


def containing_zones(points: DataFrame, zones: DataFrame, tree: CellTree | None = None) -> DataFrame:
    """(item_id, level1, level2): the zone strictly containing each point.

    Points in no zone have no row; of overlapping zones the lowest code wins.
    ``tree`` is made of the points unless given (see ``cell_tree``).
    """
    hits = _meet(points, zones, 0.0, tree).where(
        F.col("whole") | polygons.strictly_inside(F.col("lon"), F.col("lat"), F.col("edges"))
    )
    return hits.groupBy("item_id").agg(
        F.min(F.when(F.col("level") == 1, F.col("code"))).alias("level1"),
        F.min(F.when(F.col("level") == 2, F.col("code"))).alias("level2"),
    )


def nearest_zones(
    points: DataFrame, zones: DataFrame, limit: float = NEAREST_LIMIT_DEG, tree: CellTree | None = None
) -> DataFrame:
    """(item_id, level1, level2): the zone whose border is nearest, within ``limit`` degrees."""
    distance = polygons.edge_distance(F.col("lon"), F.col("lat"), F.col("edges"))
    near = _meet(points, zones, limit, tree).withColumn("distance", distance).where(F.col("distance") <= limit)

    def best(level: int) -> Column:
        return F.min(F.when(F.col("level") == level, F.struct("distance", "code")))["code"]

    return near.groupBy("item_id").agg(best(1).alias("level1"), best(2).alias("level2"))


def assign_exact(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Every point with its containing zones (null where none)."""
    return points.select("item_id").join(containing_zones(points, zones), "item_id", "left")


def assign_nearest(points: DataFrame, zones: DataFrame, limit: float = NEAREST_LIMIT_DEG) -> DataFrame:
    """Containing zone per level, else the nearest within the limit."""
    tree = cell_tree(points)
    near = nearest_zones(points, zones, limit, tree).withColumnsRenamed({"level1": "near1", "level2": "near2"})
    return (
        points.select("item_id")
        .join(containing_zones(points, zones, tree), "item_id", "left")
        .join(near, "item_id", "left")
        .select("item_id", F.coalesce("level1", "near1").alias("level1"), F.coalesce("level2", "near2").alias("level2"))
    )


def assign_zones(
    points: DataFrame, zones: DataFrame, lookup: DataFrame | None = None, country: str = "XX", force: bool = True
) -> DataFrame:
    """Three passes: containment on both levels, a lookup table, the nearest zone.

    ``lookup`` holds ``lat_key, lon_key`` (three decimals), ``level2`` (or
    null) and ``country``; its parent gives level 1. A point the lookup places
    in another country gets no zone. With ``force=False`` points that already
    carry ``level2`` keep it and are not looked at again.
    """
    existing = None
    if not force:
        existing = points.where("level2 IS NOT NULL").select("item_id", "level1", "level2", F.lit("kept").alias("via"))
        points = points.where("level2 IS NULL")
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("item_id", "lat", "lon")
    tree = cell_tree(placed)
    exact = placed.join(containing_zones(placed, zones, tree), "item_id", "left")
    both = F.col("level1").isNotNull() & F.col("level2").isNotNull()
    if lookup is None:
        found = exact.withColumns({"l1": F.lit(None).cast("string"), "l2": F.lit(None).cast("string"), "foreign": F.lit(False)})
    else:
        parents = zones.where("level = 2").select(F.col("code").alias("l2"), F.col("parent_code").alias("l1"))
        one = lookup.groupBy("lat_key", "lon_key").agg(F.max(F.struct("level2", "country")).alias("place"))
        table = one.select(
            "lat_key", "lon_key", F.col("place.level2").alias("l2"), (F.col("place.country") != country).alias("foreign")
        ).join(parents, "l2", "left")
        keys = [F.round("lat", 3).alias("lat_key"), F.round("lon", 3).alias("lon_key")]
        found = (
            exact.select("*", *keys)
            .join(table, ["lat_key", "lon_key"], "left")
            .withColumn("foreign", F.coalesce("foreign", F.lit(False)))
        )
    open_points = found.where(~both & F.col("l2").isNull() & ~F.col("foreign"))
    near = nearest_zones(open_points, zones, tree=tree).withColumnsRenamed({"level1": "n1", "level2": "n2"})
    out = found.join(near, "item_id", "left")
    via = (
        F.when(both, "exact")
        .when(F.col("l2").isNotNull(), "lookup")
        .when(F.col("foreign"), "foreign")
        .otherwise("nearest")
    )

    def pick(exact_col: str, lookup_col: str, near_col: str) -> Column:
        return (
            F.when(via == "exact", F.col(exact_col))
            .when(via == "lookup", F.col(lookup_col))
            .when(via == "nearest", F.coalesce(exact_col, near_col))
        )

    result = out.select("item_id", pick("level1", "l1", "n1").alias("level1"), pick("level2", "l2", "n2").alias("level2"), via.alias("via"))
    return result if existing is None else result.unionByName(existing)


def nearest_by_rings(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(item_id, near): the nearest zone of each point's country, however far.

    Rings grow by doubling: in each round points meet the zones of their cell,
    which carries all edges within one cell's width. A zone found within that
    width is the nearest, since unseen ones are farther; the other points go on
    to the next, wider grid. ``points`` holds item_id, country, lat, lon; of
    zones equally near the lowest code wins. Points of a country without zones
    have no row.
    """
    owners = zones.select("code", F.col("country").alias("zone_country"))
    open_points = materialise(points.join(zones.select("country").distinct(), "country", "left_semi"), "open-points")
    distance = polygons.edge_distance(F.col("lon"), F.col("lat"), F.col("edges"))
    width, done = CELL_DEG, None
    while width <= FARTHEST_DEG and not open_points.isEmpty():
        cells = zone_cells(zones, width, width).join(owners, "code")
        located = open_points.select(
            "item_id", "country", "lat", "lon", _cell(F.col("lon"), width).alias("cx"), _cell(F.col("lat"), width).alias("cy"),
            F.pmod(F.hash("item_id"), F.lit(SALTS)).alias("salt"),
        )
        spread = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("zone_country", "country")
        near = located.join(spread, ["country", "cx", "cy", "salt"]).withColumn("d", distance).where(F.col("d") <= width)
        found = materialise(near.groupBy("item_id").agg(F.min(F.struct("d", "code"))["code"].alias("near")), "nearest")
        done = found if done is None else done.unionByName(found)
        open_points = materialise(open_points.join(found, "item_id", "left_anti"), "open-points")
        width *= 2
    return points.select("item_id", F.lit(None).cast("string").alias("near")).where(F.lit(False)) if done is None else done


def zone_parents(zones: DataFrame) -> DataFrame:
    """(code, parent_code) of level-2 zones: the level-1 zone around the
    centroid, else the nearest level-1 zone of the same country."""
    children = polygons.centroid(zones.where("level = 2"), "rings", "lon", "lat").select(
        F.col("code").alias("item_id"), "country", "lon", "lat"
    )
    level1 = zones.where("level = 1")
    around = containing_zones(children, level1).select("item_id", "level1")
    placed = materialise(children.join(around, "item_id", "left"), "children")
    nearest = nearest_by_rings(placed.where("level1 IS NULL").select("item_id", "country", "lat", "lon"), level1)
    return placed.join(nearest, "item_id", "left").select(
        F.col("item_id").alias("code"), F.coalesce("level1", "near").alias("parent_code")
    )


# -- statistics ---------------------------------------------------------------


def zoned_finds(finds: DataFrame, items: DataFrame, item_zones: DataFrame, columns: list[str]) -> DataFrame:
    """Finds with ``level1, level2`` and the given item columns."""
    zoned = items.select("item_id", *columns).join(item_zones.select("item_id", "level1", "level2"), "item_id")
    return finds.join(zoned, "item_id")


def zone_counts(zoned: DataFrame, zones: DataFrame, level: int, country: str, type_keys: DataFrame | None = None) -> DataFrame:
    """Finds per user and zone of a level; zones without finds are left out."""
    if type_keys is not None:
        zoned = zoned.join(type_keys, "type_code", "left_semi")
    counts = (
        zoned.where(F.col(f"level{level}").isNotNull())
        .groupBy("user_id", F.col(f"level{level}").alias("code"))
        .agg(F.count(F.lit(1)).alias("finds"))
    )
    names = zones.where((F.col("level") == level) & (F.col("country") == country)).select("code", "name")
    return counts.join(names, "code").select("user_id", "code", "name", "finds")


def chosen_levels(zones: DataFrame, level: int | None = None) -> DataFrame:
    """One row per zone code: the hinted level, else 2 before 1."""
    rows = zones if level is None else zones.where(F.col("level") == level)
    return rows.groupBy("code").agg(
        F.max("level").alias("level"), F.max_by("name", "level").alias("name")
    )


def _in_zone(zoned: DataFrame, zones: DataFrame, level: int | None) -> DataFrame:
    per_level = zoned.withColumn(
        "z",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(1).alias("level"), F.col("level1").alias("code")),
                    F.struct(F.lit(2).alias("level"), F.col("level2").alias("code")),
                ),
                lambda z: z["code"].isNotNull(),
            )
        ),
    ).select("*", "z.level", "z.code").drop("z", "level1", "level2")
    return per_level.join(chosen_levels(zones, level).withColumnRenamed("name", "zone_name"), ["code", "level"])


def zone_detail(
    zoned: DataFrame, zones: DataFrame, level: int | None = None, type_keys: DataFrame | None = None
) -> DataFrame:
    """Find count per user and zone with the first ten finds by item code.

    ``zoned`` must carry ``item_code, title, type_code, difficulty, terrain``.
    The rank filter is applied before the shuffle as well, so a busy zone sends
    ten rows per task.
    """
    if type_keys is not None:
        zoned = zoned.join(type_keys, "type_code", "left_semi")
    rows = _in_zone(zoned, zones, level)
    counts = rows.groupBy("user_id", "code", "zone_name").agg(F.count(F.lit(1)).alias("finds"))
    order = W.partitionBy("user_id", "code").orderBy("item_code")
    first = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= DETAIL_LIMIT)
    return first.drop("zone_name").join(counts, ["user_id", "code"])


def zone_type_stats(zoned: DataFrame, zones: DataFrame, types: DataFrame, level: int | None = None) -> DataFrame:
    """Finds per user, zone and type, zero rows included, in the types' sort order."""
    counts = _in_zone(zoned, zones, level).groupBy("user_id", "code", "zone_name", "type_code").agg(
        F.count(F.lit(1)).alias("finds")
    )
    per_zone = counts.groupBy("user_id", "code", "zone_name").agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("type_code", "finds")), lambda e: e["type_code"].isNotNull())).alias("by_type")
    )
    ordered = F.array_sort(
        F.collect_list(F.struct(F.coalesce("sort_order", F.lit(999)).alias("sort_order"), "type_code", "name"))
    )
    spine = types.groupBy().agg(ordered).scalar()
    return (
        per_zone.withColumn("spine", spine)
        .select("user_id", "code", "zone_name", "by_type", F.posexplode("spine").alias("position", "t"))
        .select(
            "user_id", "code", "zone_name",
            F.col("t.type_code").alias("type_code"),
            F.col("t.name").alias("type_name"),
            F.coalesce(F.try_element_at("by_type", F.col("t.type_code")), F.lit(0)).cast("long").alias("finds"),
            (F.col("position") + 1).alias("position"),
        )
    )
