"""Item search: filters, boxes, circles, sorting, pages and lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwise.functions import geo


@dataclass
class ItemFilter:
    """Optional conditions, all of which must hold."""

    text: str | None = None
    type_code: str | None = None
    size_code: str | None = None
    country_id: int | None = None
    state_id: int | None = None
    difficulty: tuple[float | None, float | None] = (None, None)
    terrain: tuple[float | None, float | None] = (None, None)
    placed_after: str | None = None
    placed_before: str | None = None
    attr_positive: list[int] = field(default_factory=list)
    attr_negative: list[int] = field(default_factory=list)
    box: tuple[float, float, float, float] | None = None


def words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def mentions_any(query: str, *texts: str) -> Column:
    """True where any word of ``query`` occurs in any of the text columns."""
    return F.arrays_overlap(words(F.lit(query)), words(F.concat_ws(" ", *texts)))


def has_attribute(ids: list[int], positive: bool) -> Column:
    """True where any listed attribute is set with the given sign."""
    sign = F.lit(positive)
    return F.exists("attributes", lambda a: a["attr_id"].isin(ids) & (a["is_positive"] == sign))


def filter_items(items: DataFrame, wanted: ItemFilter) -> DataFrame:
    conditions: list[Column] = []
    for name in ("type_code", "size_code", "country_id", "state_id"):
        value = getattr(wanted, name)
        if value is not None:
            conditions.append(F.col(name) == F.lit(value))
    for name in ("difficulty", "terrain"):
        low, high = getattr(wanted, name)
        if low is not None:
            conditions.append(F.col(name) >= low)
        if high is not None:
            conditions.append(F.col(name) <= high)
    if wanted.placed_after:
        conditions.append(F.col("placed_at") >= F.lit(wanted.placed_after).cast("date"))
    if wanted.placed_before:
        conditions.append(F.col("placed_at") <= F.lit(wanted.placed_before).cast("date"))
    if wanted.box:
        conditions.append(geo.in_box(F.col("lat"), F.col("lon"), *wanted.box))
    if wanted.attr_positive:
        conditions.append(has_attribute(wanted.attr_positive, True))
    if wanted.attr_negative:
        conditions.append(has_attribute(wanted.attr_negative, False))
    if wanted.text:
        conditions.append(mentions_any(wanted.text, "title", "description"))
    out = items
    for condition in conditions:
        out = out.where(condition)
    return out


SORT_KEYS: dict[str, tuple[str, bool]] = {
    "-placed_at": ("placed_at", True),
    "-favorites": ("favorites", True),
    "difficulty": ("difficulty", False),
    "terrain": ("terrain", False),
}


def sort_keys(sort: str | None) -> list[tuple[str, bool]]:
    """(column, descending) of one of four orders (newest placed first by default), made total by the id."""
    return [SORT_KEYS.get(sort or "-placed_at", SORT_KEYS["-placed_at"]), ("item_id", False)]


def order_of(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc(name) if descending else F.asc(name) for name, descending in keys]


def sort_order(sort: str | None) -> list[Column]:
    return order_of(sort_keys(sort))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page plus the total and the number of pages on every row.

    Planned as a distributed top-k (each task keeps only ``number * size``
    rows), never as a global sort or a single-partition window. That suits the
    first pages; ``deep_page`` serves any page.
    """
    if size < 1 or number < 1:
        raise ValueError("page number and size start at 1")
    total = rows.groupBy().agg(F.count(F.lit(1))).scalar()
    chosen = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return _with_totals(chosen, total, size)


def _with_totals(chosen: DataFrame, total: Column, size: int) -> DataFrame:
    return chosen.withColumn("total", total).withColumn(
        "nb_pages", F.ceil(F.col("total") / F.lit(size)).cast("long")
    )


#: Types of page keys, besides decimals.
RANKED_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "boolean")
#: Ranges of at most this many rows are sorted instead of being narrowed further.
SORTED_ROWS = 100_000
#: Ranks of the approximate quantiles are off by at most one part in this many.
QUANTILE_ACCURACY = 2000


def deep_page(
    rows: DataFrame, keys: list[tuple[str, bool]], number: int = 1, size: int = 50, sorted_rows: int = SORTED_ROWS
) -> DataFrame:
    """``page`` for any page number, by order statistics instead of skipping rows.

    ``keys`` are (column, descending), numbers, dates, timestamps or booleans,
    the last one unique; rows equal in all of them are interchangeable. Nulls
    come first ascending and last descending, as in any Spark sort. Two
    approximate quantiles bracket the page's positions, one exact count per
    side of the bracket tells where it lies, and the bracket is narrowed until
    ``sorted_rows`` rows are left; only those are sorted. Each round reads the
    key columns twice and keeps about a thousandth of the rows, and its range
    is a plain filter on the scan. A crowd of equal values goes on to the next
    key. Runs jobs when called; ``rows`` is read several times.
    """
    if size < 1 or number < 1:
        raise ValueError("page number and size start at 1")
    names = [name for name, _ in keys]
    kinds = dict(rows.select(*names).dtypes)
    for name, kind in kinds.items():
        if kind not in RANKED_TYPES and not kind.startswith("decimal"):
            raise ValueError(f"no order statistics for column {name} of type {kind}")
    total, known = rows.agg(F.count(F.lit(1)), F.count(_value(rows, names[0]))).first()
    first = (number - 1) * size
    last = min(first + size, total)
    if first >= total:
        chosen = rows.limit(0)
    else:
        chosen = None
        for condition, skip, take, whole in _ranges(rows.select(*names), F.lit(True), keys, first, last, total, known, sorted_rows):
            part = rows.where(condition)
            if not whole:
                part = part.orderBy(*order_of(keys)).offset(skip).limit(take)
            chosen = part if chosen is None else chosen.unionByName(part)
        chosen = chosen.orderBy(*order_of(keys))
    return _with_totals(chosen, F.lit(total).cast("long"), size)


def _value(rows: DataFrame, name: str) -> Column:
    """The key where it has a place among values: NaN sorts after all of them, as a range of its own."""
    floating = dict(rows.select(name).dtypes)[name] in ("float", "double")
    return F.when(~F.isnan(name), F.col(name)) if floating else F.col(name)


def _ranges(keyed, inside, left, first, last, count, known, sorted_rows) -> list[tuple[Column, int, int, bool]]:
    """(condition, skip, take, whole) of the ranges that hold positions ``first`` to ``last`` - 1
    among the ``count`` rows where ``inside`` holds; whole ranges need no sorting.

    ``left`` are the keys not yet fixed to one value by ``inside``, ``known``
    counts the rows with a value in the first of them (None: not counted yet).
    """
    if first == 0 and last == count:
        return [(inside, 0, count, True)]
    if count <= sorted_rows or not left:
        return [(inside, first, last - first, False)]
    (name, descending), key = left[0], F.col(left[0][0])
    here = keyed.where(inside)
    if known is None:
        known = here.agg(F.count(_value(here, name))).first()[0]
    floating = dict(here.dtypes)[name] in ("float", "double")
    number = ~F.isnan(key) if floating else F.lit(True)
    parts: list[tuple[Column, list]] = [(key.isNull(), left[1:])]
    if known:
        low, high = _bracket(here, name, first, last, count, known, descending)
        parts += [(key < low, left), (key == low, left[1:]), ((key > low) & (key < high), left)]
        parts += [((key == high) & (low != high), left[1:]), ((key > high) & number, left)]
    if floating:
        parts += [(F.isnan(key), left[1:])]
    sizes = here.agg(*[F.count_if(p).alias(f"p{i}") for i, (p, _) in enumerate(parts)]).first()
    out, before = [], 0
    for i in reversed(range(len(parts))) if descending else range(len(parts)):
        (condition, rest), held = parts[i], sizes[i]
        begin, end = max(first - before, 0), min(last - before, held)
        before += held
        if begin < end:
            # Values too close for quantiles to tell apart are sorted.
            rest = [] if rest is left and held == count else rest
            out += _ranges(keyed, inside & condition, rest, begin, end, held, held if rest is left else None, sorted_rows)
    return out


def _bracket(here: DataFrame, name: str, first: int, last: int, count: int, known: int, descending: bool) -> tuple[Column, Column]:
    """Two values of the key around the wanted positions, as far as approximate ranks can tell."""
    # Nulls (and NaN, on the other side) shift positions among values; an estimate is enough here.
    lowest, highest = (count - last, count - first) if descending else (first, last)
    nulls, slack = count - known, 2.0 / QUANTILE_ACCURACY
    shares = [
        max(0.0, min(1.0, (lowest - nulls) / known - slack)),
        max(0.0, min(1.0, (highest - nulls) / known + slack)),
    ]
    kind = dict(here.dtypes)[name]
    rank = F.unix_micros(name) if kind == "timestamp" else F.col(name).cast("int") if kind == "boolean" else _value(here, name)
    bounds = here.agg(F.percentile_approx(rank, shares, QUANTILE_ACCURACY)).first()[0]
    back = {"boolean": lambda v: F.lit(bool(v)), "timestamp": lambda v: F.timestamp_micros(F.lit(v))}.get(kind, F.lit)
    return back(bounds[0]), back(bounds[1])


def within_radius(items: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Items at most ``radius_km`` away with their distance; the box comparison
    prunes the scan, the great-circle test decides."""
    if radius_km < 0:
        raise ValueError("the radius is negative")
    box = geo.radius_box(lat, lon, radius_km)
    return (
        items.where(geo.in_box(F.col("lat"), F.col("lon"), *box))
        .withColumn("distance_km", geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
        .where(F.col("distance_km") <= radius_km)
    )


def compact(items: DataFrame, types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nine display fields with the type's and size's label and code.

    The dimensions are left joins without a hint: they are small enough for
    the optimiser to broadcast when their size statistics say so.
    """
    t = types.select("type_code", F.col("name").alias("type_label"))
    s = sizes.select("size_code", F.col("name").alias("size_label"))
    return (
        items.select("item_id", "code", "title", "type_code", "size_code", "difficulty", "terrain", "lat", "lon")
        .join(t, "type_code", "left")
        .join(s, "size_code", "left")
        .withColumn("type", F.struct(F.col("type_label").alias("label"), F.col("type_code").alias("code")))
        .withColumn("size", F.struct(F.col("size_label").alias("label"), F.col("size_code").alias("code")))
        .drop("type_label", "size_label")
    )


def lookup(keys: DataFrame, items: DataFrame, types: DataFrame, sizes: DataFrame, on: str) -> DataFrame:
    """Batch lookup: a table of keys in, one row per known key out."""
    wanted = items.join(keys.select(on).distinct(), on, "left_semi")
    return compact(wanted, types, sizes)


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("int")


def cell_width(radius_km: float, split: int) -> float:
    """Cells are a fraction of the radius wide, in degrees of latitude."""
    return radius_km / geo.KM_PER_DEGREE / split


def with_cells(items: DataFrame, width: float) -> DataFrame:
    placed = items.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.withColumns({"cy": _cell(F.col("lat"), width), "cx": _cell(F.col("lon"), width)})


def grid_probes(centres: DataFrame, radius_km: float, split: int = 8) -> DataFrame:
    """``centres`` once per grid cell (``cy, cx``) its circle can touch, with
    ``nearest_m`` and ``farthest_m``, bounds for the distance of anything in the cell.

    ``centres`` has ``centre_lat, centre_lon``. Near a pole every longitude is
    listed; across the date line cells are compared as the longitudes they
    stand for.
    """
    width = cell_width(radius_km, split)
    reach = radius_km / geo.KM_PER_DEGREE * (1 + 1e-9)
    ratio = F.sin(F.radians(F.lit(reach))) / F.greatest(F.cos(F.radians("centre_lat")), F.lit(1e-12))
    polar = (F.abs("centre_lat") + reach >= 90) | (ratio >= 1)
    half_lon = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    lat_cells = F.sequence(_cell(F.col("centre_lat") - reach, width), _cell(F.col("centre_lat") + reach, width))
    low = _cell(F.col("centre_lon") - F.col("half_lon"), width)
    high = _cell(F.col("centre_lon") + F.col("half_lon"), width)
    lon_cells = F.sequence(low, F.least(high, low + F.lit(int(360 / width) + 1)))
    wraps = F.abs(F.col("centre_lon")) + 2 * width + F.col("half_lon") > 180
    spread = (
        centres.withColumn("half_lon", half_lon)
        .withColumn("cy", F.explode(lat_cells))
        .withColumn("raw_cx", F.explode(lon_cells))
        .withColumn("own_cx", _cell(F.pmod((F.col("raw_cx") + 0.5) * width + 180, F.lit(360.0)) - 180, width))
        # Wrapping shifts cells by part of a width, so neighbours join in there.
        .withColumn("cx", F.explode(F.when(wraps, F.sequence(F.col("own_cx") - 1, F.col("own_cx") + 1)).otherwise(F.array("own_cx"))))
        .select(*centres.columns, "cy", "cx")
        .distinct()
    )
    middle = geo.haversine_km(F.col("centre_lat"), F.col("centre_lon"), (F.col("cy") + 0.5) * width, (F.col("cx") + 0.5) * width) * 1000
    half_diagonal = width * geo.KM_PER_DEGREE * 1000 * 0.7072
    return (
        spread.withColumn("middle_m", middle)
        .withColumns({"nearest_m": F.greatest(F.col("middle_m") - half_diagonal, F.lit(0.0)), "farthest_m": F.col("middle_m") + half_diagonal})
        .drop("middle_m")
        .where(F.col("nearest_m") <= radius_km * 1000)
    )


def grid_candidates(centres: DataFrame, items: DataFrame, radius_km: float, split: int = 8) -> DataFrame:
    """(centre, item, distance_m) for every item within reach of a centre.

    ``centres`` holds distinct places. Centres and items meet in an equi join
    on the grid cell; cells wholly outside the circle were dropped before, so
    the rows compared stay close to the rows kept.
    """
    width = cell_width(radius_km, split)
    probes = grid_probes(centres, radius_km, split).drop("nearest_m", "farthest_m")
    distance = geo.haversine_km(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon")) * 1000
    return (
        with_cells(items, width).join(probes, ["cy", "cx"])
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius_km * 1000)
        .drop("cy", "cx")
    )
