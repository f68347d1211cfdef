"""Polygon geometry on ring arrays (``array<array<struct<x,y>>>``).

Edges are structs ``(x1, y1, x2, y2)``. Several rings are read even-odd, so
holes and disjoint parts need no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(rings: Column) -> Column:
    """All edges of all rings; an unclosed ring is closed."""

    def of_ring(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
        )

    return F.flatten(F.transform(rings, of_ring))


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def centroid(df: DataFrame, rings: str, x: str, y: str) -> DataFrame:
    """Adds the area centroid as columns ``x`` and ``y``; outer and inner rings
    must wind oppositely. Steps are separate columns so that each is computed once."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    staged = df.withColumns({"_edges": edges(F.col(rings)), "_base": F.flatten(rings)[0]})

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e["x1"] - F.col("_base.x"), e["y1"] - F.col("_base.y")
        bx, by = e["x2"] - F.col("_base.x"), e["y2"] - F.col("_base.y")
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["x"] + (ax + bx) * cross).alias("x"),
            (acc["y"] + (ay + by) * cross).alias("y"),
        )

    total = staged.withColumn("_total", F.aggregate("_edges", zero, add))

    def middle(axis: str) -> Column:
        return F.col(f"_base.{axis}") + F.try_divide(F.col(f"_total.{axis}"), 3 * F.col("_total.a"))

    # A generator keeps the optimiser from copying the whole expression into
    # every null check and join key derived from the result.
    point = F.inline(F.array(F.struct(middle("x").alias(x), middle("y").alias(y))))
    return total.select(*df.columns, point)


def strictly_inside(x: Column, y: Column, edge_list: Column) -> Column:
    """Odd number of edges to the right, and on none of them."""

    def crosses(e: Column) -> Column:
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    odd = F.size(F.filter(edge_list, crosses)) % 2 == 1
    return odd & ~F.exists(edge_list, touches)


def may_touch_box(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """False only where an edge surely stays clear of a box.

    It does if their extents are apart or all corners lie on one side of the
    edge's line, by more than rounding could account for.
    """
    apart = (
        (F.greatest(e["x1"], e["x2"]) < x0) | (F.least(e["x1"], e["x2"]) > x1)
        | (F.greatest(e["y1"], e["y2"]) < y0) | (F.least(e["y1"], e["y2"]) > y1)
    )
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    sides = [dx * (y - e["y1"]) - dy * (x - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
    slack = (F.abs(dx) + F.abs(dy)) * 1e-9
    return ~(apart | (F.least(*sides) > slack) | (F.greatest(*sides) < -slack))


def edge_distance(x: Column, y: Column, edge_list: Column) -> Column:
    """Shortest distance from a point to any of the edges (null if there is none)."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        gap_x, gap_y = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
        return F.sqrt(gap_x * gap_x + gap_y * gap_y)

    return F.array_min(F.transform(edge_list, to_edge))
