import random

from pyspark.sql import functions as F

from cairnwise.operators import zones as z


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def zone_table(spark, rows):
    schema = "code string, level int, name string, country string, parent_code string, rings array<array<struct<x:double,y:double>>>"
    return spark.createDataFrame([(c, lv, c, "XX", None, r) for c, lv, r in rows], schema)


def points(spark, rows):
    return spark.createDataFrame([(i, float(y), float(x)) for i, x, y in rows], "item_id long, lat double, lon double")


def assigned(df):
    return {r.item_id: (r.level1, r.level2) for r in df.collect()}


def test_two_unit_squares(spark):
    zones = zone_table(spark, [("A", 2, box(0, 0, 1, 1)), ("B", 2, box(1, 0, 2, 1))])
    pts = points(spark, [(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 1.0, 0.5), (4, -0.05, 0.5), (5, 9, 9), (6, 0.5, 1.0)])
    exact = assigned(z.assign_exact(pts, zones))
    assert exact == {1: (None, "A"), 2: (None, "B"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    near = assigned(z.assign_nearest(pts, zones))
    assert near[4] == (None, "A") and near[3] == (None, "A") and near[5] == (None, None)


def inside(px, py, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a["y"] > py) != (b["y"] > py) and px < a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                odd = not odd
    return odd


def test_hole_and_slanted_polygon_against_brute_force(spark):
    donut = [ring((0, 0), (6, 1), (7, 5), (2, 7), (0, 0)), ring((2, 2), (2, 4), (4, 4), (4, 2), (2, 2))]
    parts = [ring((-5, -5), (-3, -5), (-4, -2), (-5, -5)), ring((-2, -2), (-1, -2), (-1, -1), (-2, -2))]
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-6, 8), rnd.uniform(-6, 8)) for i in range(400)]
    got = assigned(z.assign_exact(points(spark, rows), zone_table(spark, [("D", 1, donut), ("P", 1, parts)])))
    for i, x, y in rows:
        want = "D" if inside(x, y, donut) else "P" if inside(x, y, parts) else None
        assert got[i][0] == want


def test_passes_and_foreign_points(spark):
    zones = zone_table(spark, [("R", 1, box(0, 0, 2, 1)), ("A", 2, box(0, 0, 1, 1)), ("B", 2, box(1, 0, 2, 1))])
    zones = zones.withColumn("parent_code", F.when(F.col("level") == 2, "R"))
    pts = points(spark, [(1, 0.5, 0.5), (2, 5, 5), (3, 6, 6), (4, 2.05, 0.5), (5, 7, 7)])
    lookup = spark.createDataFrame([(5.0, 5.0, "B", "XX"), (6.0, 6.0, None, "YY")], "lat_key double, lon_key double, level2 string, country string")
    rows = {r.item_id: (r.level1, r.level2, r.via) for r in z.assign_zones(pts, zones, lookup).collect()}
    assert rows == {1: ("R", "A", "exact"), 2: ("R", "B", "lookup"), 3: (None, None, "foreign"), 4: ("R", "B", "nearest"), 5: (None, None, "nearest")}
    again = points(spark, [(1, 0.5, 0.5), (2, 5, 5)]).withColumns({"level1": F.lit("R"), "level2": F.when(F.col("item_id") == 1, "B")})
    kept = {r.item_id: r.level2 for r in z.assign_zones(again, zones, lookup, force=False).collect()}
    assert kept == {1: "B", 2: "B"}


def test_parent_falls_back_to_nearest(spark):
    zones = zone_table(spark, [("R1", 1, box(0, 0, 2, 2)), ("R2", 1, box(10, 0, 12, 2)), ("c1", 2, box(0.5, 0.5, 1, 1)), ("c2", 2, box(8, 0, 9, 1))])
    got = {r.code: r.parent_code for r in z.zone_parents(zones).collect()}
    assert got == {"c1": "R1", "c2": "R2"}


def test_zone_level_preference(spark):
    zones = zone_table(spark, [("X", 1, box(0, 0, 1, 1)), ("X", 2, box(0, 0, 1, 1)), ("Y", 1, box(0, 0, 1, 1))])
    assert {r.code: r.level for r in z.chosen_levels(zones).collect()} == {"X": 2, "Y": 1}
    assert {r.code: r.level for r in z.chosen_levels(zones, 1).collect()} == {"X": 1, "Y": 1}


def test_parents_of_outliers(spark):
    """Children outside every zone take the nearest zone of their own country, near or on the other side of the map."""
    r = random.Random(4)
    rows = [(f"P{k}", 1, [box(x, y, x + r.uniform(0.1, 4), y + r.uniform(0.1, 3))[0]], "XX" if k % 3 else "YY") for k, (x, y) in enumerate((r.uniform(-30, 30), r.uniform(-20, 20)) for _ in range(12))]
    spots = [(r.uniform(-35, 35), r.uniform(-25, 25)) for _ in range(40)] + [(179.5, 80.0), (-179.9, -85.0), (0.0, 0.0)]
    rows += [(f"C{k}", 2, box(x, y, x + 0.01, y + 0.01), "XX" if k % 2 else "YY") for k, (x, y) in enumerate(spots)]
    rows.append(("C-lost", 2, box(5, 5, 6, 6), "ZZ"))
    schema = "code string, level int, name string, country string, parent_code string, rings array<array<struct<x:double,y:double>>>"
    zones = spark.createDataFrame([(code, level, code, country, None, rings) for code, level, rings, country in rows], schema)

    def gap(x, y, rings):
        xs, ys = [p["x"] for p in rings[0]], [p["y"] for p in rings[0]]
        return max(min(xs) - x, 0, x - max(xs)), max(min(ys) - y, 0, y - max(ys))

    got = {row["code"]: row["parent_code"] for row in z.zone_parents(zones).collect()}
    for code, level, rings, country in rows:
        if level == 1:
            continue
        x, y = (rings[0][0]["x"] + rings[0][2]["x"]) / 2, (rings[0][0]["y"] + rings[0][2]["y"]) / 2
        gaps = {p: gap(x, y, pr) for p, pl, pr, _ in rows if pl == 1}
        around = sorted(p for p, g in gaps.items() if g == (0, 0))
        own = [(dx * dx + dy * dy, p) for (p, (dx, dy)), pc in zip(gaps.items(), [c for _, lv, _, c in rows if lv == 1]) if pc == country]
        assert got[code] == (around[0] if around else min(own)[1] if own else None), code


def crowded_map(spark):
    """Half of the points crowd around one corner of slanted zones, a third share one place."""
    r = random.Random(8)
    donut = [ring((0, 0), (6, 1), (7, 5), (2, 7), (0, 0)), ring((2, 2), (2, 4), (4, 4), (4, 2), (2, 2))]
    wedge = [ring((2.1, 2.1), (3.9, 2.2), (3, 3.9), (2.1, 2.1))]
    rows = [(r.uniform(-1, 8), r.uniform(-1, 8)) for _ in range(300)]
    rows += [(2 + r.gauss(0, 0.05), 2 + r.gauss(0, 0.05)) for _ in range(900)]
    rows += [(5.0001, 3.0001)] * 600 + [(2.0, 3.0), (6.0, 1.0), (0.0, 0.0)]
    spots = [(i, x, y) for i, (x, y) in enumerate(rows)]
    nowhere = spark.createDataFrame([(-1, None, 3.0), (-2, 2.0, None)], "item_id long, lat double, lon double")
    pts = points(spark, spots).unionByName(nowhere)
    return spots, pts, {"D": donut, "W": wedge}, zone_table(spark, [("D", 1, donut), ("W", 2, wedge)])


def on_border(x, y, rings):
    return any(
        (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        and min(a["x"], b["x"]) <= x <= max(a["x"], b["x"]) and min(a["y"], b["y"]) <= y <= max(a["y"], b["y"])
        for r in rings for a, b in zip(r, r[1:])
    )


def test_crowded_cells_against_brute_force(spark):
    spots, pts, shapes, zones = crowded_map(spark)
    tree = z.cell_tree(pts, limit=40)
    got = assigned(z.containing_zones(pts, zones, tree))
    for i, x, y in spots:
        want = tuple(c if inside(x, y, shapes[c]) and not on_border(x, y, shapes[c]) else None for c in ("D", "W"))
        assert got.get(i, (None, None)) == want, (x, y)
    assert set(got) <= {i for i, _, _ in spots}
    plain = assigned(z.containing_zones(pts, zones))
    assert plain == got


def test_no_cell_holds_more_than_its_share(spark):
    spots, pts, _, zones = crowded_map(spark)
    tree = z.cell_tree(pts, limit=40)
    assert len(tree.crowded) == tree.deepest + 1 and all(len(cells) <= z.CROWDED_SHARE for cells in tree.crowded)
    leaves = z.leaf_points(pts, tree)
    assert leaves.count() == len(spots)
    sizes = [r["count"] for r in leaves.groupBy("depth", "cx", "cy", "salt").count().collect()]
    assert max(sizes) <= 80
    cells = z.leaf_cells(zones, tree, 0.0).withColumn("n", F.size("edges")).collect()
    whole = [c for c in cells if c["whole"]]
    assert whole and all(c["n"] == 0 for c in whole) and len({c["salt"] for c in whole}) > 10
    assert z.cell_tree(pts.limit(0)).crowded == [] and z.cell_tree(pts).crowded == []


def test_nearest_border_in_crowded_cells(spark):
    spots, pts, shapes, zones = crowded_map(spark)

    def gap(x, y, rings):
        best = 9e9
        for r in rings:
            for a, b in zip(r, r[1:]):
                dx, dy = b["x"] - a["x"], b["y"] - a["y"]
                t = max(0.0, min(1.0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy)))
                best = min(best, ((x - a["x"] - t * dx) ** 2 + (y - a["y"] - t * dy) ** 2) ** 0.5)
        return best

    got = assigned(z.nearest_zones(pts, zones, 0.1, z.cell_tree(pts, limit=40)))
    for i, x, y in spots:
        want = tuple(c if gap(x, y, shapes[c]) <= 0.1 else None for c in ("D", "W"))
        assert got.get(i, (None, None)) == want, (x, y)
