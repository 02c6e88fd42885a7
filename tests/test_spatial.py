"""Distance and polygon joins against brute force, with crowded cells and copies."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import hull as H
from parcelflow.operators import polygons as P
from parcelflow.operators.polygons import points_in_polygons
from parcelflow.operators import proximity, pyramid
from parcelflow.operators.proximity import count_within, nearest, nearest_by_type, target_sites
from parcelflow.operators.raster import Grid, align_tile, merge_tiles, raster_lookup
from parcelflow.plans.features import FeatureSources, geo_features
from parcelflow.scratch import materialize


def crowded(rng, n, copies=0.3, spot=0.4, extent=20000.0):
    """Points of which many share one place and many lie within a few metres of each other."""
    out = []
    for _ in range(n):
        u = rng.random()
        if u < copies:
            out.append((7000.0, 7000.0))
        elif u < copies + spot:
            out.append((7000.0 + rng.random() * 30, 7000.0 + rng.random() * 30))
        else:
            out.append((rng.random() * extent, rng.random() * extent))
    return out


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(r) for r in rows], names)


@pytest.mark.parametrize("pair_limit", [4, 1 << 14])
def test_count_within_equals_brute_force(spark, pair_limit):
    rng = random.Random(1)
    points = [(i, x, y) for i, (x, y) in enumerate(crowded(rng, 300))]
    pois = [(rng.choice("ab"), x, y) for x, y in crowded(rng, 400)]
    have = count_within(
        frame(spark, points, "id long, x double, y double"),
        frame(spark, pois, "key string, x double, y double"),
        500,
        {"a": "n_a", "b": "n_b", "c": "n_c"},
        pair_limit=pair_limit,
    )
    got = {r["id"]: (r["n_a"], r["n_b"], r["n_c"]) for r in have.collect()}
    for i, x, y in points:
        near = [k for k, px, py in pois if math.hypot(px - x, py - y) <= 500]
        assert got[i] == (near.count("a"), near.count("b"), 0)


def test_count_within_edge_cases(spark):
    points = frame(spark, [(1, 0.0, 0.0), (2, 90000.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    pois = frame(spark, [("a", 500.0, 0.0), ("a", 500.001, 0.0), ("z", 0.0, 0.0)], "key string, x double, y double")
    got = {r["id"]: r["n"] for r in count_within(points, pois, 500, {"a": "n"}).collect()}
    assert got == {1: 1, 2: 0, 3: 0}  # exactly on the radius counts


def square(x, y, half):
    return [{"x": x - half, "y": y - half}, {"x": x + half, "y": y - half}, {"x": x + half, "y": y + half}, {"x": x - half, "y": y + half}]


def polygons(spark, rows, names):
    df = spark.createDataFrame(rows, names + ", ring array<struct<x:double,y:double>>")
    return df.withColumn("edges", geo.ring_edges(F.col("ring"))).drop("ring")


def test_polygon_poi_counts_only_when_wholly_inside(spark):
    points = frame(spark, [(1, 0.0, 0.0)], "id long, x double, y double")
    pois = polygons(spark, [("a", square(100.0, 0.0, 50.0)), ("a", square(480.0, 0.0, 50.0))], "key string")
    assert count_within(points, pois, 500, {"a": "n"}).first()["n"] == 1


@pytest.mark.parametrize("pair_limit", [4, 1 << 10])
def test_nearest_equals_brute_force(spark, pair_limit):
    rng = random.Random(2)
    points = [(i, x, y) for i, (x, y) in enumerate(crowded(rng, 300))]
    sources = [(f"s{i:03}", rng.choice([None, 1, 2, 3]), x, y) for i, (x, y) in enumerate(crowded(rng, 200))]
    have = nearest(
        frame(spark, points, "id long, x double, y double"),
        frame(spark, sources, "name string, size int, x double, y double"),
        "name",
        ties="size",
        ascending=False,
        pair_limit=pair_limit,
    )
    got = {r["id"]: (r["name"], r["size"], r["distance"]) for r in have.collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        best = min(sources, key=lambda s: (math.hypot(s[2] - x, s[3] - y), s[1] is None, -(s[1] or 0), s[0]))
        assert got[i][:2] == best[:2]
        assert got[i][2] == pytest.approx(math.hypot(best[2] - x, best[3] - y))


def test_nearest_ties_and_empty_source(spark):
    points = frame(spark, [(1, 0.0, 0.0), (2, None, None)], "id long, x double, y double")
    rows = [("a", 5, 10.0, 0.0), ("b", 9, -10.0, 0.0), ("c", 9, 0.0, 10.0), ("d", None, 0.0, -10.0)]
    sources = frame(spark, rows, "name string, size int, x double, y double")

    def winner(df, ascending):
        return {r["id"]: r["name"] for r in nearest(points, df, "name", "size", ascending).collect()}

    assert winner(sources, False) == {1: "b", 2: None}
    assert winner(sources, True) == {1: "a", 2: None}
    assert winner(sources.filter("false"), True) == {1: None, 2: None}


def test_nearest_polygon_equals_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.random() * 5000, rng.random() * 5000) for i in range(200)]
    shapes = [(f"p{i:02}", rng.random() * 5000, rng.random() * 5000, 20 + rng.random() * 400) for i in range(60)]
    have = nearest(
        frame(spark, points, "id long, x double, y double"),
        polygons(spark, [(n, square(x, y, h)) for n, x, y, h in shapes], "name string"),
        "name",
        pair_limit=16,
    )
    got = {r["id"]: (r["name"], r["distance"]) for r in have.collect()}
    for i, x, y in points:

        def gap(s):
            return math.hypot(max(abs(x - s[1]) - s[3], 0), max(abs(y - s[2]) - s[3], 0))

        best = min(shapes, key=lambda s: (gap(s), s[0]))
        assert got[i][0] == best[0] and got[i][1] == pytest.approx(gap(best), abs=1e-6)


def test_nearest_by_type_skips_absent_types(spark):
    rng = random.Random(4)
    points = [(i, x, y) for i, (x, y) in enumerate(crowded(rng, 120))]
    pois = [(rng.choice(["bar", "pub"]), x, y) for x, y in crowded(rng, 150)]
    have = nearest_by_type(
        frame(spark, points, "id long, x double, y double"),
        frame(spark, pois, "value string, x double, y double"),
        {"bar": "bar", "pub": "pub", "castle": "castle"},
        pair_limit=8,
    )
    assert have.columns == ["x", "y", "id", "bar", "pub"]
    for r in have.collect():
        for t in ("bar", "pub"):
            best = min(math.hypot(x - r["x"], y - r["y"]) for v, x, y in pois if v == t)
            assert r[t] == pytest.approx(best)


def test_points_in_polygons(spark):
    rows = [(1, square(0.0, 0.0, 1.0)), (2, square(2.0, 0.0, 1.0)), (3, square(50.0, 50.0, 20.0))]
    shapes = spark.createDataFrame(rows, "tract int, ring array<struct<x:double,y:double>>")
    rows = [("in", 0.5, 0.5), ("edge", 1.0, 0.2), ("corner", 1.0, 1.0), ("out", 5.0, 5.0), ("none", None, 1.0), ("big", 60.0, 31.0)]
    points = frame(spark, rows, "id string, x double, y double")

    def held(**how):
        out: dict = {}
        for r in points_in_polygons(points, shapes, ["tract"], "tract", **how).collect():
            out.setdefault(r["id"], []).append(r["tract"])
        return {k: sorted(v, key=lambda t: t or 0) for k, v in out.items()}

    expected = {"in": [1], "edge": [1, 2], "corner": [1, 2], "out": [None], "none": [None], "big": [3]}
    assert held() == expected
    assert held(dedupe="first") == {**expected, "edge": [1], "corner": [1]}
    with pytest.raises(ValueError):
        held(dedupe="last")


def test_concave_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]  # closed, with a notch
    shapes = spark.createDataFrame([(1, [{"x": float(a), "y": float(b)} for a, b in ring])], "t int, ring array<struct<x:double,y:double>>")
    points = frame(spark, [("notch", 2.0, 2.0), ("left", 0.5, 2.0), ("tip", 2.0, 1.0)], "id string, x double, y double")
    got = {r["id"]: r["t"] for r in points_in_polygons(points, shapes, ["t"], "t").collect()}
    assert got == {"notch": None, "left": 1, "tip": 1}


def in_rings(x, y, rings):
    """Inside or on the boundary, by all edges."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            crossed = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if crossed == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, radius, n, jag, whole=False):
    out = []
    for i in range(n):
        r = radius * (1 - jag * rng.random())
        p = (x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n))
        out.append((float(round(p[0])), float(round(p[1]))) if whole else p)
    return out


@pytest.mark.parametrize("edges_per_cell", [1, 16, 10000])
def test_quad_tree_of_a_polygon_against_all_edges(spark, edges_per_cell):
    """Jagged outlines with a hole, repeated and level vertices, teeth across the whole shape, a box on cell borders; many points on boundaries."""
    rng = random.Random(5)
    teeth = [(float(i), 50.0 if i % 2 else -50.0) for i in range(-60, 60)] + [(60.0, -70.0), (-60.0, -70.0)]
    shapes = [
        [star(rng, 0, 0, 100, 900, 0.3), star(rng, 0, 0, 30, 200, 0.5)],
        [star(rng, 7, -3, 64, 300, 0.0, whole=True)],
        [star(rng, 90, 90, 5, 1500, 0.9)],
        [teeth],
        [[(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]],
    ]
    points = [(rng.uniform(-110, 110), rng.uniform(-110, 110)) for _ in range(800)]
    points += [(90 + rng.uniform(-5, 5), 90 + rng.uniform(-5, 5)) for _ in range(200)]
    points += [(float(rng.randint(-70, 70)), float(rng.randint(-70, 70))) for _ in range(800)]
    points += [p for s in shapes for ring in s for p in rng.sample(ring, min(30, len(ring)))]
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in s]) for k, s in enumerate(shapes)]
    polys = spark.createDataFrame(rows, "t int, rings array<array<struct<x:double,y:double>>>")
    sites = frame(spark, [(i, x, y) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    held = points_in_polygons(sites, polys, ["t"], "t", edges_per_cell=edges_per_cell)
    got = sorted((r["id"], r["t"]) for r in held.filter("t is not null").select("id", "t").distinct().collect())
    assert got == [(i, k) for i, (x, y) in enumerate(points) for k, s in enumerate(shapes) if in_rings(x, y, s)]


def test_polygon_of_many_edges(spark):
    """No cell of a long outline holds more than a few of its edges, and the cells are far fewer than a full grid's."""
    ring = star(random.Random(2), 0, 0, 100, 20000, 0.01)
    shapes = spark.createDataFrame([(1, ring_edges_of(ring))], "_polygon_row long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    cells = P._cells(shapes.withColumns(P._levels(16)))
    most, count, inner = cells.selectExpr("max(size(edges))", "count(*)", "count_if(edges is null)").first()
    assert most < 200 and count < 20000 and 0 < inner < count


def ring_edges_of(ring):
    return [{"x1": a, "y1": b, "x2": c, "y2": d} for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]


def test_polygons_that_share_an_id(spark):
    """Two overlapping rows of one id and equal values are two polygons, not an even number of crossings."""
    square = [{"x": float(a), "y": float(b)} for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))]
    shapes = spark.createDataFrame([(1, square), (1, square)], "t int, ring array<struct<x:double,y:double>>")
    points = frame(spark, [("in", 2.0, 2.0), ("nan", float("nan"), 2.0), ("far", float("inf"), 0.0)], "id string, x double, y double")
    got = sorted((r["id"], r["t"]) for r in points_in_polygons(points, shapes, ["t"], "t").collect() if r["t"])
    assert got == [("in", 1), ("in", 1)]


def test_feature_table_measures_to_areas(spark):
    """Cities and POIs as areas: 0 inside, to the boundary from a hole and from outside, wholly within a radius or not counted."""
    from parcelflow.plans import features

    def square(lon, lat, half):
        return [{"x": lon + a * half, "y": lat + b * half} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    kind = "rings array<array<struct<x:double,y:double>>>"
    pois = spark.createDataFrame(
        [("shop", "mall", None, None, [square(-118.0, 34.0, 0.1), square(-118.0, 34.0, 0.05)]), ("shop", "kiosk", 34.3, -118.0, None)],
        f"key string, value string, latitude double, longitude double, {kind}",
    )
    points = frame(spark, [(1, 34.08, -118.0), (2, 34.0, -118.0), (3, 34.3, -118.0)], "parcelid int, latitude double, longitude double")
    metres = features.projected(points).select("parcelid", "x", "y")
    shapes = features._placed(pois, ["key", "value"])
    near = {r["parcelid"]: r for r in nearest_by_type(metres, shapes, {"mall": "mall", "kiosk": "kiosk"}).collect()}
    assert near[1]["mall"] == 0 and near[2]["mall"] == pytest.approx(4600, rel=0.05) and near[3]["mall"] == pytest.approx(22200, rel=0.02)
    assert near[3]["kiosk"] == pytest.approx(0, abs=1e-6)
    counts = {r["parcelid"]: r["n"] for r in count_within(metres, shapes, 12_000.0, {"shop": "n"}).collect()}
    assert counts == {1: 0, 2: 0, 3: 1}
    wide = {r["parcelid"]: r["n"] for r in count_within(metres, shapes, 16_000.0, {"shop": "n"}).collect()}
    assert wide == {1: 0, 2: 1, 3: 1}
    cities = spark.createDataFrame([("big", 9, [square(-118.0, 34.0, 0.1)]), ("far", 1, [square(-117.0, 34.0, 0.1)])], f"name string, population long, {kind}")
    found = features.city_features(metres, features._placed(cities, ["name", "population"]), 5.0).collect()
    assert {r["parcelid"]: (r["name_close_city"], r["distance_close_big_city"] == 0) for r in found} == {
        1: ("big", True), 2: ("big", True), 3: ("big", False),
    }


def test_missing_coordinates_have_no_neighbour(spark):
    points = frame(spark, [(1, 0.0, 0.0), (2, float("nan"), 0.0), (3, 0.0, float("-inf")), (4, None, 1.0)], "id long, x double, y double")
    sources = frame(spark, [("a", 3.0, 4.0), ("b", float("nan"), 0.0), ("c", 0.0, float("inf"))], "key string, x double, y double")
    got = {r["id"]: (r["key"], r["distance"]) for r in nearest(points, sources, "key").collect()}
    assert got == {1: ("a", 5.0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert {r["id"]: r["n"] for r in count_within(points, sources, 10.0, {"a": "n", "b": "m"}).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_merged_tiles_take_the_first_value(spark):
    tile = frame(spark, [(0, 0, None), (0, 1, float("nan")), (0, 2, 1.0), (0, 3, None)], "row long, col long, value double")
    other = frame(spark, [(0, 0, 7.0), (0, 1, 8.0), (0, 2, 9.0), (0, 3, float("nan"))], "row long, col long, value double")
    assert {r["col"]: r["value"] for r in merge_tiles([tile, other]).collect()} == {0: 7.0, 1: 8.0, 2: 1.0, 3: None}


def test_merged_tiles_combine_after_the_shuffle(spark):
    """No aggregate before the exchange: it would hold all cells of an input split in one task."""
    tile = frame(spark, [(0, c, float(c)) for c in range(8)], "row long, col long, value double")
    other = frame(spark, [(0, c, -float(c)) for c in range(4, 12)], "row long, col long, value double")
    merged = merge_tiles([tile, other])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") + plan.count("SortAggregate") > 0
    below = plan[plan.index("Exchange") :]
    assert "Aggregate" not in below
    assert {r["col"]: r["value"] for r in merged.collect()} == {c: float(c) if c < 8 else -float(c) for c in range(12)}


def test_geohash_limits(spark):
    at = lambda lat, lon: geo.coordinates(F.lit(lat), F.lit(lon))
    row = spark.range(1).select(
        geo.geohash(at(57.64911, 10.40744), 20).alias("long"),
        geo.geohash(at(57.64911, 10.40744), F.lit(15)).alias("column"),
        geo.geohash(at(-95.0, -200.0), 4).alias("low"),
        geo.geohash(at(95.0, 200.0), 4).alias("high"),
        geo.geohash(at(None, 1.0), 4).alias("none"),
    ).first()
    assert row["long"].startswith("u4pruydqqvj8") and row["column"] == row["long"][:15]
    assert (row["low"], row["high"], row["none"]) == ("0000", "zzzz", None)
    with pytest.raises(ValueError):
        geo.geohash(at(1.0, 1.0), 21)
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(geo.geohash(at(1.0, 1.0), F.lit(21))).collect()


def test_raster(spark):
    tile = frame(spark, [(0, 0, 5), (0, 1, 6)], "row long, col long, value int")
    other = frame(spark, [(0, 1, 60), (1, 1, 70)], "row long, col long, value int")
    merged = merge_tiles([tile, other])
    assert {(r["row"], r["col"]): r["value"] for r in merged.collect()} == {(0, 0): 5, (0, 1): 6, (1, 1): 70}
    points = frame(spark, [(1, 10.5, 20.5), (2, 11.0, 20.0), (3, 99.0, 20.0), (4, None, 20.0)], "id int, x double, y double")
    got = {r["id"]: r["elevation"] for r in raster_lookup(points, merged, 10.0, 20.0, 1.0).collect()}
    assert got == {1: 5, 2: 6, 3: None}


@pytest.mark.parametrize("grid", [Grid(0, 0, 10, 10), Grid(35, 400, 25, -25), Grid(-8, 3, 4, 3), Grid(5, 5, 10, 10), Grid(300, -20, -7, 20)])
@pytest.mark.parametrize("target", [Grid(0, 0, 10, 10), Grid(2, 300, 10, -5)])
def test_aligned_tiles_hold_the_value_at_every_centre(spark, grid, target):
    cells = {(r, c): 100 * r + c for r in range(12) for c in range(9) if (r + c) % 5}
    tile = frame(spark, [(r, c, v) for (r, c), v in cells.items()], "row long, col long, value int")
    got = align_tile(tile, grid, target).collect()
    spans = {k: [sorted((s + i * d, s + (i + 1) * d)) for i, s, d in ((k[1], grid.x0, grid.dx), (k[0], grid.y0, grid.dy))] for k in cells}
    want = {}
    for row in range(-60, 130):
        for col in range(-30, 60):
            x, y = target.x0 + (col + 0.5) * target.dx, target.y0 + (row + 0.5) * target.dy
            for k, ((x_low, x_high), (y_low, y_high)) in spans.items():
                if x_low <= x < x_high and y_low <= y < y_high:
                    want[row, col] = cells[k]
    assert {(r["row"], r["col"]): r["value"] for r in got} == want and len(got) == len(want)


def test_feature_table_takes_tiles(spark):
    """Elevation from two tiles of different origins, one of coarse cells with rows downwards; the first one's values win."""
    homes = frame(spark, [(1, 34_005_000, -118_005_000), (2, 34_025_000, -118_005_000), (3, 34_045_000, -118_025_000), (4, 35_000_000, -118_005_000)], "parcelid long, latitude long, longitude long")
    low = frame(spark, [(r, c, 10 * r + c) for r in range(2) for c in range(5)], "row long, col long, value int")
    high = frame(spark, [(0, 0, 700), (0, 1, 701), (1, 0, 710), (1, 1, 711)], "row long, col long, value int")
    square = [[(-2e7, 3e6), (2e7, 3e6), (2e7, 5e6), (-2e7, 5e6)]]
    sources = FeatureSources(
        pois=frame(spark, [("amenity", "school", 34.0, -118.0)], "key string, value string, latitude double, longitude double"),
        raster=[(low, Grid(-118.05, 34.0, 0.01, 0.01)), (high, Grid(-118.05, 34.06, 0.03, -0.03))],
        tracts=frame(spark, [(1, 5.0, square)], "tract long, people double, rings array<array<struct<x:double,y:double>>>"),
        cities=frame(spark, [("town", 10, 34.0, -118.0)], "name string, population int, latitude double, longitude double"),
        raster_lon=-118.05, raster_lat=34.0, raster_step=0.01, variables=["people"], keys={"amenity": "amenity"}, types={"school": "near_school"}, drop=[],
    )
    got = {r["parcelid"]: r["elevation"] for r in geo_features(homes, sources).collect()}
    assert got == {1: 4, 2: 711, 3: 700, 4: None}


def test_hull_and_buffer(spark):
    rng = random.Random(5)
    inner = [(rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(500)]
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = frame(spark, inner + corners + [(5.0, 0.0)], "x double, y double")
    hull = H.convex_hull(points)
    assert {(r["x"], r["y"]) for r in hull.collect()} == set(corners)
    rows = [(1, "k", "v", 12.0, 5.0), (2, "k", "v", 12.1, 5.0), (3, "k", "w", 5.0, 5.0), (4, "k", "v", 5.0, 5.0)]
    pois = frame(spark, rows, "id int, key string, value string, x double, y double")
    assert {r["id"] for r in H.select_pois(pois, {"k": ["v"]}, hull, 2.0).collect()} == {1, 4}


def test_no_all_pairs_join_in_the_plan(spark):
    points = frame(spark, [(1, 0.0, 0.0)], "id long, x double, y double")
    pois = frame(spark, [("a", 1.0, 0.0)], "key string, x double, y double")
    counted = count_within(points, pois, 500, {"a": "n"})
    near = nearest(points, pois, "key")
    for df in (counted, near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_written_rounds_join_by_cells(spark, monkeypatch):
    """No round pairs everything with everything; rounds within the pyramid read no sites, further down only open cells' ones."""
    written = []

    def recorded(df, label="table"):
        read = {re.search(r"/([a-z-]+)-[0-9a-f]{32}/", f)[1] for f in df.inputFiles() if "parcelflow-" in f}
        written.append((label, df._jdf.queryExecution().executedPlan().toString(), read))
        return materialize(df, label)

    monkeypatch.setattr(proximity, "materialize", recorded)
    monkeypatch.setattr(pyramid, "materialize", recorded)
    rng = random.Random(8)
    points = frame(spark, [(i, x, y) for i, (x, y) in enumerate(crowded(rng, 3000))], "id long, x double, y double")
    pois = frame(spark, [(rng.choice("ab"), x, y) for x, y in crowded(rng, 3000)], "key string, x double, y double")
    targets = target_sites(points)
    count_within(points, pois, 500, {"a": "n", "b": "m"}, pair_limit=64, sites=targets)
    nearest_by_type(points, pois, {"a": "a", "b": "b"}, category="key", pair_limit=64, sites=targets)
    labels = [w[0] for w in written]
    assert labels.count("targets") == 1 and labels.count("pairs") > 4 and "open-sites" in labels
    rounds = [w[1:] for w in written if w[0] == "pairs"]
    for plan, read in rounds:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        keys = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", plan)
        assert keys and all(re.search(r"\b(sx|spx|tpx|lx)#", k) for k in keys)
        assert read <= {"cells", "pairs", "open-sites"}
    assert rounds[0][1] == {"cells"}


def test_pyramid_levels_agree(spark):
    rng = random.Random(9)
    rows = [(round(x - 9000, 2), round(y - 9000, 2), rng.randint(1, 3)) for x, y in {p for p in crowded(rng, 500)}]
    made = pyramid.build(frame(spark, rows, "mx double, my double, weight long"))
    for level in range(made.finest - 2 * pyramid.STEP, made.top + 2 * pyramid.STEP + 1, pyramid.STEP):
        want = {}
        for x, y, w in rows:
            want.setdefault((math.floor(x / 2.0**level), math.floor(y / 2.0**level)), []).append((x, y, w))
        got = {(r["tx"], r["ty"]): r for r in made.at(level, "t").collect()}
        assert got.keys() == want.keys()
        for key, held in want.items():
            xs, ys, ws = zip(*held)
            r = got[key]
            assert (r["tn"], r["tw"]) == (len(held), sum(ws))
            assert (r["tx1"], r["tx2"], r["ty1"], r["ty2"]) == (min(xs), max(xs), min(ys), max(ys))
            assert (r["tpx"], r["tpy"]) == (key[0] >> 2, key[1] >> 2)
    assert pyramid.build(frame(spark, rows, "mx double, my double, weight long").limit(0)) is None


def test_nearest_of_areas_of_all_sizes(spark):
    """A few huge areas among many small ones, far from and over the points."""
    rng = random.Random(10)
    points = [(i, rng.random() * 3000, rng.random() * 3000) for i in range(80)]
    shapes = [(f"p{i:03}", rng.random() * 4000, rng.random() * 4000, 2.0 ** rng.randint(-3, 6)) for i in range(150)]
    shapes += [("big", 60_000.0, 0.0, 56_900.0), ("bigger", -900_000.0, 5e5, 899_000.0), ("dot", 1500.0, 1500.0, 0.0)]
    have = nearest(
        frame(spark, points, "id long, x double, y double"), polygons(spark, [(n, square(x, y, h)) for n, x, y, h in shapes], "name string"), "name", pair_limit=20
    )
    got = {r["id"]: (r["name"], r["distance"]) for r in have.collect()}
    for i, x, y in points:
        gap = lambda s: math.hypot(max(abs(x - s[1]) - s[3], 0), max(abs(y - s[2]) - s[3], 0))
        best = min(shapes, key=lambda s: (gap(s), s[0]))
        assert got[i][1] == pytest.approx(gap(best), abs=1e-6) and (got[i][0] == best[0] or gap(best) == pytest.approx(got[i][1], abs=1e-6))


def test_scalar_geo_functions(spark):
    row = (
        spark.range(1)
        .select(
            geo.coordinates(F.lit(52.5), F.lit(13.4)).alias("a"),
            geo.coordinates(F.lit(48.85), F.lit(2.35)).alias("b"),
            geo.coordinates(F.lit(57.64911), F.lit(10.40744)).alias("g"),
            geo.coordinates(F.lit(-90.0), F.lit(180.0)).alias("end"),
        )
        .select(
            geo.haversine(F.col("a"), F.col("b")).alias("km"),
            geo.haversine(F.col("a"), F.col("a")).alias("zero"),
            geo.manhattan(F.col("a"), F.col("b")).alias("legs"),
            geo.bearing(F.col("a"), F.col("b")).alias("bearing"),
            geo.geohash(F.col("g"), 11).alias("g11"),
            geo.geohash(F.col("g"), F.lit(5)).alias("g5"),
            geo.geohash(F.col("end"), 3).alias("gend"),
            *[c.alias(n) for c, n in zip(geo.albers(F.lit(0.0), F.lit(-120.0)), ("ax", "ay"))],
        )
        .first()
    )
    assert row["km"] == pytest.approx(878, abs=2) and row["zero"] == 0
    assert row["legs"] > row["km"] and -180 < row["bearing"] < 0
    assert (row["g11"], row["g5"], len(row["gend"])) == ("u4pruydqqvj", "u4pru", 3)
    assert (row["ax"], row["ay"]) == (pytest.approx(0, abs=1e-6), pytest.approx(-4000000, abs=1e-3))


def overlapping_areas(rng, n):
    """Squares, slanted triangles and rings of both windings that hold much of each other; ties with nulls and repeats."""
    out = []
    for k in range(n):
        x, y, r = rng.uniform(0, 10_000), rng.uniform(0, 10_000), rng.uniform(500, 6_000)
        square = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
        slanted = [(x - r, y - r / 3), (x + r / 2, y - r), (x + r / 4, y + r)]
        ring = (square, slanted, square[::-1])[k % 3]
        out.append((f"a{k:03d}", None if k % 11 == 0 else k % 40, ring))
    return out


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("ties, pair_limit", [("rank", 1 << 13), ("rank", 50), (None, 1 << 13)])
def test_nearest_of_overlapping_areas(spark, ascending, ties, pair_limit):
    """Cells covered by areas compare the better ranked ones only; the winners are those of all pairs."""
    rng = random.Random(5)
    areas = overlapping_areas(rng, 120)
    points = [(k, rng.uniform(-3_000, 13_000), rng.uniform(-3_000, 13_000)) for k in range(700)]
    shapes = spark.createDataFrame([(n, r, [{"x": a, "y": b} for a, b in ring]) for n, r, ring in areas], "name string, rank long, ring array<struct<x:double,y:double>>")
    got = nearest(
        spark.createDataFrame(points, "id long, x double, y double"), shapes.withColumn("edges", geo.ring_edges(F.col("ring"))).drop("ring"),
        "name", ties=ties, ascending=ascending, columns=["name"], pair_limit=pair_limit,
    )
    edges = {n: [tuple(e.values()) for e in ring_edges_of(ring)] for n, _, ring in areas}

    def gap(x, y, es):
        if sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in es) % 2:
            return 0.0
        at = [max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2))) for a, b, c, d in es]
        return min(math.hypot(x - a - t * (c - a), y - b - t * (d - b)) for t, (a, b, c, d) in zip(at, es))

    place = lambda r: 0 if not ties else (r is None, r and (r if ascending else -r))
    want = {k: min((round(gap(x, y, edges[n]), 6), place(r), n) for n, r, _ in areas) for k, x, y in points}
    assert {r["id"]: (r["name"], round(r["distance"], 6)) for r in got.collect()} == {k: (w[2], w[0]) for k, w in want.items()}


def test_overlapping_areas_do_not_all_meet(spark, monkeypatch):
    """Each point lies in about a hundred areas; behind the best one that covers its cell none is compared."""
    rng, met = random.Random(6), []
    shapes = [(f"a{k:03d}", k * 7919 % 1000, [(x - r, y - r, x + r, y - r), (x + r, y - r, x + r, y + r), (x + r, y + r, x - r, y + r), (x - r, y + r, x - r, y - r)])
              for k in range(300) for x, y, r in [(rng.uniform(0, 10_000), rng.uniform(0, 10_000), rng.uniform(3_000, 4_500))]]
    areas = spark.createDataFrame(shapes, "name string, rank long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    points = spark.createDataFrame([(k, rng.uniform(0, 10_000), rng.uniform(0, 10_000)) for k in range(2_000)], "id long, x double, y double")
    whole = proximity.members

    def counted(*given):
        held = whole(*given)
        met.append(held.count())
        return held

    monkeypatch.setattr(proximity, "members", counted)
    assert nearest(points, areas, "name", ties="rank", ascending=False).count() == 2_000
    assert sum(met) < 20 * 2_000
