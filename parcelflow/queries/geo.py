"""Geospatial functions and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.hull import convex_hull as hull_of
from ..operators.hull import select_pois
from ..operators.polygons import area_density, points_in_polygons
from ..operators.proximity import count_within, nearest, nearest_by_type
from ..operators.raster import raster_lookup
from ..plans.features import FeatureSources, geo_features, projected
from ..plans.features import city_features as near_cities
from .registry import query
from .standins import SOUTH_E6, WEST_E6, albers_sql, cte, located_sql, mercator_sql, standin, table

# Parameters of the stand-in jobs, shared with their SQL.
RADIUS = 500
BIG = 250000
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
KEYS = {b: "n_" + b.lower().replace("#", "") for b in BRANDS}
TYPES = {t: "near_" + t.lower() for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "ABSENT")}
PRESENT = [t for t in TYPES if t != "ABSENT"]
TAGS = {b: ["ECONOMY", "LARGE", "PROMO"] for b in BRANDS[:12]}
DEM_STEP_E6 = 4000
HULL_BUFFER_E6 = 200000


def _degrees(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"latitude": geo.from_micro(F.col("latitude_e6")), "longitude": geo.from_micro(F.col("longitude_e6"))}
    )


def _metres(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return projected(_degrees(standin(spark, sf_dir, name)))


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metres(spark, sf_dir, "props").select("parcelid", "x", "y")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


_GAP = "sqrt((h.ax - c.ax) * (h.ax - c.ax) + (h.ay - c.ay) * (h.ay - c.ay))"
_POINTS = (
    cte("props", "pois", "cities")
    + f", h AS ({located_sql('props', 'parcelid, latitude_e6, longitude_e6, region, area')})"
    + f", p AS ({located_sql('pois', 'poi_id, key, value')})"
    + f", c AS ({located_sql('cities', 'name, population, latitude_e6, longitude_e6')})"
)
_NEAREST = (
    "SELECT * FROM (SELECT h.parcelid, c.name, c.population, {gap} AS distance, row_number() OVER ("
    "PARTITION BY h.parcelid ORDER BY {gap}, c.population DESC, c.name) AS rn FROM h, c WHERE {where}) n WHERE rn = 1"
)
_CLOSE = _NEAREST.format(gap=_GAP, where="true")
_CLOSE_BIG = _NEAREST.format(gap=_GAP, where=f"c.population > {BIG}")


@query(
    cte("props")
    + f", h AS ({located_sql('props', 'parcelid')}) SELECT parcelid, round(ax, 3) AS x, round(ay, 3) AS y FROM h"
)
def project_albers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_props(spark, sf_dir), 3, "x", "y")


def _haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - ({lat1})) / 2), 2)"
    b = f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)"
    return f"(12742 * asin(sqrt({a} + {b})))"


@query(
    _POINTS
    + f""", n AS ({_CLOSE}), od AS (
      SELECT h.parcelid, h.latitude_e6 * 1e-6 AS la, h.longitude_e6 * 1e-6 AS lo, c.latitude_e6 * 1e-6 AS lb,
             c.longitude_e6 * 1e-6 AS lp
      FROM n JOIN h ON n.parcelid = h.parcelid JOIN c ON n.name = c.name)
    SELECT parcelid, round({_haversine_sql('la', 'lo', 'lb', 'lp')}, 6) AS haversine_km,
      round({_haversine_sql('la', 'lo', 'la', 'lp')} + {_haversine_sql('la', 'lo', 'lb', 'lo')}, 6) AS manhattan_km,
      round(degrees(atan2(sin(radians(lp - lo)) * cos(radians(lb)), cos(radians(la)) * sin(radians(lb))
        - sin(radians(la)) * cos(radians(lb)) * cos(radians(lp - lo)))), 6) AS bearing FROM od"""
)
def geo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin-destination table: each property and its nearest city."""
    cities = _metres(spark, sf_dir, "cities").select(
        "name", "population", "x", "y", geo.coordinates(F.col("latitude"), F.col("longitude")).alias("to")
    )
    props = _metres(spark, sf_dir, "props").select(
        "parcelid", "x", "y", geo.coordinates(F.col("latitude"), F.col("longitude")).alias("from")
    )
    pairs = nearest(props, cities, "name", ties="population", ascending=False, columns=["to"])
    start, end = F.col("from"), F.col("to")
    return _rounded(
        pairs.select(
            "parcelid",
            geo.haversine(start, end).alias("haversine_km"),
            geo.manhattan(start, end).alias("manhattan_km"),
            geo.bearing(start, end).alias("bearing"),
        ),
        6,
        "haversine_km",
        "manhattan_km",
        "bearing",
    )


def _geohash_sql(lat: str, lon: str, characters: int) -> tuple[str, str]:
    cells = (
        f"CAST(floor(({lon} + 180) / 360 * {1 << 50}) AS BIGINT) AS gx, "
        f"CAST(floor(({lat} + 90) / 180 * {1 << 50}) AS BIGINT) AS gy"
    )
    parts = []
    for i in range(characters):
        bits = [
            f"((({'gx' if p % 2 == 0 else 'gy'} >> {49 - p // 2}) & 1) << {4 - b})" for b, p in enumerate(range(5 * i, 5 * i + 5))
        ]
        parts.append(f"substr('{geo.GEOHASH_ALPHABET}', CAST({' + '.join(bits)} AS BIGINT) + 1, 1)")
    return cells, "concat(" + ", ".join(parts) + ")"


_CELLS, _HASH = _geohash_sql("latitude_e6 * 1e-6", "longitude_e6 * 1e-6", 15)


@query(
    cte("props")
    + f""", g AS (SELECT *, {_CELLS} FROM props), t AS (SELECT substr({_HASH}, 1, 5 + region % 11) AS geohash, area FROM g)
    SELECT geohash, count(*) AS n, round(avg(area), 6) AS mean_area FROM t GROUP BY geohash"""
)
def geohash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate per geohash, with the precision taken from a column."""
    props = _degrees(standin(spark, sf_dir, "props"))
    cell = geo.geohash(geo.coordinates(F.col("latitude"), F.col("longitude")), 5 + F.col("region") % 11)
    buckets = props.groupBy(cell.alias("geohash")).agg(F.count("*").alias("n"), F.avg("area").alias("mean_area"))
    return _rounded(buckets, 6, "mean_area")


_ELEVATION = (
    "SELECT parcelid, d.value AS elevation FROM props LEFT JOIN dem d ON "
    f"d.\"row\" = CAST(floor((latitude_e6 - {SOUTH_E6}) / {DEM_STEP_E6}e0) AS BIGINT) AND "
    f"d.col = CAST(floor((longitude_e6 - ({WEST_E6})) / {DEM_STEP_E6}e0) AS BIGINT)"
)


@query(cte("props", "dem") + " " + _ELEVATION)
def elevation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = standin(spark, sf_dir, "props").select(
        "parcelid", F.col("longitude_e6").alias("x"), F.col("latitude_e6").alias("y")
    )
    raster = standin(spark, sf_dir, "dem")
    return raster_lookup(points, raster, WEST_E6, SOUTH_E6, DEM_STEP_E6).select("parcelid", "elevation")


_COUNTS = (
    "SELECT h.parcelid, "
    + ", ".join(f"count(*) FILTER (c.key = '{b}') AS {n}" for b, n in KEYS.items())
    + f" FROM h LEFT JOIN p c ON {_GAP} <= {RADIUS} GROUP BY h.parcelid"
)


@query(_POINTS + " " + _COUNTS)
def poi_count_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    pois = _metres(spark, sf_dir, "pois").select("key", "x", "y")
    return count_within(_props(spark, sf_dir), pois, RADIUS, KEYS).drop("x", "y")


# A hull corner sees all other points within less than half a turn.
_HULL = """
    s AS (SELECT DISTINCT longitude_e6 AS x, latitude_e6 AS y FROM props),
    t AS (SELECT a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS turn FROM s a JOIN s b ON a.x <> b.x OR a.y <> b.y),
    g AS (SELECT x, y, turn - lag(turn) OVER (PARTITION BY x, y ORDER BY turn) AS gap,
                 min(turn) OVER (PARTITION BY x, y) + 2 * pi() - max(turn) OVER (PARTITION BY x, y) AS wrap FROM t),
    hull AS (SELECT x, y FROM g GROUP BY x, y HAVING greatest(coalesce(max(gap), 0), max(wrap)) > pi() + 1e-12)
"""


@query(cte("props") + "," + _HULL + " SELECT x, y FROM hull")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = standin(spark, sf_dir, "props").select(F.col("longitude_e6").alias("x"), F.col("latitude_e6").alias("y"))
    return hull_of(points).select(F.col("x").cast("bigint"), F.col("y").cast("bigint"))


_SEGMENT = (
    "greatest(0e0, least(1e0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) "
    "/ ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
)


@query(
    cte("props", "wide_pois")
    + ","
    + _HULL
    + f""", m AS (SELECT avg(x) AS mx, avg(y) AS my FROM hull),
    o AS (SELECT x, y, row_number() OVER (ORDER BY atan2(y - my, x - mx)) AS i, count(*) OVER () AS k FROM hull, m),
    e AS (SELECT CAST(a.x AS DOUBLE) AS x1, CAST(a.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x2, CAST(b.y AS DOUBLE) AS y2
          FROM o a JOIN o b ON b.i = a.i % a.k + 1),
    w AS (SELECT poi_id, longitude_e6 AS px, latitude_e6 AS py FROM wide_pois
          WHERE key IN ({", ".join(f"'{b}'" for b in TAGS)}) AND value IN ('ECONOMY', 'LARGE', 'PROMO')),
    d AS (SELECT poi_id, x1, y1, x2, y2, px, py, {_SEGMENT} AS f FROM w, e)
    SELECT poi_id FROM d GROUP BY poi_id
    HAVING min((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) >= 0
        OR min(sqrt(pow(px - x1 - f * (x2 - x1), 2) + pow(py - y1 - f * (y2 - y1), 2))) <= {HULL_BUFFER_E6}"""
)
def poi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POIs with a requested tag within a buffer around the hull of the properties."""
    points = standin(spark, sf_dir, "props").select(F.col("longitude_e6").alias("x"), F.col("latitude_e6").alias("y"))
    pois = standin(spark, sf_dir, "wide_pois").select(
        "poi_id", "key", "value", F.col("longitude_e6").alias("x"), F.col("latitude_e6").alias("y")
    )
    return select_pois(pois, TAGS, hull_of(points), HULL_BUFFER_E6).select("poi_id")


_BY_TYPE = (
    "SELECT h.parcelid, "
    + ", ".join(f"min({_GAP}) FILTER (c.value = '{t}') AS {TYPES[t]}" for t in PRESENT)
    + " FROM h, p c GROUP BY h.parcelid"
)


@query(
    _POINTS + f", t AS ({_BY_TYPE}) SELECT parcelid, " + ", ".join(f"round({TYPES[t]}, 3) AS {TYPES[t]}" for t in PRESENT) + " FROM t"
)
def nearest_poi_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One distance column per type that occurs; a type without POIs gives no column."""
    pois = _metres(spark, sf_dir, "pois").select("value", "x", "y")
    near = nearest_by_type(_props(spark, sf_dir), pois, TYPES)
    return _rounded(near.drop("x", "y"), 3, *[c for c in near.columns if c.startswith("near_")])


def _city_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metres(spark, sf_dir, "cities").select("name", "population", "x", "y")


def _near_city(props: DataFrame, cities: DataFrame) -> DataFrame:
    near = nearest(props, cities, "name", ties="population", ascending=False, columns=["name", "population"])
    return _rounded(near.select("parcelid", "name", "population", "distance"), 3, "distance")


@query(_POINTS + f", n AS ({_CLOSE}) SELECT parcelid, name, population, round(distance, 3) AS distance FROM n")
def nearest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_city(_props(spark, sf_dir), _city_table(spark, sf_dir))


@query(_POINTS + f", n AS ({_CLOSE_BIG}) SELECT parcelid, name, population, round(distance, 3) AS distance FROM n")
def nearest_big_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_city(_props(spark, sf_dir), _city_table(spark, sf_dir).filter(F.col("population") > BIG))


# City areas: squares of 2 to 5 km around the city's point.
_HALF = "(1000 + population % 1500)"
_CITY_EDGES = f"""
    sq AS (SELECT name, population, ax - {_HALF} AS xa, ax + {_HALF} AS xb, ay - {_HALF} AS ya, ay + {_HALF} AS yb FROM c),
    a AS (SELECT h.parcelid, sq.name, sq.population,
                 sqrt(pow(greatest(xa - h.ax, h.ax - xb, 0), 2) + pow(greatest(ya - h.ay, h.ay - yb, 0), 2)) AS distance
          FROM h, sq)
"""


@query(
    _POINTS
    + f""",{_CITY_EDGES}
    SELECT parcelid, name, population, round(distance, 3) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY parcelid ORDER BY distance, population DESC, name) AS rn FROM a) n
    WHERE rn = 1"""
)
def nearest_city_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest city polygon: 0 inside, ties by population."""
    half = 1000 + F.col("population") % 1500
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    ring = F.array(
        *[F.struct((F.col("x") + i * half).alias("x"), (F.col("y") + j * half).alias("y")) for i, j in corners]
    )
    areas = _city_table(spark, sf_dir).select("name", "population", geo.ring_edges(ring).alias("edges"))
    return _near_city(_props(spark, sf_dir), areas)


@query(
    _POINTS
    + f""", a AS ({_CLOSE}), b AS ({_CLOSE_BIG})
    SELECT a.parcelid, a.name AS name_close_city, a.population AS population_close_city,
           round(a.distance, 3) AS distance_close_city, b.name AS name_close_big_city,
           b.population AS population_close_big_city, round(b.distance, 3) AS distance_close_big_city
    FROM a JOIN b ON a.parcelid = b.parcelid"""
)
def city_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_cities(_props(spark, sf_dir), _city_table(spark, sf_dir), BIG)
    return _rounded(near, 3, "distance_close_city", "distance_close_big_city")


def _tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census boxes as web Mercator rings."""
    box = [("x0_e6", "y0_e6", 0, 0), ("x0_e6", "y0_e6", 40000, 0), ("x0_e6", "y0_e6", 40000, 40000), ("x0_e6", "y0_e6", 0, 40000)]
    corners = []
    for x, y, dx, dy in box:
        mx, my = geo.mercator(geo.from_micro(F.col(y) + dy), geo.from_micro(F.col(x) + dx))
        corners.append(F.struct(mx.alias("x"), my.alias("y")))
    return standin(spark, sf_dir, "tracts").select("tract", "people", "homes", F.array(*corners).alias("ring"))


_X0, _Y0 = mercator_sql("y0_e6 * 1e-6", "x0_e6 * 1e-6")
_X1, _Y1 = mercator_sql("(y0_e6 + 40000) * 1e-6", "(x0_e6 + 40000) * 1e-6")
_DENSITY = f"SELECT tract, x0_e6, y0_e6, ({_X1} - ({_X0})) * ({_Y1} - ({_Y0})) AS area, people, homes FROM tracts"
_IN_TRACT = (
    "LEFT JOIN d ON p.longitude_e6 BETWEEN d.x0_e6 AND d.x0_e6 + 40000 AND p.latitude_e6 BETWEEN d.y0_e6 AND d.y0_e6 + 40000"
)


@query(
    cte("tracts")
    + f", d AS ({_DENSITY}) SELECT tract, round(area, 3) AS area, round(people / area * 1e6, 6) AS people_km2, "
    "round(homes / area * 1e6, 6) AS homes_km2 FROM d"
)
def census_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = area_density(_tracts(spark, sf_dir), ["people", "homes"])
    return dense.select(
        "tract",
        F.round("area", 3).alias("area"),
        F.round(F.col("people") * 1e6, 6).alias("people_km2"),
        F.round(F.col("homes") * 1e6, 6).alias("homes_km2"),
    )


@query(
    cte("tracts", "props")
    + f", d AS ({_DENSITY}) SELECT p.parcelid, d.tract, round(people / d.area * 1e6, 6) AS people_km2, "
    f"round(homes / d.area * 1e6, 6) AS homes_km2 FROM props p {_IN_TRACT}"
)
def census_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = area_density(_tracts(spark, sf_dir), ["people", "homes"])
    degrees = dense.withColumn("ring", geo.mercator_ring_to_degrees(F.col("ring")))
    points = _degrees(standin(spark, sf_dir, "props")).select(
        "parcelid", F.col("longitude").alias("x"), F.col("latitude").alias("y")
    )
    mapped = points_in_polygons(points, degrees, ["tract", "people", "homes"], "tract", digits=9)
    return mapped.select(
        "parcelid",
        "tract",
        F.round(F.col("people") * 1e6, 6).alias("people_km2"),
        F.round(F.col("homes") * 1e6, 6).alias("homes_km2"),
    )


@query(
    cte("props", "pois", "cities", "dem", "tracts")
    + f", h AS ({located_sql('props', 'parcelid')}), p AS ({located_sql('pois', 'key, value')})"
    + f", c AS ({located_sql('cities', 'name, population')}), d AS ({_DENSITY})"
    + f", el AS ({_ELEVATION}), co AS ({_COUNTS}), ty AS ({_BY_TYPE}), a AS ({_CLOSE}), b AS ({_CLOSE_BIG})"
    + f", ce AS (SELECT p.parcelid, people / d.area AS people, homes / d.area AS homes FROM props p {_IN_TRACT})"
    + " SELECT h.parcelid, el.elevation, "
    + ", ".join(f"co.{n}" for n in KEYS.values())
    + ", round(ce.people * 1e6, 6) AS people, a.name AS name_close_city, a.population AS population_close_city, "
    "round(a.distance, 3) AS distance_close_city, b.name AS name_close_big_city, "
    "b.population AS population_close_big_city, round(b.distance, 3) AS distance_close_big_city, "
    + ", ".join(f"round(ty.{TYPES[t]}, 3) AS {TYPES[t]}" for t in PRESENT if t != "SMALL")
    + " FROM h JOIN el ON h.parcelid = el.parcelid JOIN co ON h.parcelid = co.parcelid JOIN ce ON h.parcelid = ce.parcelid "
    "JOIN a ON h.parcelid = a.parcelid JOIN b ON h.parcelid = b.parcelid JOIN ty ON h.parcelid = ty.parcelid"
)
def feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table; two redundant columns are dropped at the end."""
    props = standin(spark, sf_dir, "props").select(
        "parcelid", F.col("latitude_e6").alias("latitude"), F.col("longitude_e6").alias("longitude")
    )
    sources = FeatureSources(
        pois=_degrees(standin(spark, sf_dir, "pois")),
        raster=standin(spark, sf_dir, "dem"),
        tracts=_tracts(spark, sf_dir),
        cities=_degrees(standin(spark, sf_dir, "cities")),
        raster_lon=WEST_E6 * 1e-6,
        raster_lat=SOUTH_E6 * 1e-6,
        raster_step=DEM_STEP_E6 * 1e-6,
        variables=["people", "homes"],
        keys=KEYS,
        types=TYPES,
        radius=RADIUS,
        big_city=BIG,
        drop=["homes", "near_small"],
    )
    features = geo_features(props, sources)
    metres = [c for c in features.columns if c.startswith(("near_", "distance_"))]
    return _rounded(features.withColumn("people", F.round(F.col("people") * 1e6, 6)), 3, *metres)


# Nations as square parts of 8 units, with a hole of 4 in the first; a second part lies above.
_PARTS = {"outer": (4.0, 0.0), "hole": (2.0, 0.0), "above": (1.0, 8.0)}


@query(
    """
    WITH p AS (SELECT c_custkey, c_custkey % 250 + 0.3e0 AS x, c_custkey * 7 % 190 / 10e0 - 5.05e0 AS y FROM customer),
    q AS (SELECT *, n_nationkey, 10e0 * n_nationkey + 5 AS mx FROM p, nation),
    held AS (SELECT c_custkey, n_nationkey FROM q WHERE
      (abs(x - mx) < 4 AND abs(y) < 4 AND NOT (abs(x - mx) < 2 AND abs(y) < 2)) OR (abs(x - mx) < 1 AND abs(y - 8) < 1))
    SELECT p.c_custkey, h.n_nationkey, CASE WHEN h.n_nationkey IS NOT NULL THEN round(1 / (64e0 - 16 + 4), 9) END AS density
    FROM p LEFT JOIN held h ON p.c_custkey = h.c_custkey"""
)
def multi_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in polygons with parts and holes, and densities over their area."""
    middle = 10.0 * F.col("n_nationkey") + 5
    ring = lambda half, up: F.array(
        *[F.struct((middle + a * half).alias("x"), F.lit(up + b * half).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    )
    nations = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lit(1.0).alias("density"), F.array(*[ring(h, u) for h, u in _PARTS.values()]).alias("rings")
    )
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k, (k % 250 + 0.3).alias("x"), (k * 7 % 190 / 10.0 - 5.05).alias("y"))
    held = points_in_polygons(points, area_density(nations, ["density"]), ["n_nationkey", "density"], "n_nationkey")
    return held.select("c_custkey", "n_nationkey", F.round("density", 9).alias("density"))
