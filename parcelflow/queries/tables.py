"""Sources, joins, unions and dedupes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Grid, merge_georeferenced, merge_tiles
from ..operators.relational import first_per_key, merge_suffixed
from ..scratch import scratch_path
from ..sources.places import append_areas, attach_population, clean_places, select_areas
from ..sources.tables import read_tables, scan, write_features
from .registry import query
from .standins import cte, standin, standin_sql, table

_CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def typed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).option("delimiter", "|").csv(path)
    return scan(spark, path, _CUSTOMER, delimiter="|")


@query(
    cte("props", "trans", "extra")
    + """
    SELECT t.parcelid, t.logerror, t.transactiondate, p.latitude_e6 AS latitude, p.longitude_e6 AS longitude,
           p.garagecarcnt, p.zoning, p.area, e.elevation, CAST(e.amenity AS INT) AS amenity
    FROM trans t JOIN props p ON t.parcelid = p.parcelid LEFT JOIN extra e ON t.parcelid = e.parcelid"""
)
def ingest_join_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, trans, extra = (scratch_path(spark, n) for n in ("properties", "transactions", "features"))
    options = {"header": True}
    sold = standin(spark, sf_dir, "trans")
    sold.write.partitionBy("period").options(**options).csv(trans)
    columns = ["parcelid", "latitude_e6", "longitude_e6", "garagecarcnt", "zoning", "area"]
    standin(spark, sf_dir, "props").select(columns).write.options(**options).csv(props)
    write_features(standin(spark, sf_dir, "extra"), extra)
    periods = sorted(r[0] for r in sold.select("period").distinct().collect())  # one per year
    config = {
        "files": {p: {"transactions": f"{trans}/period={p}", "properties": props} for p in periods},
        "schema": {
            "transactions": ["parcelid BIGINT NOT NULL", "logerror DOUBLE", "transactiondate DATE"],
            "properties": [
                "parcelid BIGINT NOT NULL", "latitude BIGINT", "longitude BIGINT", "garagecarcnt BIGINT",
                "zoning STRING", "area DOUBLE",
            ],
            "external_features": ["parcelid BIGINT NOT NULL", "elevation DOUBLE", "amenity INT"],
        },
        "format": "csv",
        "header": "true",
        "delimiter": ",",
    }
    return read_tables(spark, config, extra)


@query(cte("extra") + " SELECT parcelid, elevation, CAST(amenity AS INT) AS amenity FROM extra")
def feature_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    write_features(standin(spark, sf_dir, "extra").select("elevation", "amenity", "parcelid"), path)
    return scan(spark, path, "parcelid BIGINT, elevation DOUBLE, amenity INT")


_RAW_PLACES = (
    "SELECT concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ' city' WHEN s_suppkey % 3 = 1 THEN ' town' "
    "ELSE ' city town city' END) AS place, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE s_acctbal END AS y2017, "
    "s_nationkey AS y2016 FROM supplier"
)
_RAW_CITIES = (
    "SELECT s_suppkey * 2 + d AS city_id, concat(s_name, CASE WHEN s_suppkey % 4 = 0 THEN ' County' ELSE '' END) AS name "
    "FROM supplier, (SELECT 0 AS d UNION ALL SELECT 1 AS d) copies"
)


@query(
    f"""
    WITH places AS (
      SELECT replace(replace(place, ' city', ''), ' town', '') AS name, y2017 AS population FROM ({_RAW_PLACES}) r
      WHERE place IS NOT NULL AND y2017 IS NOT NULL AND y2016 IS NOT NULL),
    once AS (SELECT name, min(city_id) AS city_id FROM ({_RAW_CITIES}) c GROUP BY name)
    SELECT o.name, o.city_id, p.population FROM once o LEFT JOIN places p ON o.name = p.name
    WHERE NOT contains(lower(o.name), 'county')"""
)
def place_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    raw = spark.sql(_RAW_PLACES.replace("FROM supplier", "FROM {supplier}"), supplier=supplier)
    each = supplier.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    county = F.when(F.col("s_suppkey") % 4 == 0, " County").otherwise("")
    cities = each.select(
        (F.col("s_suppkey") * 2 + F.col("d")).alias("city_id"), F.concat("s_name", county).alias("name")
    )
    return attach_population(cities, clean_places(raw, "place", "y2017"), "city_id")


@query(
    """
    SELECT n_name AS area, n_nationkey AS tract, CAST(n_regionkey AS BIGINT) AS people, CAST(NULL AS BIGINT) AS homes
    FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_20')
    UNION ALL
    SELECT r_name AS area, r_regionkey AS tract, CAST(NULL AS BIGINT) AS people, CAST(r_regionkey + 10 AS BIGINT) AS homes
    FROM region"""
)
def census_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "nation").selectExpr(
        "n_name AS area", "n_nationkey AS tract", "CAST(n_regionkey AS BIGINT) AS people"
    )
    small = table(spark, sf_dir, "region").selectExpr(
        "r_name AS area", "r_regionkey AS tract", "CAST(r_regionkey + 10 AS BIGINT) AS homes"
    )
    return append_areas([select_areas(big, ["NATION_20", "NATION_3", "NATION_11", "NATION_7", "NOWHERE"]), small])


@query(
    """
    WITH cells AS (
      SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS "row", p_partkey % 40 AS col,
        CASE WHEN p_size % 5 > 0 THEN p_size END AS value, 0 AS tile FROM part
      UNION ALL
      SELECT CAST(floor(p_partkey / 40) AS BIGINT) + 10 AS "row", p_partkey % 40 + 5 AS col,
        CASE WHEN p_size % 7 > 0 THEN -p_size END AS value, 1 AS tile
      FROM part)
    SELECT "row", col, value FROM (
      SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY value IS NULL, tile) AS rn FROM cells) c
    WHERE rn = 1"""
)
def raster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first tile has no value, the second one's counts."""
    dem = standin(spark, sf_dir, "dem")
    value = F.col("value")
    first = dem.withColumn("value", F.when(value % 5 > 0, value))
    second = dem.select(
        (F.col("row") + 10).alias("row"), (F.col("col") + 5).alias("col"), F.when(value % 7 > 0, -value).alias("value")
    )
    return merge_tiles([first, second])


@query(
    """
    WITH dem AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS r, p_partkey % 40 AS c, p_size AS value FROM part),
    coarse AS (
      SELECT value, CAST(ceil((35 + c * 25) / 10.0 - 0.5) AS BIGINT) AS c0, CAST(ceil((60 + c * 25) / 10.0 - 0.5) AS BIGINT) AS c1,
        CAST(ceil((975 - r * 25) / 10.0 - 0.5) AS BIGINT) AS r0, CAST(ceil((1000 - r * 25) / 10.0 - 0.5) AS BIGINT) AS r1
      FROM dem),
    wide AS (SELECT value, r0, r1, unnest(range(c0, c1)) AS col FROM coarse),
    cells AS (
      SELECT r AS "row", c AS col, CASE WHEN value % 5 > 0 THEN value END AS value, 0 AS tile FROM dem
      UNION ALL
      SELECT unnest(range(r0, r1)) AS "row", col, CASE WHEN value % 7 > 0 THEN -value END AS value, 1 AS tile FROM wide)
    SELECT "row", col, value FROM (
      SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY value IS NULL, tile) AS rn FROM cells) c
    WHERE rn = 1"""
)
def raster_georeferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of 10 units and one of 25 with another origin and rows counted downwards, on the first one's grid."""
    dem = standin(spark, sf_dir, "dem")
    value = F.col("value")
    fine = dem.withColumn("value", F.when(value % 5 > 0, value))
    coarse = dem.withColumn("value", F.when(value % 7 > 0, -value))
    return merge_georeferenced([(fine, Grid(0, 0, 10, 10)), (coarse, Grid(35, 1000, 25, -25))])


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
    WHERE rn = 1"""
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    f"SELECT parcelid, garagetotalsqft, area FROM ({standin_sql('props')}) p "
    "WHERE garagetotalsqft IS NOT NULL AND area IS NOT NULL"
)
def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "props").select("parcelid", "garagetotalsqft", "area").dropna("any")


@query(
    """
    WITH p AS (SELECT l_suppkey AS k, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1),
    q AS (SELECT s_suppkey AS k, s_name, s_nationkey AS n FROM supplier)
    SELECT p.k, p.n AS n_line, p.quantity, q.s_name, q.n AS n_supplier FROM p JOIN q ON p.k = q.k"""
)
def suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join on the key; the clashing column gets a suffix on each side."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"))
    lines = lines.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name", "s_nationkey AS n")
    return merge_suffixed(lines, suppliers, "k", ("_line", "_supplier"))
