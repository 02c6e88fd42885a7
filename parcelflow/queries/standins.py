"""Stand-in tables: arithmetic over the provided tables that Spark and SQL read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import (
    ALBERS_FALSE_NORTHING,
    ALBERS_ORIGIN,
    GRS80_A,
    MERCATOR_RADIUS,
    albers_constants,
)
from ..plans import fixed_values as V

SOUTH_E6, WEST_E6 = 33500000, -118900000

STANDINS: dict[str, tuple[str, dict[str, str]]] = {
    "props": (
        "customer",
        {
            "parcelid": "c_custkey",
            "latitude_e6": f"{SOUTH_E6} + (c_custkey * 7919) % 200000",
            "longitude_e6": f"{WEST_E6} + (c_custkey * 104729) % 200000",
            "garagecarcnt": "c_custkey % 5",
            "garagetotalsqft": "CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN NULL "
            "ELSE 200 + c_custkey % 400 END",
            "zoning": "c_mktsegment",
            "area": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END",
            "region": "c_nationkey",
        },
    ),
    "trans": (
        "orders",
        {
            "parcelid": "o_custkey",
            "logerror": "CAST(o_totalprice AS DOUBLE) / 1000000",
            "transactiondate": "CAST(o_orderdate AS DATE)",
            "period": "CAST(year(o_orderdate) AS INT)",
        },
    ),
    "extra": (
        "supplier",
        {"parcelid": "s_suppkey * 7", "elevation": "s_acctbal", "amenity": "s_nationkey"},
    ),
    "pois": (
        "part",
        {
            "poi_id": "p_partkey",
            "key": "p_brand",
            "value": "p_type",
            "latitude_e6": f"{SOUTH_E6} + (p_partkey * 6101) % 200000",
            "longitude_e6": f"{WEST_E6} + (p_partkey * 99991) % 200000",
        },
    ),
    "wide_pois": (  # spread over a larger area than the properties
        "part",
        {
            "poi_id": "p_partkey",
            "key": "p_brand",
            "value": "p_type",
            "latitude_e6": f"{SOUTH_E6} - 400000 + (p_partkey * 30509) % 1000000",
            "longitude_e6": f"{WEST_E6} - 400000 + (p_partkey * 499979) % 1000000",
        },
    ),
    "cities": (
        "supplier",
        {
            "name": "s_name",
            "population": "CAST(floor(s_acctbal * 100) AS BIGINT) + 100000",
            "latitude_e6": f"{SOUTH_E6} + (s_suppkey * 4999 + 31337) % 200000",
            "longitude_e6": f"{WEST_E6} + (s_suppkey * 77773 + 1234) % 200000",
        },
    ),
    "tracts": (
        "nation",
        {
            "tract": "n_nationkey",
            "x0_e6": f"{WEST_E6} + 40000 * (n_nationkey % 5)",
            "y0_e6": f"{SOUTH_E6} + 40000 * CAST(floor(n_nationkey / 5) AS BIGINT)",
            "people": "CAST(1000 + n_regionkey * 250 AS DOUBLE)",
            "homes": "CAST(400 + n_nationkey AS DOUBLE)",
        },
    ),
    "dem": (
        "part",
        {
            "row": "CAST(floor(p_partkey / 40) AS BIGINT)",
            "col": "p_partkey % 40",
            "value": "p_size",
        },
    ),
    "flags": (
        "lineitem",
        {
            "is_returned": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag = 'R' END",
            "is_open": "CASE WHEN l_quantity > 45 THEN NULL ELSE l_linestatus = 'O' END",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = STANDINS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def cte(*names: str) -> str:
    """``WITH`` clause that defines the stand-ins in SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({standin_sql(n)})" for n in names)


def standin_sql(name: str) -> str:
    source, columns = STANDINS[name]
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source}"


# --- geometry in SQL ------------------------------------------------------------------------


def albers_sql(lat: str, lon: str) -> tuple[str, str]:
    k = {n: f"{v:.17e}" for n, v in albers_constants().items()}
    one_e2 = f"{1 - albers_constants()['e'] ** 2:.17e}"
    s = f"sin(radians({lat}))"
    es = f"({k['e']} * {s})"
    q = f"({one_e2} * ({s} / (1e0 - {es} * {es}) - ln((1e0 - {es}) / (1e0 + {es})) / (2e0 * {k['e']})))"
    rho = f"({GRS80_A:.1f}e0 * sqrt({k['c']} - {k['n']} * {q}) / {k['n']})"
    theta = f"({k['n']} * radians({lon} - ({ALBERS_ORIGIN[1]:.1f}e0)))"
    return f"{rho} * sin({theta})", f"{k['rho0']} - {rho} * cos({theta}) + ({ALBERS_FALSE_NORTHING:.1f}e0)"


def located_sql(name: str, columns: str) -> str:
    """Stand-in rows with Albers metres ``ax, ay``."""
    x, y = albers_sql("latitude_e6 * 1e-6", "longitude_e6 * 1e-6")
    return f"SELECT {columns}, {x} AS ax, {y} AS ay FROM {name}"


def mercator_sql(lat: str, lon: str) -> tuple[str, str]:
    return (
        f"{MERCATOR_RADIUS:.1f}e0 * radians({lon})",
        f"{MERCATOR_RADIUS:.1f}e0 * ln(tan(pi() / 4 + radians({lat}) / 2))",
    )


# --- a property table of full width -----------------------------------------------------------

_PICKS = {
    "heatingorsystemtypeid": [2, 7, 13, 20],
    "airconditioningtypeid": [1, 5, 13],
    "propertylandusetypeid": [261, 266, 246, 269, 31],
    "fips": [6037, 6059, 6111],
    "regionidcounty": [3101, 1286, 2061],
    "garagecarcnt": [0, 1, 2, 3],
    "garagetotalsqft": [0, 240, 400, 441],
    "propertyzoningdesc": ["LAR1", "LAR3", "LBR1N", "LARD1.5", "SCUR2", "LCA11"],
    "propertycountylandusecode": ["0100", "122", "010C", "34", "1", "96", "0700"],
    "taxdelinquencyflag": ["Y", "N"],
}
_NEGATIVE = {"elevation": 30, "bar": 5}


def wide_sql_columns() -> dict[str, str]:
    """Column -> expression over ``orders`` for the transactions, properties and feature columns."""
    out = {
        "parcelid": "CAST(o_custkey AS INT)",
        "logerror": "CAST((o_orderkey % 400 - 200) / 1024e0 AS FLOAT)",
        "transactiondate": "CAST(o_orderdate AS DATE)",
    }
    k = "o_orderkey"
    for j, ddl in enumerate([*V.PROPERTIES, *V.EXTERNAL_FEATURES]):
        name, kind = ddl.split()[:2]
        if name in out:
            continue
        if name in _PICKS:
            picks = _PICKS[name]
            lit = [f"'{v}'" if isinstance(v, str) else str(v) for v in picks]
            arms = " ".join(f"WHEN ({k} * {j + 3} + {j}) % {len(picks)} = {i} THEN {v}" for i, v in enumerate(lit))
            value = f"CASE {arms} END"
        elif kind == "INT":
            value = f"CAST(({k} * {2 * j + 3} + {j}) % 97 AS INT)"
        elif kind == "FLOAT":
            value = f"CAST((({k} * {2 * j + 3} + {j}) % 1009 - {_NEGATIVE.get(name, 0)}) / 8e0 AS FLOAT)"
        elif kind == "BOOLEAN":
            value = f"({k} + {j}) % 2 = 0"
        else:
            value = f"concat('v', CAST(({k} * 3 + {j}) % 23 AS STRING))"
        if kind == "INT":
            value = f"CAST({value} AS INT)"
        out[name] = f"CASE WHEN ({k} + {j}) % {5 + j % 4} = 0 THEN NULL ELSE {value} END"
    return out


_TASK_ROWS = 100_000  # wide rows that make a task of some seconds


def wide(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Orders dressed as the full property table (transactions, properties, features).

    A file of one row group is read by one task, and so is all that is written from it where it lies; with ``spread`` the few columns of
    the orders go to all cores before they are dressed.
    """
    orders = table(spark, sf_dir, "orders")
    if spread:
        orders = orders.repartition(max(3 * spark.sparkContext.defaultParallelism, orders.count() // _TASK_ROWS))
    return orders.selectExpr(*[f"{e} AS `{c}`" for c, e in wide_sql_columns().items()])
