"""Preprocessing rules, one by one and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..ml.preprocess import preprocess
from ..plans import fixed_values as V
from .registry import query
from .standins import cte, standin, table, wide, wide_sql_columns


@query(
    cte("props")
    + " SELECT parcelid, coalesce(garagetotalsqft, 0) AS garagetotalsqft, coalesce(area, 0e0) AS area, zoning FROM props"
)
def fillna_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = standin(spark, sf_dir, "props").select("parcelid", "garagetotalsqft", "area", "zoning")
    return props.fillna({"garagetotalsqft": 0, "area": 0, "zoning": "OTHER"})


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'OTHER' "
    "ELSE o_orderpriority END AS priority FROM orders"
)
def bin_rare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scalars.keep_or_bin(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "OTHER")
    return table(spark, sf_dir, "orders").select("o_orderkey", kept.alias("priority"))


@query(
    cte("props")
    + " SELECT parcelid, CASE WHEN area > 5000 THEN 1 ELSE 0 END AS area_bin, "
    "CASE WHEN zoning = 'BUILDING' THEN 1 ELSE 0 END AS zoning_flag FROM props"
)
def threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin(spark, sf_dir, "props").select(
        "parcelid",
        scalars.above(F.col("area"), 5000).alias("area_bin"),
        scalars.flag_to_number(F.col("zoning"), "BUILDING").alias("zoning_flag"),
    )


@query(
    cte("props")
    + " SELECT parcelid, garagecarcnt, CASE WHEN garagetotalsqft = 0 AND garagecarcnt > 0 THEN NULL "
    "ELSE garagetotalsqft END AS garagetotalsqft FROM props"
)
def null_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, cars = F.col("garagetotalsqft"), F.col("garagecarcnt")
    return standin(spark, sf_dir, "props").select(
        "parcelid", "garagecarcnt", scalars.null_when(size, (size == 0) & (cars > 0)).alias("garagetotalsqft")
    )


@query(
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, "
    "CAST(day(o_orderdate) AS INT) AS d FROM orders"
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")
    )


@query("SELECT p_partkey, round(p_retailprice + p_size, 6) AS total FROM part")
def sum_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(F.col("p_retailprice") + F.col("p_size"), 6)
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("total"))


@query(
    "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_number, "
    "TRY_CAST(p_name AS DOUBLE) AS name_number FROM part"
)
def try_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.try_number(scalars.strip_words(F.col("p_brand"), ("Brand#",))).alias("brand_number"),
        scalars.try_number(F.col("p_name")).alias("name_number"),
    )


@query(
    "SELECT c_custkey, round(ln(1 + c_acctbal + abs(least(m, 0))), 6) AS log_bal, "
    "round(sqrt(c_acctbal + abs(least(m, 0))), 6) AS sqrt_bal, round(power(c_custkey, 1e0 / 3), 6) AS root_key "
    "FROM customer, (SELECT min(c_acctbal) AS m FROM customer) x"
)
def shift_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    low = customer.agg(F.min("c_acctbal")).first()[0]
    return customer.select(
        "c_custkey",
        F.round(scalars.log_shift(F.col("c_acctbal"), low), 6).alias("log_bal"),
        F.round(scalars.sqrt_shift(F.col("c_acctbal"), low), 6).alias("sqrt_bal"),
        F.round(scalars.cube_root(F.col("c_custkey")), 6).alias("root_key"),
    )


# --- the whole rule set over the full-width property table --------------------------------------


def _plain(df: DataFrame) -> DataFrame:
    """Numbers as doubles with 6 decimals, so that both engines compare alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(F.round(c.cast("double"), 6).alias(f.name) if isinstance(f.dataType, T.NumericType) else c)
    return df.select(*out)


def _sql_literal(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _preprocess_sql(mode: str) -> str:
    columns = wide_sql_columns()
    kinds = {d.split()[0]: d.split()[1] for d in [*V.TRANSACTIONS, *V.PROPERTIES, *V.EXTERNAL_FEATURES]}
    source = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + " FROM orders"
    filled = ", ".join(
        f'coalesce("{c}", {_sql_literal(V.FILL[c])}) AS "{c}"' if c in V.FILL else f'"{c}"' for c in columns
    )
    shifted = [*V.LOG, *V.SQRT]
    lows = ", ".join(f'abs(least(coalesce(min("{c}"), 0), 0)) AS "low_{c}"' for c in shifted)
    numbers = {c: f'CAST(f."{c}" AS DOUBLE)' for c in columns}
    logs = {c: f'ln(1 + {numbers[c]} + "low_{c}")' for c in V.LOG}
    value: dict[str, str] = {}
    coded = mode == "as_coded"
    for c in columns:
        whole = kinds[c] == "INT"
        keep = {k: (ks, o) for k, ks, o in V.KEEP}
        if c in V.LOG and not (coded and (whole or c.startswith("distance"))):
            value[c] = logs[c]
        elif c in V.SQRT:
            value[c] = f'sqrt({numbers[c]} + "low_{c}")'
        elif c in V.CUBE_ROOT:
            value[c] = f"power({numbers[c]}, 1e0 / 3)"
        elif c in keep and not (coded and whole):
            kept, other = keep[c]
            inside = ", ".join(_sql_literal(v) for v in kept)
            value[c] = f'CASE WHEN f."{c}" NOT IN ({inside}) THEN {_sql_literal(other)} ELSE f."{c}" END'
        elif c == "taxdelinquencyflag":
            value[c] = "CASE WHEN f.taxdelinquencyflag = 'Y' THEN 1 ELSE 0 END"
        elif c == "garagetotalsqft" and not coded:
            value[c] = "CASE WHEN f.garagetotalsqft = 0 AND f.garagecarcnt > 0 THEN NULL ELSE f.garagetotalsqft END"
        else:
            value[c] = f'f."{c}"'
    for c, threshold in V.ABOVE:
        tested = logs[c] if c in logs and not coded else numbers[c]
        flag = f"CASE WHEN {tested} > {threshold} THEN 1 ELSE 0 END"
        if not coded:
            value[f"{c}_bin"] = flag
        elif kinds[c] != "INT":
            value[c] = flag
    for part, fn in (("year", "year"), ("month", "month"), ("day", "day")):
        value[f"transaction_{part}"] = f"{fn}(f.transactiondate)"
    texts = {c for c in columns if kinds[c] in ("STRING", "BOOLEAN", "DATE") and c != "taxdelinquencyflag"}
    selected = ", ".join(
        f'{e} AS "{c}"' if c in texts else f'round(CAST({e} AS DOUBLE), 6) AS "{c}"'
        for c, e in value.items()
        if c not in V.DROP
    )
    return f"WITH w AS ({source}), f AS (SELECT {filled} FROM w), m AS (SELECT {lows} FROM w) SELECT {selected} FROM f, m"


@query(_preprocess_sql("intended"))
def preprocess_intended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(preprocess(wide(spark, sf_dir)))


@query(_preprocess_sql("as_coded"))
def preprocess_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(preprocess(wide(spark, sf_dir), mode="as_coded"))
