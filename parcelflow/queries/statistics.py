"""Exploratory statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators.correlations import correlation
from ..operators.correlations import top_correlations as strongest
from ..operators.sampling import sample
from ..plans.training import train_test
from .registry import query
from .standins import cte, standin, standin_sql, table

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query(
    "SELECT l_returnflag, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 3) AS percent "
    "FROM lineitem GROUP BY l_returnflag"
)
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag")


_PROPS_FIELDS = ["parcelid", "garagecarcnt", "garagetotalsqft", "zoning", "area", "region"]


@query(
    cte("props")
    + " UNION ALL ".join(
        f" SELECT '{c}' AS field, round((1 - count({c}) * 1e0 / count(*)) * 100, 6) AS missing_percent FROM props "
        for c in _PROPS_FIELDS
    )
)
def missing_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.missing_percent(standin(spark, sf_dir, "props").select(_PROPS_FIELDS)), 6, "missing_percent")


def _describe_sql() -> str:
    rows = []
    for c in ["parcelid", "garagetotalsqft", "area", "region"]:
        rows.append(
            f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS min_text, "
            f"CAST(NULL AS VARCHAR) AS max_text FROM props"
        )
    rows.append(
        "SELECT 'zoning' AS field, count(zoning) AS count, NULL AS mean, NULL AS stddev, NULL AS min, NULL AS max, "
        "min(zoning) AS min_text, max(zoning) AS max_text FROM props"
    )
    return cte("props") + " UNION ALL ".join(f" {r} " for r in rows)


@query(_describe_sql())
def describe_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = standin(spark, sf_dir, "props").select("parcelid", "garagetotalsqft", "area", "region", "zoning")
    return _rounded(S.describe_long(props), 6, "mean", "stddev")


def _summary_sql(spread: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS count, min({c}) AS min, quantile_disc({c}, 0.25) AS q1, "
        f"quantile_disc({c}, 0.5) AS median, quantile_disc({c}, 0.75) AS q3, max({c}) AS max, avg({c}) AS mean, "
        f"stddev_samp({c}) AS stddev FROM lineitem"
        for c in _LINE
    )
    return f"""
    WITH s AS ({rows}), k AS (SELECT *, 3 * (mean - median) / stddev AS skewness FROM s)
    SELECT field, count, min, round(q1 - 1.5 * {spread}, 6) AS lower_extreme, q1, median, q3,
           round(q3 + 1.5 * {spread}, 6) AS upper_extreme, max, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
           round(skewness, 6) AS skewness FROM k"""


def _summary(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    summary = S.summary_continuous(table(spark, sf_dir, "lineitem").select(_LINE), mode=mode, exact=True)
    return _rounded(summary, 6, "lower_extreme", "upper_extreme", "mean", "stddev", "skewness")


@query(_summary_sql("(q3 - q1)"))
def summary_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "intended")


@query(_summary_sql("skewness"))
def summary_continuous_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "as_coded")


def _matrix_sql(source: str, columns: list[str], value: str) -> str:
    upper = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value.format(a=a, b=b)} AS corr FROM {source}"
        for a, b in combinations(columns, 2)
    )
    ones = " UNION ALL ".join(f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1e0 AS corr" for c in columns)
    return f"""u AS ({upper}), m AS (
      SELECT col_a, col_b, corr FROM u UNION ALL SELECT col_b AS col_a, col_a AS col_b, corr FROM u UNION ALL {ones})
    SELECT col_a, col_b, round(corr, 6) + 0e0 AS corr FROM m"""


def _ranks_sql(columns: list[str], source: str) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in columns
    )
    return f"SELECT {ranks} FROM {source}"


@query("WITH " + _matrix_sql("lineitem", _LINE, "corr({a}, {b})"))
def corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation(table(spark, sf_dir, "lineitem").select(_LINE), "pearson"), 6, "corr")


_SPEARMAN_SQL = f"WITH r AS ({_ranks_sql(_LINE, 'lineitem')}), " + _matrix_sql("r", _LINE, "corr({a}, {b})")


@query(_SPEARMAN_SQL)
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlation(table(spark, sf_dir, "lineitem").select(_LINE), "spearman"), 6, "corr")


@query(_SPEARMAN_SQL)
def corr_pearson_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(_LINE)
    return _rounded(correlation(line, "pearson", mode="as_coded"), 6, "corr")


_CORR_COLUMNS = ["garagecarcnt", "garagetotalsqft", "area", "region", "latitude_e6", "longitude_e6"]


def _top_sql() -> str:
    pairs = []
    for a, b in combinations(_CORR_COLUMNS, 2):
        both = f"(SELECT {a}, {b} FROM props WHERE {a} IS NOT NULL AND {b} IS NOT NULL) c"
        pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr({a}, {b})) AS corr FROM ({_ranks_sql([a, b], both)}) r")
    return (
        cte("props")
        + f", pairs AS ({' UNION ALL '.join(pairs)}) SELECT col_a, col_b, round(corr, 6) AS corr FROM pairs "
        "WHERE corr IS NOT NULL ORDER BY pairs.corr DESC, col_a, col_b LIMIT 15"
    )


@query(_top_sql())
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(strongest(standin(spark, sf_dir, "props"), 15, _CORR_COLUMNS), 6, "corr")


def _crosstab_sql(source: str, a: str, b: str, levels: tuple[str, ...]) -> str:
    level = "coalesce(CAST({} AS VARCHAR), 'null')"
    counts = ", ".join(
        f"count(*) FILTER ({level.format(b)} = '{v}') AS \"{v}\"" for v in levels
    )
    return f"SELECT {level.format(a)} AS {a}_{b}, {counts} FROM ({source}) f GROUP BY 1"


@query(_crosstab_sql(standin_sql("flags"), "is_returned", "is_open", ("false", "true", "null")))
def crosstab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crosstab(standin(spark, sf_dir, "flags"), "is_returned", "is_open")


_NULLS = f"SELECT is_returned IS NULL AS r, is_open IS NULL AS o FROM ({standin_sql('flags')}) g"


@query(_crosstab_sql(_NULLS, "r", "o", ("false", "true")))
def crosstab_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = standin(spark, sf_dir, "flags").select(
        F.col("is_returned").isNull().alias("r"), F.col("is_open").isNull().alias("o")
    )
    return S.crosstab(flags, "r", "o")


_DISTINCT = ["event_type", "user_id", "value"]


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS distinct_values FROM events" for c in _DISTINCT)
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_counts(table(spark, sf_dir, "events").select(_DISTINCT))


@query(
    """
    WITH s AS (SELECT min(value) AS low, (max(value) - min(value)) / 50 AS width, count(value) AS total FROM events),
    b AS (SELECT CAST(least(floor((value - low) / width), 49) AS BIGINT) AS bin, count(*) AS n FROM events, s
          WHERE value IS NOT NULL GROUP BY 1)
    SELECT r.bin, round(s.low + r.bin * s.width, 6) AS lower, coalesce(b.n, 0) AS n,
           round(coalesce(b.n, 0) / (s.total * s.width), 6) AS density
    FROM (SELECT unnest(range(50)) AS bin) r CROSS JOIN s LEFT JOIN b ON r.bin = b.bin"""
)
def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.histogram(table(spark, sf_dir, "events"), "value", 50), 6, "lower", "density")


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 6) AS mae FROM lineitem")
def mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return _rounded(S.mean_absolute_error(line, "l_extendedprice", "guess"), 6, "mae")


def draw_sql(stream: str, *key: str, start: int = 1) -> str:
    """The draw of ``functions.draws`` in SQL."""
    parts = "".join(f" || chr(10) || coalesce('=' || {c}, '?')" for c in key)
    return f"((('0x' || substr(md5('42/{stream}'{parts}), {start}, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE "
    + draw_sql("sample", "l_orderkey", "l_linenumber")
    + " < 0.2e0"
)
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 % sample, drawn by the rows' keys."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sample(line, 0.2, ["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, {draw_sql('split', 'o_orderkey')} < 0.75e0 AS train FROM orders")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test parts are disjoint and together the whole table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    train, test = train_test(orders, 0.75, seed=42)
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
