"""Exploratory statistics: every result is a long table, computed in one aggregate where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import exact_percentiles


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _per_field(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate all fields at once, then turn the single row into one row per field."""
    flat = [e.alias(f"{i}_{m}") for i, by_name in enumerate(measures.values()) for m, e in by_name.items()]
    rows = [
        F.struct(F.lit(field).alias("field"), *[F.col(f"{i}_{m}").alias(m) for m in by_name])
        for i, (field, by_name) in enumerate(measures.items())
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def unpivot_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form ``(field, value)`` of numeric columns."""
    rows = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*rows)))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Share of each value in percent (3 decimals), null included, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()  # of the grouped counts, which the same scan gives
    return (
        counts.select(column, F.round(F.col("_n") / total * 100, 3).alias("percent"))
        .orderBy(F.desc("percent"), F.asc_nulls_first(column))
    )


def missing_percent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percent of null values per field, fullest fields first."""
    columns = columns or df.columns
    measures = {c: {"missing_percent": (1 - F.count(F.col(c)) / F.count("*")) * 100} for c in columns}
    return _per_field(df, measures).orderBy("missing_percent", "field")


def describe_long(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and range per numeric or string field.

    ``min`` and ``max`` are filled for numbers, ``min_text`` and ``max_text`` for strings.
    """
    measures = {}
    for f in df.schema:
        c = F.col(f.name)
        number = isinstance(f.dataType, T.NumericType)
        if not number and not isinstance(f.dataType, T.StringType):
            continue
        v = c.cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else c
        measures[f.name] = {
            "count": F.count(c),
            "mean": F.avg(v),
            "stddev": F.stddev_samp(v),
            "min": F.min(v),
            "max": F.max(v),
            "min_text": F.min(text),
            "max_text": F.max(text),
        }
    return _per_field(df, measures)


def summary_continuous(df: DataFrame, mode: str = "intended", exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """Box-plot summary of every numeric field, with the second Pearson skewness.

    ``mode="as_coded"`` takes the skewness in place of the interquartile range for the whiskers.
    Percentiles come from a bounded sketch, or with ``exact=True`` from a distributed order.
    """
    if mode not in ("intended", "as_coded"):
        raise ValueError("mode must be 'intended' or 'as_coded'")
    columns = numeric_columns(df)
    quantiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    measures = {}
    for c in columns:
        v = F.col(c).cast("double")
        measures[c] = {
            "count": F.count(v),
            "min": F.min(v),
            "max": F.max(v),
            "mean": F.avg(v),
            "stddev": F.stddev_samp(v),
        }
        if not exact:
            sketch = F.percentile_approx(v, list(quantiles.values()), accuracy)
            measures[c].update({q: F.get(sketch, F.lit(i)) for i, q in enumerate(quantiles)})
    summary = _per_field(df, measures)
    if exact:
        ordered = exact_percentiles(unpivot_numeric(df, columns), ["field"], "value", quantiles)
        summary = summary.join(ordered, on="field", how="left")
    skewness = 3 * (F.col("mean") - F.col("median")) / F.nullif(F.col("stddev"), F.lit(0.0))
    spread = F.col("q3") - F.col("q1") if mode == "intended" else skewness
    return summary.select(
        "field",
        "count",
        "min",
        (F.col("q1") - 1.5 * spread).alias("lower_extreme"),
        "q1",
        "median",
        "q3",
        (F.col("q3") + 1.5 * spread).alias("upper_extreme"),
        "max",
        "mean",
        "stddev",
        skewness.alias("skewness"),
    )


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of rows per pair of values of two columns, as text; null is a level called ``null``."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    return df.groupBy(level(a), level(b)).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``pair_counts`` with a column per level of ``b`` that occurs; the first column is named ``<a>_<b>``.

    Spark limits the number of columns; beyond, use ``pair_counts``.
    """
    pairs = pair_counts(df.select(F.col(a).alias("_a"), F.col(b).alias("_b")), "_a", "_b")
    return pairs.groupBy(F.col("_a").alias(f"{a}_{b}")).pivot("_b").agg(F.sum("n")).fillna(0)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per field."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return _per_field(df, {c: {"distinct_values": count(F.col(c))} for c in columns or df.columns})


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram over the column's range; the last bin is closed."""
    v = F.col(column).cast("double")
    low, high, total = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not total:
        low = high = 0.0
    if low == high:  # a constant column gets one unit-wide range around its value
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    bucket = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(v.isNotNull()).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return every.join(counts, on="bin", how="left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        n.alias("n"),
        (n / F.nullif(F.lit(total * width), F.lit(0.0))).alias("density"),
    )


def mean_absolute_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"))
