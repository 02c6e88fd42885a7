"""Running totals, ranks and exact percentiles over a distributed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def running_counts(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``before`` (sum of ``n`` over smaller values) and ``total`` within each ``by`` group.

    ``counts`` has one row per ``(by, value)`` with its number of occurrences ``n``. The rows are
    range-partitioned by value, so even one huge group is spread over all tasks: each slice is
    summed on its own and shifted by the totals of the slices before it.
    """
    slices = materialize(
        counts.repartitionByRange(*by, value).withColumn("slice", F.spark_partition_id()), "slices"
    )
    group = Window.partitionBy(*by)  # one row per slice: as many rows as partitions at most
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        slices.groupBy(*by, "slice")
        .agg(F.sum("n").alias("n"))
        .withColumns({"offset": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(group)})
        .drop("n")
    )
    smaller = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.withColumn("inner", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        .join(totals, on=[*by, "slice"])
        .withColumn("before", F.col("offset") + F.col("inner"))
        .drop("slice", "offset", "inner")
    )


def exact_percentiles(values: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Discrete percentiles per group: the first value whose cumulative share reaches the quantile."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_counts(counts, by, value)
    reached = {
        name: F.min(F.when(F.col("before") + F.col("n") >= F.lit(q) * F.col("total"), F.col(value)))
        for name, q in quantiles.items()
    }
    return ranked.groupBy(*by).agg(*[e.alias(name) for name, e in reached.items()])
