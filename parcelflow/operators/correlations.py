"""Pearson and Spearman correlation as long tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .ordering import running_counts


def _pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each unordered pair once, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    flat = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    rows = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def _centred_ranks(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average rank of each distinct value minus the mean rank, so that sums keep their digits."""
    centred = F.col("before") + (F.col("n") - F.col("total")) / 2.0
    return running_counts(counts, by, value).withColumn("rank", centred).drop("n", "before", "total")


def _null_masks(numbered: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column -> first column that is null in the same rows, from one aggregate over the rows."""
    mark = F.xxhash64(ROW_ID)
    marks = numbered.agg(*[F.bit_xor(F.when(F.col(c).isNull(), mark)).alias(c) for c in columns]).first()
    first: dict[int | None, str] = {}
    return {c: first.setdefault(marks[c], c) for c in columns}


ROW_ID = "_row"


def ranked_values(numbered: DataFrame, masks: dict[str, str]) -> DataFrame:
    """(row, field, mask, value): every value once for each mask that it is ranked under.

    The rank of a value in a pair depends on the rows where the partner is present, so on the partner's mask only: a row
    becomes columns times masks rows at most, whatever the number of pairs.
    """
    places = [(c, m) for c in masks for m in sorted({masks[o] for o in masks if o != c})]
    rows = [
        F.struct(F.lit(c).alias("field"), F.lit(m).alias("mask"), F.when(F.col(m).isNotNull(), F.col(c)).alias("value"))
        for c, m in places
    ]
    return numbered.select(ROW_ID, F.inline(F.array(*rows))).filter("value is not null")


def _spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each unordered pair once, over the rows where both values are present.

    Values are ranked in long form, all columns and masks at once; the ranks of a row come together again in one regroup.
    """
    numbers = df.select(F.monotonically_increasing_id().alias(ROW_ID), *[F.col(c).cast("double").alias(c) for c in columns])
    numbered = materialize(numbers, "numbered")
    masks = _null_masks(numbered, columns)
    long = ranked_values(numbered, masks)
    by = ["field", "mask"]
    counts = long.groupBy(*by, "value").agg(F.count("*").alias("n"))
    # Written, so that the join sees two shuffled sides and can split the rows of a frequent value.
    ranks = materialize(_centred_ranks(counts, by, "value"), "ranks")
    ranked = long.join(ranks, on=[*by, "value"])
    cells = {(c, m): f"{i}_{j}" for i, c in enumerate(columns) for j, m in enumerate(sorted(set(masks.values())))}
    picked = [
        F.max(F.when((F.col("field") == c) & (F.col("mask") == m), F.col("rank"))).alias(name) for (c, m), name in cells.items()
    ]
    wide = ranked.groupBy(ROW_ID).agg(*picked)
    pairs = list(combinations(columns, 2))
    flat = [F.corr(F.col(cells[a, masks[b]]), F.col(cells[b, masks[a]])).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    rows = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ]
    return wide.agg(*flat).select(F.inline(F.array(*rows)))


def correlation(df: DataFrame, method: str, mode: str = "intended") -> DataFrame:
    """Correlation matrix of all columns in long form ``(col_a, col_b, corr)``.

    Rows with a null in any column are left out. ``mode="as_coded"`` computes Spearman whatever
    the method says.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    if mode not in ("intended", "as_coded"):
        raise ValueError("mode must be 'intended' or 'as_coded'")
    spearman = method == "spearman" or mode == "as_coded"
    upper = (_spearman_pairs if spearman else _pearson_pairs)(df.dropna("any"), df.columns)
    diagonal = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("corr")) for c in df.columns]
    ones = df.sparkSession.range(1).select(F.inline(F.array(*diagonal)))
    both = F.array(
        F.struct("col_a", "col_b", "corr"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"),
    )
    return upper.select(F.inline(both)).unionByName(ones)


def top_correlations(df: DataFrame, k: int = 15, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` strongest absolute Spearman correlations; each pair uses the rows where both are present."""
    return (
        _spearman_pairs(df, columns or df.columns)
        .select("col_a", "col_b", F.abs("corr").alias("corr"))
        .dropna("any", subset=["corr"])
        .orderBy(F.desc("corr"), "col_a", "col_b")
        .limit(k)
    )
