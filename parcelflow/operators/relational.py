"""Joins, unions and dedupes on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_all(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Fold the frames with an equi-join on ``key``; duplicate keys multiply."""
    return reduce(lambda left, right: left.join(right, on=key, how=how), frames)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Append by position, duplicates kept."""
    return reduce(DataFrame.union, frames)


def append_by_name(frames: list[DataFrame]) -> DataFrame:
    """Append by column name; columns absent from a frame are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` ascending. Aggregates map-side, so a hot key stays small."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def merge_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join on ``key``; columns found on both sides get the suffixes."""
    clash = [c for c in left.columns if c in right.columns and c != key]
    renamed = [df.withColumnsRenamed({c: c + s for c in clash}) for df, s in zip((left, right), suffixes)]
    return renamed[0].join(renamed[1], on=key, how="inner")


def align(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer alignment of frames with unique keys and distinct columns.

    All frames are stacked and grouped once, which shuffles every row a single time however many
    frames there are. A key that occurs twice in one frame raises an error.
    """
    names = [c for df in frames for c in df.columns if c != key]
    if len(names) != len(set(names)):
        raise ValueError("frames to align share a column besides the key")
    stacked = append_by_name([df.withColumn("_source", F.lit(i)) for i, df in enumerate(frames)])
    most = F.greatest(*[F.count(F.when(F.col("_source") == i, 1)) for i in range(len(frames))], F.lit(0))
    return (
        stacked.groupBy(key)
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in names], most.alias("_most"))
        .filter(F.assert_true(F.col("_most") <= 1, f"a {key} occurs twice in one frame").isNull())
        .drop("_most")
    )
