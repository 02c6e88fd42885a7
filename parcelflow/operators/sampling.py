"""Samples and splits that every engine, layout and retry draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import row_key, uniform


def sample(df: DataFrame, fraction: float, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The rows whose draw lies below ``fraction``: a filter without shuffle, and a smaller fraction takes a subset of a larger one.

    Rows with equal keys (by default, equal rows) are taken or left together.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    return df.filter(uniform(row_key(df, key), seed, "sample") < fraction)


def split(df: DataFrame, weights: list[float], key: list[str] | None = None, seed: int = 42) -> list[DataFrame]:
    """Disjoint parts that together are the whole table, in proportion to the weights; equal keys go to one part."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    return parts(df, split_draw(df, key, seed), weights)


def split_draw(df: DataFrame, key: list[str] | None = None, seed: int = 42) -> Column:
    """What ``split`` goes by: a table that is read often can hold it as a column."""
    return uniform(row_key(df, key), seed, "split")


def parts(df: DataFrame, draw: Column, weights: list[float]) -> list[DataFrame]:
    """The rows by their draw, in proportion to the weights."""
    ends = [0.0]
    for w in weights[:-1]:
        ends.append(ends[-1] + w / sum(weights))
    above = [draw >= F.lit(e) for e in ends]
    return [*[df.filter(low & ~high) for low, high in zip(above, above[1:])], df.filter(above[-1])]
