"""Small column rules used by preprocessing and exploration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shifted(c: Column, minimum: float | None) -> Column:
    """Shift a column whose minimum is not positive up to zero; no minimum means no shift."""
    if minimum is not None and minimum <= 0:
        return c + F.lit(float(-minimum))
    return c


def log_shift(c: Column, minimum: float | None) -> Column:
    return F.log1p(_shifted(c, minimum))


def sqrt_shift(c: Column, minimum: float | None) -> Column:
    return F.sqrt(_shifted(c, minimum))


def cube_root(c: Column) -> Column:
    """Third root by power: negative input gives NaN."""
    return F.pow(c, F.lit(1.0 / 3.0))


def keep_or_bin(c: Column, keep: list, other) -> Column:
    """Values outside ``keep`` become ``other``; null stays null."""
    return F.when(~c.isin(list(keep)), F.lit(other)).otherwise(c)


def above(c: Column, threshold: float) -> Column:
    """1 strictly above the threshold, else 0 (null gives 0)."""
    return F.when(c > F.lit(threshold), 1).otherwise(0)


def flag_to_number(c: Column, yes: str = "Y") -> Column:
    return F.when(c == F.lit(yes), 1).otherwise(0)


def null_when(c: Column, condition: Column) -> Column:
    return F.when(condition, F.lit(None)).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """For float columns: NaN becomes null."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def try_number(c: Column) -> Column:
    """String to double, unreadable text becomes null."""
    return c.try_cast("double")


def strip_words(c: Column, words: tuple[str, ...]) -> Column:
    """Remove every literal occurrence of each word, in order."""
    for word in words:
        c = F.replace(c, F.lit(word), F.lit(""))
    return c
