"""Random numbers that belong to a row's key, not to its place.

A draw is a keyed hash of the row key: it is the same under any partitioning, order or file layout, in every later run, and when a lost
executor's tasks run again.  ``seed`` and ``stream`` give independent draws for one key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, all that a double between 0 and 1 can hold


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The named columns, by default all columns of atomic types: equal rows then share their draws."""
    if columns is None:
        nested = (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType, T.BinaryType)
        columns = [f.name for f in df.schema if not isinstance(f.dataType, nested)]
    absent = [c for c in columns if c not in df.columns]
    if absent or not columns:
        raise ValueError(f"columns not found in the dataset: {absent}" if absent else "a row key needs a column")
    return [F.col(f"`{c}`") for c in columns]


def _hash(key: list[Column], seed: int, stream: str) -> Column:
    """MD5 of seed, stream and the key's values as text; a null is told from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")) for c in key]
    return F.md5(F.concat_ws("\n", F.lit(f"{seed}/{stream}"), *parts).cast("binary"))


def _unit(digest: Column, start: int) -> Column:
    """A number strictly between 0 and 1."""
    whole = F.conv(F.substring(digest, start, _DIGITS), 16, 10).cast("bigint")
    return (whole.cast("double") + 0.5) / float(16**_DIGITS)


def uniform(key: list[Column], seed: int, stream: str = "") -> Column:
    """One draw between 0 and 1 (both excluded but for rounding) per key."""
    return _unit(_hash(key, seed, stream), 1)


def normal(key: list[Column], seed: int, stream: str = "") -> Column:
    """One standard normal draw per key, by the polar form of two uniform ones."""
    digest = _hash(key, seed, stream)
    radius = F.sqrt(F.lit(-2.0) * F.ln(_unit(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _unit(digest, 1 + _DIGITS))
