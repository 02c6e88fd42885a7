"""Place and census tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_words
from ..operators.relational import append_by_name, first_per_key

# Words cut from place names, and the mark of a county.
PLACE_WORDS = (" city", " town")
COUNTY = "county"


def clean_places(table: DataFrame, name: str, population: str) -> DataFrame:
    """``(city, population)`` from a raw population table: rows with a null are notes and go."""
    return (
        table.dropna("any")
        .select(name, population)
        .toDF("city", "population")
        .withColumn("city", strip_words(F.col("city"), PLACE_WORDS))
    )


def attach_population(cities: DataFrame, places: DataFrame, order: str) -> DataFrame:
    """Cities with their population by cleaned name, one row per name, counties left out."""
    one_each = first_per_key(cities, ["name"], [order])
    joined = one_each.join(places.withColumnRenamed("city", "name"), on="name", how="left")
    return joined.filter(~F.lower("name").contains(COUNTY))


def select_areas(table: DataFrame, areas: str | list[str], column: str = "area") -> DataFrame:
    """Census rows of one area or of several; the areas are appended in one scan."""
    if isinstance(areas, str):
        return table.filter(F.col(column) == areas)
    if isinstance(areas, list):
        return table.filter(F.col(column).isin(areas))
    raise TypeError("areas must be a string or a list of strings")


def append_areas(frames: list[DataFrame]) -> DataFrame:
    """Census tables of several areas appended by column name."""
    return append_by_name(frames)
