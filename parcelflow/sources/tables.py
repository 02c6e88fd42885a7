"""Typed scans and the multi-period ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import join_all, union_all


def scan(
    spark: SparkSession,
    path: str,
    schema: str | list[str],
    fmt: str = "csv",
    header: bool | str = True,
    delimiter: str = ",",
) -> DataFrame:
    """Read files with an explicit DDL schema; nothing is inferred."""
    ddl = schema if isinstance(schema, str) else ", ".join(schema)
    return spark.read.format(fmt).schema(ddl).options(header=header, delimiter=delimiter).load(path)


def read_tables(spark: SparkSession, config: dict, feature_path: str | None = None, key: str = "parcelid") -> DataFrame:
    """Per period, inner-join its files on the key; append the periods; left-join the features.

    ``config`` holds ``files`` (period -> table -> path), ``schema`` (table -> DDL columns),
    ``format``, ``header`` and ``delimiter``.
    """
    options = {"fmt": config["format"], "header": config["header"], "delimiter": config["delimiter"]}

    def load(table: str, path: str) -> DataFrame:
        return scan(spark, path, config["schema"][table], **options)

    periods = [join_all([load(t, p) for t, p in files.items()], key) for files in config["files"].values()]
    merged = union_all(periods)
    if feature_path is None:
        return merged
    return merged.join(load("external_features", feature_path), on=key, how="left")


def write_features(df: DataFrame, path: str, key: str = "parcelid", fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write the feature table with the key as its first column."""
    df.select(key, *[c for c in df.columns if c != key]).write.mode(mode).option("header", True).format(fmt).save(path)
