"""Session settings this library is tuned with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Joins are re-planned at run time: skewed partitions are split, small sides broadcast by size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Very wide projections compile to methods the JVM does not optimise; split them up instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder; on a cluster also set ``spark.checkpoint.dir``."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
