"""Intermediate tables in the cluster's shared folder.

Iterative operators write their rounds as parquet under ``spark.checkpoint.dir`` and go on
from the written table: the lineage is cut, a lost executor costs a re-read instead of a
recomputation, and later joins see real sizes.

All tables of an application lie in one folder of its own.  Nothing that outlives the application is kept there (a saved
model holds its tables itself), so ``release`` may remove it once the results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{scratch_dir(spark)}/parcelflow-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that still read them must be written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    files = written.inputFiles()
    if files:
        spark = written.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
