"""String indexing with the labels as a table: fitted by range partitions, joined on use, saved inside the model."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_counts
from ..scratch import materialize

_INVALID = ("error", "skip", "keep")


class _LabelParams(HasInputCols, HasOutputCols, HasHandleInvalid):
    handleInvalid = Param(
        Params._dummy(), "handleInvalid", "null and unseen labels: error, skip (drop the row) or keep (one further number)", TypeConverters.toString
    )

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(handleInvalid="error")

    def _pairs(self, df: DataFrame) -> list[tuple[str, str]]:
        inputs, outputs = self.getInputCols(), self.getOutputCols()
        if len(inputs) != len(outputs):
            raise ValueError("`inputCols` and `outputCols` differ in length")
        absent = [c for c in inputs if c not in df.columns]
        if absent:
            raise ValueError(f"columns not found in the dataset: {absent}")
        if self.getHandleInvalid() not in _INVALID:
            raise ValueError(f"handleInvalid must be one of {_INVALID}")
        return list(zip(inputs, outputs))


class LabelIndexer(Estimator, _LabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers the labels of each column from 0, the most frequent first, ties by the label's bytes.

    Labels are counted once for all columns, spread over tasks by range of (count, label), and numbered slice by slice:
    neither the driver nor one task sees them all, so a column may have as many labels as the table has rows.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, handleInvalid: str = "error"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LabelIndexModel:
        columns = [c for c, _ in self._pairs(dataset)]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns]))
        counts = dataset.select(cells.alias("c")).select("c.*").filter("label is not null").groupBy("column", "label").agg(F.count("*").alias("often"))
        ordered = counts.select("column", F.struct((-F.col("often")).alias("rank"), "label").alias("place"), F.lit(1).alias("n"))
        numbered = running_counts(ordered, ["column"], "place")
        labels = numbered.select("column", F.col("place.label").alias("label"), F.col("before").cast("double").alias("index"))
        return self._copyValues(LabelIndexModel(materialize(labels, "labels")))


class _LabelWriter(DefaultParamsWriter):
    """Writes the parameters, and the labels as a table inside the model's folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.labels.write.partitionBy("column").parquet(f"{path}/labels")


class _LabelReader(DefaultParamsReader):
    def load(self, path: str) -> LabelIndexModel:
        model = super().load(path)
        model.labels = self.sparkSession.read.schema("label string, index double, column string").parquet(f"{path}/labels")
        return model


class LabelIndexModel(Model, _LabelParams, MLReadable, MLWritable):
    """Joins the number of each label: ``labels`` has ``column``, ``label``, ``index``."""

    def __init__(self, labels: DataFrame | None = None):
        super().__init__()
        self.labels, self._sizes = labels, None

    @property
    def sizes(self) -> dict[str, int]:
        """The number of labels per column; a row per column, asked for once."""
        if self._sizes is None:
            self._sizes = {r["column"]: r["n"] for r in self.labels.groupBy("column").agg(F.count("*").alias("n")).collect()}
        return self._sizes

    def write(self) -> MLWriter:
        return _LabelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LabelReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        invalid, out = self.getHandleInvalid(), dataset
        for c, name in self._pairs(dataset):
            mine = self.labels.filter(F.col("column") == c).select(F.col("label").alias("_label"), F.col("index").alias("_index"))
            size = self.sizes.get(c, 0)
            out = out.join(mine, out[c].cast("string") == F.col("_label"), "inner" if invalid == "skip" else "left")
            found = F.col("_index")
            if invalid == "keep":
                found = F.coalesce(found, F.lit(float(size)))
            elif invalid == "error":
                found = F.coalesce(found, F.raise_error(F.concat(F.lit(f"no number for a label of {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))
            # Encoders take the width from here instead of looking for the largest number.
            nominal = {"ml_attr": {"type": "nominal", "name": name, "num_vals": size + (invalid == "keep")}}
            out = out.withColumn(name, found).withMetadata(name, nominal).drop("_label", "_index")
        return out
