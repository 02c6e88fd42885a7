"""Imputation by group statistics, as a Spark ML stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasSeed
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
from pyspark.sql import types as T

from ..functions.draws import normal, row_key
from ..functions.scalars import nan_to_null
from ..scratch import materialize


class _GroupImputerParams(HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasSeed):
    groupCol = Param(Params._dummy(), "groupCol", "column that defines the groups", TypeConverters.toString)
    stochastic = Param(
        Params._dummy(), "stochastic", "add normal noise scaled by the group's deviation", TypeConverters.toBoolean
    )
    keyCols = Param(
        Params._dummy(), "keyCols", "columns that name a row; noise belongs to them (default: all of the row)", TypeConverters.toListString
    )

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(stochastic=False, seed=42)

    def getGroupCol(self) -> str:
        return self.getOrDefault(self.groupCol)

    def getStochastic(self) -> bool:
        return self.getOrDefault(self.stochastic)

    def setGroupCol(self, value: str):
        return self._set(groupCol=value)

    def setStochastic(self, value: bool):
        return self._set(stochastic=value)

    def getKeyCols(self) -> list[str] | None:
        return self.getOrDefault(self.keyCols) if self.isDefined(self.keyCols) else None

    def setKeyCols(self, value: list[str]):
        return self._set(keyCols=value)

    def setInputCol(self, value: str):
        return self._set(inputCol=value)

    def setOutputCol(self, value: str):
        return self._set(outputCol=value)

    def setInputCols(self, value: list[str]):
        return self._set(inputCols=value)

    def setOutputCols(self, value: list[str]):
        return self._set(outputCols=value)

    def _columns(self) -> tuple[list[str], list[str]]:
        """Input and output columns, after checking that they are set consistently."""

        def one_or_many(single: Param, many: Param) -> tuple[list[str], bool]:
            one = self.getOrDefault(single) if self.isSet(single) else None
            several = self.getOrDefault(many) if self.isSet(many) else None
            if bool(one) == bool(several):
                raise ValueError(f"exactly one of `{single.name}` and `{many.name}` must be set")
            return ([one], True) if one else (list(several), False)

        inputs, single_in = one_or_many(self.inputCol, self.inputCols)
        outputs, single_out = one_or_many(self.outputCol, self.outputCols)
        if single_in != single_out:
            raise ValueError("set `inputCol` with `outputCol`, or `inputCols` with `outputCols`")
        if len(inputs) != len(outputs):
            raise ValueError("`inputCols` and `outputCols` differ in length")
        if not self.isSet(self.groupCol) or not self.getGroupCol():
            raise ValueError("`groupCol` must be set")
        return inputs, outputs

    def _check_schema(self, schema: T.StructType, inputs: list[str]) -> None:
        absent = [c for c in [*inputs, self.getGroupCol()] if c not in schema.names]
        if absent:
            raise ValueError(f"columns not found in the dataset: {absent}")
        text = [c for c in inputs if not isinstance(schema[c].dataType, T.NumericType)]
        if text:
            raise TypeError(f"input columns must be numeric: {text}")


class GroupImputer(Estimator, _GroupImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean and sample deviation of each input column per group.

    A group with one value has deviation 0; a group without values has no statistics, and its
    nulls stay null.
    """

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        inputCols: list[str] | None = None,
        outputCols: list[str] | None = None,
        groupCol: str | None = None,
        stochastic: bool = False,
        seed: int = 42,
        keyCols: list[str] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        inputCols: list[str] | None = None,
        outputCols: list[str] | None = None,
        groupCol: str | None = None,
        stochastic: bool = False,
        seed: int = 42,
        keyCols: list[str] | None = None,
    ) -> GroupImputer:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GroupImputerModel:
        inputs, _ = self._columns()
        self._check_schema(dataset.schema, inputs)
        stats = group_statistics(dataset, self.getGroupCol(), inputs).withColumnRenamed(self.getGroupCol(), "group")
        stats = stats.filter(F.col("group").isNotNull())  # a null group never matches
        return self._copyValues(GroupImputerModel(materialize(stats, "group-statistics")))


class _StatisticsWriter(DefaultParamsWriter):
    """Writes the parameters, and the statistics as a table inside the model's folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.statistics.write.parquet(f"{path}/statistics")


class _StatisticsReader(DefaultParamsReader):
    def load(self, path: str) -> GroupImputerModel:
        model = super().load(path)
        model.statistics = self.sparkSession.read.parquet(f"{path}/statistics")
        return model


class GroupImputerModel(Model, _GroupImputerParams, MLReadable, MLWritable):
    """Fills nulls from a table of statistics: ``group``, then ``<column>_mean`` and ``<column>_std`` per input column.

    Noise is drawn from the row's key and the column's name, so partitions and retries do not change it.

    A saved model holds the table; nothing outside its folder is needed to load it.
    """

    def __init__(self, statistics: DataFrame | None = None):
        super().__init__()
        self.statistics = statistics

    def write(self) -> MLWriter:
        return _StatisticsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StatisticsReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs, outputs = self._columns()
        self._check_schema(dataset.schema, inputs)
        stats = self.statistics
        stats = stats.select(*[F.col(c).alias(f"_imputer_{c}") for c in stats.columns])
        matched = dataset.join(stats, dataset[self.getGroupCol()] == F.col("_imputer_group"), how="left")
        key = row_key(dataset, self.getKeyCols()) if self.getStochastic() else []
        imputed = {}
        for c, out in zip(inputs, outputs):
            value = F.col(f"_imputer_{c}_mean")
            if self.getStochastic():
                value = value + normal(key, self.getSeed(), c) * F.col(f"_imputer_{c}_std")
            imputed[out] = F.coalesce(F.col(c), value).cast(dataset.schema[c].dataType)
        return matched.withColumns(imputed).drop(*stats.columns)


def group_statistics(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column per group; a single value has deviation 0."""
    measures = []
    for c in columns:
        value = F.col(c).cast("double")
        mean, std = F.avg(value), F.stddev_samp(value)
        measures.append(nan_to_null(mean).alias(f"{c}_mean"))
        measures.append(nan_to_null(F.coalesce(std, F.when(mean.isNotNull(), F.lit(0.0)))).alias(f"{c}_std"))
    return df.groupBy(group).agg(*measures)

