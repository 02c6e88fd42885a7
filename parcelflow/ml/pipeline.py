"""The model pipeline: imputers, encoders, hasher, assembler, boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StringIndexer, VectorAssembler

from ..plans import fixed_values as V
from .boosting import HistogramBoosting
from .group_imputer import GroupImputer
from .random_grid import RandomGridBuilder
from .search import PrefixSearch


def suffixed(columns: list[str], suffix: str) -> list[str]:
    return [c + suffix for c in columns]


def feature_columns(columns: list[str]) -> list[str]:
    """Assembler inputs in a stable order: what is left of the input, then the stage outputs.

    Left out are the label, text or id columns that an encoder or the hasher consumes, and the
    column replaced by its imputed form.
    """
    encoded = suffixed(V.ONE_HOT, "_onehot")
    consumed = {*V.INDEXED, *V.ONE_HOT, *V.HASHED, V.LABEL, V.GROUP, V.GROUP_IMPUTED}
    return [*[c for c in columns if c not in consumed], f"{V.GROUP_IMPUTED}_imputed", *encoded, V.HASH_OUTPUT]


def build_pipeline(
    columns: list[str],
    stochastic: bool = True,
    hash_features: int = 64,
    hash_categorical: bool = True,
    compact_ids: bool = True,
    **boosting,
) -> Pipeline:
    """All stages over a preprocessed table with the given columns.

    ``hash_categorical`` hashes ids as categories; otherwise as real numbers, one slot per column.
    ``compact_ids`` numbers the raw ids before one-hot encoding: an id of 6111 then needs no 6111
    slots. Slots that never occur cannot be split on, so the trees stay the same, but every
    aggregation of split statistics shrinks by the unused slots.
    What no rule fills stays missing; the trees learn where missing values go.
    """
    imputed = f"{V.GROUP_IMPUTED}_imputed"
    raw = [c for c in V.ONE_HOT if compact_ids and not c.endswith("_indexed")]
    categories = [f"{c}_slot" if c in raw else c for c in V.ONE_HOT]
    # A text that is only hashed as a category needs no number.
    hashed = [c.removesuffix("_indexed") if hash_categorical and c not in V.ONE_HOT else c for c in V.HASHED]
    indexed = [c for c in V.INDEXED if c not in hashed]
    stages = [
        GroupImputer(inputCol=V.GROUP_IMPUTED, outputCol=imputed, groupCol=V.GROUP, stochastic=stochastic, seed=V.SEED),
        Imputer(inputCols=V.MEAN_IMPUTED, outputCols=V.MEAN_IMPUTED, strategy="mean"),
        StringIndexer(
            inputCols=[*indexed, *raw],
            outputCols=[*suffixed(indexed, "_indexed"), *suffixed(raw, "_slot")],
            handleInvalid="keep",
        ),
        OneHotEncoder(inputCols=categories, outputCols=suffixed(V.ONE_HOT, "_onehot"), handleInvalid="keep"),
        FeatureHasher(
            inputCols=hashed,
            outputCol=V.HASH_OUTPUT,
            numFeatures=hash_features,
            categoricalCols=hashed if hash_categorical else [],
        ),
        VectorAssembler(inputCols=feature_columns(columns), outputCol=V.FEATURES, handleInvalid="keep"),
        HistogramBoosting(
            featuresCol=V.FEATURES, labelCol=V.LABEL, predictionCol=V.PREDICTION, seed=V.SEED, **boosting
        ),
    ]
    return Pipeline(stages=stages)


def stage_of(pipeline: Pipeline, kind: type):
    return next(s for s in pipeline.getStages() if isinstance(s, kind))


def search_space(pipeline: Pipeline, iterations: int = V.SEARCH_ITERATIONS, seed: int | None = V.SEED) -> list[dict]:
    """Random parameter maps over the hasher and the boosted trees."""
    hasher, trees = stage_of(pipeline, FeatureHasher), stage_of(pipeline, HistogramBoosting)
    owner = {"numFeatures": hasher}
    convert = {"minSplitLoss": float}
    grid = RandomGridBuilder(iterations, seed)
    for name, values in V.SEARCH_SPACE.items():
        kind = convert.get(name, lambda v: v)
        grid.addGrid(
            owner.get(name, trees).getParam(name),
            lambda rng, values=values, kind=kind: kind(values[int(rng.integers(len(values)))]),
        )
    return grid.build()


def evaluator(metric: str = "mae") -> RegressionEvaluator:
    return RegressionEvaluator(predictionCol=V.PREDICTION, labelCol=V.LABEL, metricName=metric)


def cross_validator(
    pipeline: Pipeline, maps: list[dict], folds: int = V.FOLDS, parallelism: int = 4, seed: int = V.SEED, fold_col: str = ""
) -> PrefixSearch:
    """k-fold search; ``parallelism`` fits share the cluster, draws with the same features share those."""
    return PrefixSearch(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=evaluator(),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
        foldCol=fold_col,
    )
