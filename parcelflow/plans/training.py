"""From a raw joined table to an evaluated, logged model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import row_key, uniform
from ..ml.pipeline import build_pipeline, cross_validator, search_space
from ..ml.preprocess import Preprocess
from ..ml.run_log import log_run
from ..operators.sampling import parts, split_draw
from ..operators.statistics import mean_absolute_error
from ..scratch import materialize
from . import fixed_values as V


_DRAW = "_draw"


@dataclass(frozen=True)
class Training:
    model: CrossValidatorModel
    predictions: DataFrame
    error: DataFrame
    run_name: str | None


def train_test(
    df: DataFrame, ratio: float = V.TRAIN_RATIO, seed: int = V.SEED, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Random train and test parts of one written table; rows with equal keys (by default, equal rows) go to one part.

    The rows are written where they lie, with their draw: the many passes of the fits repeat neither the ingest nor the hash of
    whole rows, and nothing is shuffled.
    """
    written = materialize(df.withColumn(_DRAW, split_draw(df, key, seed)), "prepared")
    train_part, test_part = parts(written, F.col(_DRAW), [ratio, 1 - ratio])
    return train_part.drop(_DRAW), test_part.drop(_DRAW)


def train(
    df: DataFrame,
    iterations: int = V.SEARCH_ITERATIONS,
    mode: str = "intended",
    maps: Callable[[Pipeline], list[dict]] | None = None,
    log_folder: str | None = None,
    experiment: str = "default",
    tags: dict[str, str] | None = None,
    **boosting,
) -> Training:
    """Split, preprocess, search, evaluate on the held-out part, and log.

    ``maps`` replaces the random search space by parameter maps for the given pipeline.  What preprocessing learns comes from the training
    part, and the best model holds it as its first stage: a saved model scores raw rows.
    """
    train_part, test_part = train_test(df)
    rules = Preprocess(mode=mode).fit(train_part)
    # Written once with its folds, for all fits of the search.
    prepared = rules.transform(train_part)
    fold = F.floor(uniform(row_key(prepared), V.SEED, "fold") * V.FOLDS).cast("int")
    prepared = prepared.withColumn("_fold", fold)
    prepared = materialize(prepared, "folds")
    pipeline = build_pipeline([c for c in prepared.columns if c != "_fold"], **boosting)
    draws = maps(pipeline) if maps else search_space(pipeline, iterations)
    model = cross_validator(pipeline, draws, fold_col="_fold").fit(prepared)
    model.bestModel = PipelineModel([rules, *model.bestModel.stages])
    run = log_run(df.sparkSession, model, log_folder, experiment, tags) if log_folder else None
    predictions = model.transform(test_part).select(V.LABEL, V.PREDICTION)
    return Training(model, predictions, mean_absolute_error(predictions, V.LABEL, V.PREDICTION), run)
