"""Imputers, encoders, the model pipeline, search and run log."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ml.group_imputer import GroupImputer, group_statistics
from ..ml.label_index import LabelIndexer
from ..ml.pipeline import build_pipeline, evaluator, search_space
from ..ml.preprocess import preprocess
from ..ml.run_log import log_run, read_log
from ..ml.search import fit_pipeline
from ..plans import fixed_values as V
from ..plans.training import Training, train, train_test
from ..scratch import scratch_path
from .registry import query
from .statistics import draw_sql
from .standins import cte, standin, table, wide

_STATS = (
    "SELECT {g} AS grp, avg({a}) AS m, coalesce(stddev_samp({a}), CASE WHEN count({a}) > 0 THEN 0 END) AS s "
    "FROM props GROUP BY {g}"
)


@query(
    cte("props")
    + """ SELECT region, round(avg(area), 6) AS area_mean,
      round(coalesce(stddev_samp(area), CASE WHEN count(area) > 0 THEN 0 END), 6) AS area_std,
      round(avg(garagetotalsqft), 6) AS garagetotalsqft_mean,
      round(coalesce(stddev_samp(garagetotalsqft), CASE WHEN count(garagetotalsqft) > 0 THEN 0 END), 6)
        AS garagetotalsqft_std FROM props GROUP BY region"""
)
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = group_statistics(standin(spark, sf_dir, "props"), "region", ["area", "garagetotalsqft"])
    return stats.select("region", *[F.round(c, 6).alias(c) for c in stats.columns if c != "region"])


@query(
    cte("props")
    + """, s AS (SELECT zoning, avg(area) AS m, avg(garagetotalsqft) AS g FROM props GROUP BY zoning)
    SELECT parcelid, round(coalesce(area, m), 6) AS area_imputed,
      CASE WHEN garagetotalsqft IS NULL THEN CAST(trunc(g) AS BIGINT) ELSE garagetotalsqft END AS garage_imputed
    FROM props JOIN s ON props.zoning = s.zoning"""
)
def group_impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns at once; the integer column is cut to its type."""
    props = standin(spark, sf_dir, "props")
    imputer = GroupImputer(
        inputCols=["area", "garagetotalsqft"], outputCols=["area_imputed", "garage_imputed"], groupCol="zoning"
    )
    done = imputer.fit(props).transform(props)
    return done.select("parcelid", F.round("area_imputed", 6).alias("area_imputed"), "garage_imputed")


_NOISE = (
    f"sqrt(-2e0 * ln({draw_sql('area', 'parcelid')})) * cos(2e0 * pi() * {draw_sql('area', 'parcelid', start=14)})"
)


@query(
    cte("props")
    + ", s AS (SELECT zoning, avg(area) AS mean, coalesce(stddev_samp(area), 0e0) AS std FROM props GROUP BY zoning)"
    + f" SELECT p.parcelid, round(coalesce(p.area, s.mean + {_NOISE} * s.std), 6) AS filled_area"
    + " FROM props p LEFT JOIN s ON p.zoning = s.zoning"
)
def group_impute_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls become the group's mean and noise that belongs to the row."""
    props = standin(spark, sf_dir, "props")
    imputer = GroupImputer(inputCol="area", outputCol="filled_area", groupCol="zoning", stochastic=True, keyCols=["parcelid"])
    return imputer.fit(props).transform(props).select("parcelid", F.round("filled_area", 6).alias("filled_area"))


@query(
    cte("props")
    + """ SELECT parcelid, round(coalesce(area, (SELECT avg(area) FROM props)), 6) AS area,
      round(coalesce(garagetotalsqft, (SELECT avg(garagetotalsqft) FROM props)), 6) AS garage FROM props"""
)
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = standin(spark, sf_dir, "props").select("parcelid", "area", F.col("garagetotalsqft").cast("double").alias("garage"))
    columns = ["area", "garage"]
    done = Imputer(inputCols=columns, outputCols=columns, strategy="mean").fit(props).transform(props)
    return done.select("parcelid", *[F.round(c, 6).alias(c) for c in columns])


def _numbers_sql(label: str) -> str:
    return f"SELECT {label} AS label, row_number() OVER (ORDER BY count(*) DESC, {label}) - 1 AS i FROM orders GROUP BY {label}"


@query(
    f"""
    WITH r AS ({_numbers_sql("o_orderpriority")}), k AS ({_numbers_sql("CAST(o_orderkey AS VARCHAR)")})
    SELECT o.o_orderkey, CAST(r.i AS DOUBLE) AS priority_indexed, CAST(k.i AS DOUBLE) AS key_indexed
    FROM orders o JOIN r ON o.o_orderpriority = r.label JOIN k ON CAST(o_orderkey AS VARCHAR) = k.label"""
)
def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of few labels, and one with a label per row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key"))
    indexer = LabelIndexer(inputCols=["o_orderpriority", "key"], outputCols=["priority_indexed", "key_indexed"], handleInvalid="keep")
    return indexer.fit(orders).transform(orders).select("o_orderkey", "priority_indexed", "key_indexed")


@query(
    "SELECT c_custkey, c_nationkey AS slot, 1e0 AS filled, (SELECT max(c_nationkey) + 1 FROM customer) AS size FROM customer"
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set slot and the width of the vector."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    encoder = OneHotEncoder(inputCols=["c_nationkey"], outputCols=["onehot"], handleInvalid="keep")
    slots = encoder.fit(customer).transform(customer).select("c_custkey", vector_to_array("onehot").alias("v"))
    return slots.select(
        "c_custkey",
        (F.array_position("v", F.lit(1.0)) - 1).cast("int").alias("slot"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("filled"),
        F.size("v").alias("size"),
    )


@query(
    "SELECT o_orderkey, 3 AS size, CAST(o_orderkey AS DOUBLE) AS first, CAST(o_custkey AS DOUBLE) AS second, "
    "round(o_totalprice, 4) AS third FROM orders"
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    assembler = VectorAssembler(
        inputCols=["o_orderkey", "o_custkey", "o_totalprice"], outputCol="v", handleInvalid="keep"
    )
    vectors = assembler.transform(orders).select("o_orderkey", vector_to_array("v").alias("v"))
    return vectors.select(
        "o_orderkey",
        F.size("v").alias("size"),
        F.col("v")[0].alias("first"),
        F.col("v")[1].alias("second"),
        F.round(F.col("v")[2], 4).alias("third"),
    )


_SLOTS = 4
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def murmur3(data: bytes, seed: int = 42) -> int:
    """The published 32-bit hash, signed; for the SQL, beside the hasher's own."""
    word, mask = 0xFFFFFFFF, seed
    turned = lambda v, by: ((v << by) | (v >> (32 - by))) & word
    whole = len(data) // 4 * 4
    tail = data[whole:]
    for i in range(0, whole, 4):
        k = turned(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
        mask = (turned(mask ^ k, 13) * 5 + 0xE6546B64) & word
    if tail:
        mask ^= turned(int.from_bytes(tail, "little") * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
    mask ^= len(data)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        mask = (mask ^ (mask >> by)) * factor & word
    return mask - (1 << 32) if mask >> 31 else mask


def _slot(term: str) -> int:
    return murmur3(term.encode()) % _SLOTS


@query(
    f"""
    WITH s AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {_slot('o_orderpriority=' + p)})" for p in _PRIORITIES)}) t(priority, slot))
    SELECT o_orderkey, CAST(n.slot AS INT) AS slot, round(CASE WHEN s.slot = n.slot THEN 1e0 ELSE 0e0 END
      + CASE WHEN n.slot = {_slot("o_totalprice")} THEN o_totalprice ELSE 0e0 END, 4) AS value
    FROM orders JOIN s ON o_orderpriority = s.priority, range({_SLOTS}) n(slot)"""
)
def feature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every row: a category adds 1 to the slot of its hash, a number its value; few slots, so that some are shared."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    hasher = FeatureHasher(inputCols=["o_orderpriority", "o_totalprice"], outputCol="v", numFeatures=_SLOTS)
    vectors = hasher.transform(orders).select("o_orderkey", vector_to_array("v").alias("v"))
    slots = vectors.select("o_orderkey", F.posexplode("v").alias("slot", "value"))
    return slots.select("o_orderkey", "slot", F.round("value", 4).alias("value"))


def fit_predict_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline with its own settings over the full-width table, against always guessing the training mean:
    what was learnt has the smaller squared error on the training part, and at most half as much again on the other."""
    train_part, test_part = train_test(preprocess(wide(spark, sf_dir)))
    model = fit_pipeline(build_pipeline(train_part.columns), train_part)
    parts = [model.transform(p).select(V.LABEL, V.PREDICTION, F.lit(n).alias("part")) for n, p in enumerate((train_part, test_part))]
    predicted = parts[0].unionByName(parts[1])
    mean = F.lit(train_part.agg(F.avg(V.LABEL)).first()[0])
    of = lambda n, guess: F.avg(F.when(F.col("part") == n, (F.col(V.LABEL) - guess) ** 2))
    return predicted.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(V.PREDICTION).isNull(), 1)).alias("without_prediction"),
        (of(0, F.col(V.PREDICTION)) < of(0, mean)).alias("learnt"),
        (of(1, F.col(V.PREDICTION)) < 1.5 * of(1, mean)).alias("holds"),
    )


_SMALL_TREES = {"maxIter": 3, "maxDepth": 4}
_DRAWS = 2


def _drawn() -> list[dict]:
    """What the search draws, by the rule of the parameter maps: draw n has a generator of its own."""
    out = []
    for n in range(_DRAWS):
        rng = np.random.default_rng(V.SEED + n)
        drawn = {name: values[int(rng.integers(len(values)))] for name, values in V.SEARCH_SPACE.items()}
        out.append({k: v for k, v in drawn.items() if k not in _SMALL_TREES})
    return out


_MAPS = " UNION ALL ".join(
    f"SELECT {n} AS run, "
    + ", ".join(f"{float(v)}e0 AS {k}" for k, v in drawn.items())
    + ", true AS averages_folds, true AS error_of_average"
    for n, drawn in enumerate(_drawn())
)


@query(_MAPS)
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search with cross validation, logged as tables; one row per parameter map with what was drawn."""
    folder = scratch_path(spark, "runs")
    _search(spark, sf_dir, folder)
    results = read_log(spark, folder, "results", "houses")
    numbers = [F.col("parameters")[name].cast("double").alias(name) for name in _drawn()[0]]
    return results.select(
        "run",
        *numbers,
        ((F.col("average") > 0) & (F.col("stddev") >= 0) & (F.col("stddev") < F.col("average") * V.FOLDS)).alias("averages_folds"),
        (F.abs(F.col("standard_error") - F.col("stddev") / math.sqrt(V.FOLDS)) < 1e-12).alias("error_of_average"),
    )


@query(
    "SELECT CAST(n AS INT) AS n, CAST(n AS VARCHAR) AS tag, 'mae' AS metric, true AS is_least, true AS same_results, "
    f"CAST({_DRAWS} AS BIGINT) AS results, CAST(8 AS BIGINT) AS stages FROM range(1, 3) r(n)"
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of a search, read back from the log, and the same model logged again: a second run of the experiment."""
    folder = scratch_path(spark, "runs")
    trained = _search(spark, sf_dir, folder)
    again = log_run(spark, trained.model, folder, "houses", {"tag": "2"})
    runs, results, stages = (read_log(spark, folder, t, "houses") for t in ("runs", "results", "stages"))
    numbered = runs.withColumn("n", F.when(F.col("run_name") == trained.run_name, 1).when(F.col("run_name") == again, 2))
    alike = F.size(F.collect_set(F.struct("average", "stddev")).over(Window.partitionBy("run"))) == 1
    least = results.withColumn("alike", alike).groupBy("run_name")
    least = least.agg(F.min("average").alias("least"), F.count("*").alias("results"), F.every("alike").alias("same_results"))
    joined = numbered.join(least, "run_name").join(stages.groupBy("run_name").agg(F.count("*").alias("stages")), "run_name")
    return joined.select(
        "n",
        F.col("tags")["tag"].alias("tag"),
        "metric",
        (F.col("average") == F.col("least")).alias("is_least"),
        "same_results",
        "results",
        "stages",
    )


def _search(spark: SparkSession, sf_dir: str, folder: str) -> Training:
    """A search of the plan with its own settings but for the tree sizes, which are held small."""

    def maps(pipeline: Pipeline) -> list[dict]:
        return [{p: v for p, v in m.items() if p.name not in _SMALL_TREES} for m in search_space(pipeline, iterations=_DRAWS)]

    return train(wide(spark, sf_dir, spread=True), maps=maps, log_folder=folder, experiment="houses", tags={"tag": "1"}, **_SMALL_TREES)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM orders")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline with the group imputer, saved and loaded, gives the same values."""
    price = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    span = F.shiftright("o_orderkey", 5)  # many groups, each with prices to fill and prices to learn from
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", price.alias("price"), span.alias("span"))
    imputer = GroupImputer(inputCol="price", outputCol="price_imputed", groupCol="span")
    indexer = LabelIndexer(inputCols=["o_orderpriority"], outputCols=["priority"], handleInvalid="keep")
    assembler = VectorAssembler(inputCols=["price_imputed", "priority"], outputCol="v", handleInvalid="keep")
    model = Pipeline(stages=[imputer, indexer, assembler]).fit(orders)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    keys = ["o_orderkey", vector_to_array("v").alias("v")]
    before = model.transform(orders).select(*keys)
    after = PipelineModel.load(path).transform(orders).select("o_orderkey", vector_to_array("v").alias("w"))
    both = before.join(after, on="o_orderkey")
    return both.agg(F.count("*").alias("n"), F.count(F.when(~F.col("v").eqNullSafe(F.col("w")), 1)).alias("different"))


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 6) AS mae FROM lineitem")
def mae_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator agrees with the plain aggregate."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias(V.LABEL), (F.col("l_quantity") * 1000).alias(V.PREDICTION)
    )
    value = evaluator("mae").evaluate(line)
    return spark.range(1).select(F.round(F.lit(float(value)), 6).alias("mae"))
