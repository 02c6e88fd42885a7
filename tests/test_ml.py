"""Group imputer, random grid, pipeline and run log."""

import random
import threading
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from parcelflow.functions.draws import normal, row_key, uniform
from parcelflow.ml import search
from parcelflow.ml.group_imputer import GroupImputer, GroupImputerModel
from parcelflow.ml.label_index import LabelIndexer, LabelIndexModel
from parcelflow.ml.pipeline import feature_columns, search_space, build_pipeline
from parcelflow.ml.random_grid import RandomGridBuilder
from parcelflow.ml.run_log import best_result
from parcelflow.operators.sampling import sample, split
from parcelflow.plans import fixed_values as V
from parcelflow.plans.training import train_test
from parcelflow.queries import standins
from parcelflow.scratch import materialize

ROWS = [("a", 2.0, 1), ("a", 4.0, 4), ("a", 9.0, 4), ("a", None, None), ("b", 7.0, 3), ("b", None, None), ("c", None, None), (None, None, 1)]


@pytest.fixture
def grouped(spark):
    return spark.createDataFrame(ROWS, "g string, v double, n int")


def fill(df, **kw):
    return GroupImputer(groupCol="g", **kw).fit(df).transform(df)


def test_group_means(grouped):
    done = fill(grouped, inputCols=["v", "n"], outputCols=["v2", "n2"])
    assert done.columns == ["g", "v", "n", "v2", "n2"] and done.schema["n2"].dataType.simpleString() == "int"
    got = sorted((str(r["g"]), r["v2"], r["n2"]) for r in done.filter("v is null").collect())
    assert got == [("None", None, 1), ("a", 5.0, 3), ("b", 7.0, 3), ("c", None, None)]
    kept = done.filter("v is not null and v <> v2").count()
    assert kept == 0


def test_noise_keeps_values_and_single_groups(grouped):
    done = fill(grouped, inputCol="v", outputCol="out", stochastic=True).collect()
    assert all(r["out"] == r["v"] for r in done if r["v"] is not None)
    filled = {r["g"]: r["out"] for r in done if r["v"] is None}
    assert filled["b"] == 7.0 and filled["a"] is not None and filled["c"] is None and filled[None] is None


def test_draws_do_not_depend_on_place(spark):
    """Split, sample and noise are the same for one, three and seventeen partitions and any order; equal keys draw alike, streams differ."""
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN CAST(id % 97 AS DOUBLE) END AS v", "id % 5 AS g")
    imputer = GroupImputer(inputCol="v", outputCol="out", groupCol="g", stochastic=True, keyCols=["id"])
    model = imputer.fit(df)
    seen = []
    for parts in (1, 3, 17):
        laid = df.orderBy(F.rand(parts)).repartition(parts)
        noise = {r["id"]: r["out"] for r in model.transform(laid).collect()}
        sets = [{r["id"] for r in p.collect()} for p in (sample(laid, 0.1, ["id"]), sample(laid, 0.3, ["id"]), *split(laid, [3, 1, 0], ["id"]))]
        seen.append((noise, sets))
    assert seen[0] == seen[1] == seen[2]
    small, large, one, two, none = seen[0][1]
    assert small < large and 1800 < len(small) < 2200 and 5700 < len(large) < 6300
    assert not one & two and len(one | two) == 20_000 and 14_700 < len(one) < 15_300 and not none


def test_draws_are_normal_and_tell_nulls_from_texts(spark):
    df = spark.createDataFrame([("a", None), ("a", "?"), ("a", "="), (None, None), ("a", None)], "k string, m string")
    got = [r[0] for r in df.select(uniform(row_key(df), 1)).collect()]
    assert got[0] == got[4] and len(set(got)) == 4
    many = spark.range(100_000).withColumn("z", normal([F.col("id")], 7)).withColumn("y", normal([F.col("id")], 7, "other"))
    mean, std, below, both = many.selectExpr("avg(z)", "stddev(z)", "avg(CAST(z < -1.96 AS INT))", "corr(z, y)").first()
    assert abs(mean) < 0.015 and abs(std - 1) < 0.01 and abs(below - 0.025) < 0.003 and abs(both) < 0.015
    with pytest.raises(ValueError):
        row_key(df, ["absent"])
    with pytest.raises(ValueError):
        sample(df, 1.5)


def test_label_index_is_spark_s_and_saved_as_a_table(spark, tmp_path):
    """Counts, ties, nulls, unseen labels, two columns at once, numbers as labels; the loaded model reads nothing outside its folder."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "dd", "", None]), rng.randint(0, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string, k int")
    names = {"inputCols": ["t", "k"], "outputCols": ["ti", "ki"], "handleInvalid": "keep"}
    other = df.unionByName(spark.createDataFrame([(-1, "new", 999), (-2, None, None)], df.schema))
    want = {r["id"]: (r["ti"], r["ki"]) for r in StringIndexer(**names).fit(df).transform(other).collect()}
    model = LabelIndexer(**names).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    for m in (model, LabelIndexModel.load(str(tmp_path / "model"))):
        done = m.transform(other)
        assert {r["id"]: (r["ti"], r["ki"]) for r in done.collect()} == want and done.count() == 3002
        assert done.schema["ti"].metadata["ml_attr"]["num_vals"] == 6
    assert model.copy({model.handleInvalid: "skip"}).transform(other).count() == sum(t is not None for _, t, _ in rows)
    with pytest.raises(Exception, match="no number for a label"):
        model.copy({model.handleInvalid: "error"}).transform(other).collect()
    wide = OneHotEncoder(inputCols=["ti"], outputCols=["o"], handleInvalid="keep").fit(done).transform(done)
    assert wide.select("o").first()[0].size == 6
    assert LabelIndexer(**names).fit(df.limit(0)).transform(df).agg(F.sum("ti"), F.sum("ki")).first()[:] == (0.0, 0.0)


def test_unseen_group_and_persistence(spark, grouped, tmp_path):
    imputer = GroupImputer(inputCol="v", outputCol="out", groupCol="g")
    model = Pipeline(stages=[imputer]).fit(grouped)
    model.write().overwrite().save(str(tmp_path / "model"))
    other = spark.createDataFrame([("a", None), ("new", None)], "g string, v double")
    assert {r["g"]: r["out"] for r in PipelineModel.load(str(tmp_path / "model")).transform(other).collect()} == {"a": 5.0, "new": None}


def test_saved_model_holds_its_statistics(spark, tmp_path):
    """Many groups; what is loaded reads nothing outside the model's folder."""
    df = spark.range(100_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN CAST(id AS DOUBLE) END AS v", "id DIV 2 AS g")
    model = GroupImputer(inputCol="v", outputCol="out", groupCol="g").fit(df)
    model.write().save(str(tmp_path / "imputer"))
    loaded = GroupImputerModel.load(str(tmp_path / "imputer"))
    assert all(str(tmp_path / "imputer") in f for f in loaded.statistics.inputFiles())
    done = loaded.transform(df)
    assert done.filter("out <> id - id % 2").count() == 0 and done.filter("out is null").count() == 0


def test_integer_groups_keep_their_type(spark):
    df = spark.createDataFrame([(1, 3.0), (1, None), (2, 8.0)], "g long, v double")
    model = GroupImputer(inputCol="v", outputCol="v", groupCol="g").fit(df)
    assert sorted(r["v"] for r in model.transform(df).collect()) == [3.0, 3.0, 8.0]
    assert model.statistics.schema["group"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize(
    "settings, error",
    [
        ({"outputCol": "o", "groupCol": "g"}, ValueError),
        ({"inputCol": "v", "groupCol": "g"}, ValueError),
        ({"inputCol": "v", "inputCols": ["v"], "outputCol": "o", "groupCol": "g"}, ValueError),
        ({"inputCol": "v", "outputCols": ["o"], "groupCol": "g"}, ValueError),
        ({"inputCols": ["v", "n"], "outputCols": ["o"], "groupCol": "g"}, ValueError),
        ({"inputCol": "v", "outputCol": "o"}, ValueError),
        ({"inputCol": "missing", "outputCol": "o", "groupCol": "g"}, ValueError),
        ({"inputCol": "v", "outputCol": "o", "groupCol": "missing"}, ValueError),
        ({"inputCol": "g", "outputCol": "o", "groupCol": "g"}, TypeError),
    ],
)
def test_imputer_checks(grouped, settings, error):
    with pytest.raises(error):
        GroupImputer(**settings).fit(grouped)


def test_setters(grouped):
    imputer = GroupImputer().setInputCol("v").setOutputCol("o").setGroupCol("g").setStochastic(False)
    assert imputer.fit(grouped).transform(grouped).filter("o is null").count() == 2


def test_random_grid():
    lr = LinearRegression()

    def draw(seed):
        grid = RandomGridBuilder(3, seed).addGrid(lr.regParam, lambda: np.random.rand())
        return grid.addGrid(lr.maxIter, lambda: random.randint(1, 9)).addGrid(lr.tol, lambda rng: float(rng.random())).build()

    before = np.random.get_state()[1].tolist(), random.getstate()
    one = draw(42)
    assert (np.random.get_state()[1].tolist(), random.getstate()) == before
    assert len(one) == 3 and one == draw(42) and one != draw(43) and draw(0) == draw(0)
    assert draw(42)[1] == draw(43)[0]  # draw n depends on seed + n
    with pytest.raises(TypeError):
        RandomGridBuilder(1).addGrid(lr.maxIter, [1, 2])


def test_pipeline_columns():
    names = [d.split()[0] for d in [*V.TRANSACTIONS, *V.PROPERTIES[1:], *V.EXTERNAL_FEATURES[1:]]]
    names = [c for c in names if c not in V.DROP] + ["transaction_year", "transaction_month", "transaction_day"]
    features = feature_columns(names)
    assert len(features) == len(set(features)) == 58
    assert not {V.LABEL, *V.INDEXED, *V.HASHED, "garagetotalsqft", "garagecarcnt"} & set(features)
    assert len(feature_columns([*names, "highway_bin"])) == 59


def test_search_space(spark):
    pipeline = build_pipeline(["a", "logerror"])
    maps = search_space(pipeline, iterations=4)
    assert len(maps) == 4 and {p.name for p in maps[0]} == set(V.SEARCH_SPACE)


def searched(spark, kind, maps_of):
    """A pipeline with an estimator, a hasher and a regression, searched by the given kind of validator."""
    rows = spark.range(600).selectExpr(
        "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 13 AS STRING) AS s", "CASE WHEN id % 5 > 0 THEN CAST(id % 11 AS DOUBLE) END AS m",
        "CAST(id % 7 * 2 + id % 13 AS DOUBLE) AS label", "CAST(id * 31 % 3 AS INT) AS part",
    )
    imputer = Imputer(inputCols=["m"], outputCols=["m"])
    hasher = FeatureHasher(inputCols=["s"], outputCol="h", numFeatures=8)
    last = LinearRegression(featuresCol="f", labelCol="label", maxIter=5)
    pipeline = Pipeline(stages=[imputer, hasher, VectorAssembler(inputCols=["a", "m", "h"], outputCol="f"), last])
    judge = RegressionEvaluator(labelCol="label", metricName="mae")
    maps = maps_of(imputer, hasher, last)
    return kind(estimator=pipeline, estimatorParamMaps=maps, evaluator=judge, numFolds=3, foldCol="part").fit(rows), rows


def test_prefix_search_equals_cross_validator(spark, monkeypatch):
    def maps_of(imputer, hasher, last):
        return [
            {hasher.numFeatures: n, last.regParam: r, imputer.strategy: s}
            for n, r, s in ((4, 0.0, "mean"), (16, 0.1, "mean"), (4, 0.5, "mean"), (16, 0.1, "median"), (16, 0.1, "mean"))
        ]

    want, rows = searched(spark, CrossValidator, maps_of)
    written, fitted = [], []
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    fit = Imputer.fit
    monkeypatch.setattr(Imputer, "fit", lambda self, df, params=None: fitted.append(1) or fit(self, df, params))
    got, _ = searched(spark, search.PrefixSearch, maps_of)
    assert written == ["features"] * (3 * 3 + 1)  # folds x distinct prefixes, and the best one again
    assert len(fitted) == 3 * 2 + 1  # folds x distinct settings of the imputer
    assert got.avgMetrics == pytest.approx(want.avgMetrics, rel=1e-3) and got.stdMetrics == pytest.approx(want.stdMetrics, rel=0.02, abs=1e-3)
    assert got.avgMetrics[1] == got.avgMetrics[4] and len(got.bestModel.stages) == 4
    weights = [m.bestModel.stages[-1].coefficients.toArray() for m in (got, want)]
    assert weights[0] == pytest.approx(weights[1], abs=0.02)


def test_prefix_search_draws_folds(spark):
    def maps_of(imputer, hasher, last):
        return [{last.regParam: 0.0}, {last.regParam: 9.0}]

    class Drawn(search.PrefixSearch):
        def __init__(self, foldCol=None, **kw):
            super().__init__(seed=3, **kw)

    got, _ = searched(spark, Drawn, maps_of)
    assert got.avgMetrics[0] < got.avgMetrics[1] and not got.bestModel.stages[-1].getRegParam()


def test_fit_pipeline_equals_fit(spark):
    model, rows = searched(spark, search.PrefixSearch, lambda i, h, last: [{last.regParam: 0.0}])
    pipeline = Pipeline(stages=[model.getEstimator().getStages()[k] for k in range(4)])
    a, b = search.fit_pipeline(pipeline, rows), pipeline.fit(rows)
    assert a.stages[-1].coefficients.toArray() == pytest.approx(b.stages[-1].coefficients.toArray(), abs=0.02)


def test_best_result(spark):
    rows = [(0, 2.0, 0.1, 0.05, {}), (1, 1.0, 0.1, 0.05, {}), (2, 1.0, 0.1, 0.05, {})]
    results = spark.createDataFrame(rows, "run int, average double, stddev double, standard_error double, parameters map<string,string>")
    assert best_result(results).first()["run"] == 1
    assert best_result(results, larger_is_better=True).first()["run"] == 0


def test_model_roundtrip_runs_on_its_own_orders(spark, tmp_path):
    from parcelflow.queries import QUERIES

    rows = [(k, p, float(k) * 10) for k, p in enumerate(["1-URGENT", "2-HIGH", None, "2-HIGH", "5-LOW"] * 4, start=1)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["model_roundtrip"](spark, str(tmp_path)).first()
    assert (got["n"], got["different"]) == (20, 0)


def test_model_roundtrip_depends_on_the_loaded_imputer(spark, tmp_path, monkeypatch):
    """Were the statistics lost on the way, the rows with a filled price would differ."""
    from parcelflow.ml import group_imputer
    from parcelflow.queries import QUERIES

    rows = [(k, "2-HIGH", float(k) * 10) for k in range(1, 101)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    whole = group_imputer._StatisticsReader.load

    def emptied(self, path):
        model = whole(self, path)
        model.statistics = model.statistics.limit(0)
        return model

    monkeypatch.setattr(group_imputer._StatisticsReader, "load", emptied)
    got = QUERIES["model_roundtrip"](spark, str(tmp_path)).first()
    assert (got["n"], got["different"]) == (100, 11)


def test_prefixes_of_different_folds_share_the_cluster(spark, monkeypatch):
    """The fits of three folds are under way at the same time: each waits for the others."""
    meeting = threading.Barrier(3, timeout=60)
    fit = LinearRegression.fit
    held = [0]

    def waits(self, df, params=None):
        if held[0] < 3:
            held[0] += 1
            meeting.wait()
        return fit(self, df, params)

    monkeypatch.setattr(LinearRegression, "fit", waits)

    class Three(search.PrefixSearch):
        def __init__(self, **kw):
            super().__init__(parallelism=3, **kw)

    got, _ = searched(spark, Three, lambda i, h, last: [{last.regParam: 0.0}])
    assert held == [3] and len(got.avgMetrics) == 1


def test_parts_read_their_draw(spark):
    """The hash of whole rows is written with them: the parts are those of ``split``, and reading one hashes nothing."""
    df = spark.range(2_000).selectExpr("id", "CAST(id % 97 AS DOUBLE) AS v", "CASE WHEN id % 5 > 0 THEN CAST(id AS STRING) END AS s")
    got, want = train_test(df), split(df, [V.TRAIN_RATIO, 1 - V.TRAIN_RATIO])
    assert [p.columns for p in got] == [df.columns] * 2
    assert [sorted(p.collect(), key=lambda r: r['id']) for p in got] == [sorted(p.collect(), key=lambda r: r['id']) for p in want]
    assert "md5" in want[0]._jdf.queryExecution().toString() and "md5" not in got[0]._jdf.queryExecution().toString()


def test_wide_rows_of_one_row_group_are_spread(spark, tmp_path):
    rows = [(k, k % 50, datetime(1995, 1, 1 + k % 28)) for k in range(1_000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    laid, spread = (standins.wide(spark, str(tmp_path), **kw) for kw in ({}, {"spread": True}))
    filled = [r["p"] for r in spread.select(F.spark_partition_id().alias("p")).distinct().collect()]
    assert len(filled) >= spark.sparkContext.defaultParallelism
    assert laid.exceptAll(spread).count() == spread.exceptAll(laid).count() == 0
