"""Sources, relational operators, statistics and preprocessing on small hand-made frames."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelflow.functions import scalars
from parcelflow.ml.preprocess import PROPERTY_RULES, Preprocess, PreprocessModel, Rules, preprocess
from parcelflow.operators import statistics as S
from parcelflow.operators.correlations import ROW_ID, _null_masks, correlation, ranked_values, top_correlations
from parcelflow.operators.ordering import exact_percentiles, running_counts
from parcelflow.operators.relational import align, first_per_key, merge_suffixed
from parcelflow.plans import exploration
from parcelflow.plans import fixed_values as V
from parcelflow.scratch import materialize, release, run_folder, scratch_dir
from parcelflow.sources.places import clean_places, select_areas
from parcelflow.sources.tables import read_tables, scan


def test_scratch_follows_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_read_tables(spark, tmp_path):
    for name, text in {
        "p1": "parcelid,size\n1,10\n2,20\n",
        "t1": "parcelid,logerror\n1,0.1\n1,0.2\n3,0.3\n",
        "p2": "parcelid,size\n1,11\n",
        "t2": "parcelid,logerror\n1,0.5\n",
        "f": "parcelid,elevation\n1,7.5\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    path = lambda n: str(tmp_path / f"{n}.csv")
    config = {
        "files": {"2016": {"props": path("p1"), "trans": path("t1")}, "2017": {"props": path("p2"), "trans": path("t2")}},
        "schema": {
            "props": ["parcelid INT NOT NULL", "size INT"],
            "trans": ["parcelid INT NOT NULL", "logerror FLOAT"],
            "external_features": ["parcelid INT NOT NULL", "elevation FLOAT"],
        },
        "format": "csv",
        "header": "true",
        "delimiter": ",",
    }
    df = read_tables(spark, config, path("f"))
    assert df.columns == ["parcelid", "size", "logerror", "elevation"]
    assert sorted((r[0], r[1], round(r[2], 2), r[3]) for r in df.collect()) == [
        (1, 10, 0.1, 7.5), (1, 10, 0.2, 7.5), (1, 11, 0.5, 7.5),
    ]
    assert "elevation" not in read_tables(spark, config).columns
    assert scan(spark, path("p1"), ["parcelid INT", "size INT"]).count() == 2


def test_places_and_areas(spark):
    rows = [("Big city city", 5, 1), ("Old town", 3, 1), ("Note", None, 1)]
    raw = spark.createDataFrame(rows, "place string, y2017 int, y2016 int")
    assert [tuple(r) for r in clean_places(raw, "place", "y2017").collect()] == [("Big", 5), ("Old", 3)]
    assert select_areas(raw, "Note", "place").count() == 1
    assert select_areas(raw, ["Note", "Old town"], "place").count() == 2
    with pytest.raises(TypeError):
        select_areas(raw, 7, "place")


def test_first_per_key_and_merge(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (2, None, "c"), (2, 1, "d")], "k int, o int, v string")
    got = {r["k"]: r["v"] for r in first_per_key(df.filter("o is not null"), ["k"], ["o"]).collect()}
    assert got == {1: "a", 2: "d"}
    other = spark.createDataFrame([(1, 9)], "k int, o int")
    merged = merge_suffixed(df, other, "k", ("_l", "_r"))
    assert merged.columns == ["k", "o_l", "v", "o_r"] and merged.count() == 2


def test_align(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, a string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, b int")
    assert sorted(tuple(r) for r in align([a, b], "k").collect()) == [(1, "x", None), (2, None, 5), (3, None, 6)]
    with pytest.raises(ValueError):
        align([a, a], "k")
    with pytest.raises(PySparkException):
        align([a.union(a), b], "k").collect()


def test_running_counts_and_percentiles(spark):
    rng = random.Random(6)
    values = [(g, float(rng.choice([1, 1, 1, 2, 3, 5, 8, 13, 21, 34]))) for g in "ab" for _ in range(157)]
    df = spark.createDataFrame(values, "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in running_counts(counts, ["g"], "v").collect():
        mine = [v for g, v in values if g == r["g"]]
        assert r["before"] == sum(v < r["v"] for v in mine) and r["total"] == len(mine)
    for r in exact_percentiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5}).collect():
        mine = sorted(v for g, v in values if g == r["g"])
        assert r["q1"] == mine[39] and r["med"] == mine[78]


def test_value_distribution_and_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, None)], "s string, n int")
    assert [tuple(r) for r in S.value_distribution(df, "s").collect()] == [("a", 66.667), (None, 33.333)]
    got = [(r[0], round(r[1], 3)) for r in S.missing_percent(df).collect()]
    assert got == [("s", 33.333), ("n", 66.667)]


def test_summary_modes(spark):
    df = spark.createDataFrame([(float(v), None) for v in (1, 2, 3, 4, 100)], "v double, empty double")
    for exact in (True, False):
        rows = {r["field"]: r for r in S.summary_continuous(df, exact=exact).collect()}
        r = rows["v"]
        assert (r["q1"], r["median"], r["q3"], r["lower_extreme"], r["upper_extreme"]) == (2, 3, 4, -1, 7)
        assert r["skewness"] == pytest.approx(3 * (22 - 3) / r["stddev"])
        assert rows["empty"]["count"] == 0 and rows["empty"]["median"] is None
    coded = {r["field"]: r for r in S.summary_continuous(df, mode="as_coded").collect()}["v"]
    assert coded["upper_extreme"] == pytest.approx(4 + 1.5 * coded["skewness"])
    with pytest.raises(ValueError):
        S.summary_continuous(df, mode="other")


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def _corr(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    up = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return up / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


def test_correlations(spark):
    rng = random.Random(7)
    rows = [(float(rng.randint(0, 5)), float(rng.randint(0, 50)), rng.random() if rng.random() < 0.7 else None) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    full = [r for r in rows if r[2] is not None]
    cols = list(zip(*full))
    got = {(r[0], r[1]): r[2] for r in correlation(df, "spearman").collect()}
    assert len(got) == 9 and got[("a", "a")] == 1
    assert got[("b", "a")] == pytest.approx(_corr(_ranks(cols[0]), _ranks(cols[1])))
    pearson = {(r[0], r[1]): r[2] for r in correlation(df, "pearson").collect()}
    assert pearson[("a", "c")] == pytest.approx(_corr(cols[0], cols[2]))
    coded = {(r[0], r[1]): r[2] for r in correlation(df, "pearson", mode="as_coded").collect()}
    assert coded[("a", "c")] == pytest.approx(got[("a", "c")])
    top = {(r[0], r[1]): r[2] for r in top_correlations(df, 15).collect()}
    whole = list(zip(*rows))
    assert top[("a", "b")] == pytest.approx(abs(_corr(_ranks(whole[0]), _ranks(whole[1]))))
    assert top[("a", "c")] == pytest.approx(abs(_corr(_ranks(cols[0]), _ranks(cols[2]))))
    with pytest.raises(ValueError):
        correlation(df, "kendall")


def test_ranks_make_no_row_per_pair(spark):
    """Twelve columns with three null patterns: at most columns x masks x rows values are ranked, not one per pair and row."""
    rng = random.Random(4)
    rows = [[rng.random() if k % 3 == 0 or (k % 3 == 1 and i % 5) or (k % 3 == 2 and i % 7) else None for k in range(12)] for i in range(60)]
    columns = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    numbered = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    masks = _null_masks(numbered, columns)
    assert len(set(masks.values())) == 3
    assert ranked_values(numbered, masks).count() <= 12 * 3 * 60
    got = {(r[0], r[1]): r[2] for r in top_correlations(df, 100).collect()}
    frame = df.toPandas()
    for (a, b), value in got.items():
        both = frame[[a, b]].dropna().rank()
        assert value == pytest.approx(abs(both[a].corr(both[b])), abs=1e-9)
    assert len(got) == 66


def test_crosstab_histogram_distinct(spark):
    df = spark.createDataFrame([(True, None), (None, True), (True, True), (True, True)], "a boolean, b boolean")
    table = S.crosstab(df, "a", "b")
    assert set(table.columns) == {"a_b", "true", "null"}
    assert {r["a_b"]: (r["true"], r["null"]) for r in table.collect()} == {"true": (2, 1), "null": (1, 0)}
    assert {tuple(r) for r in S.pair_counts(df, "a", "b").collect()} == {("true", "true", 2), ("true", "null", 1), ("null", "true", 1)}
    values = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "v double")
    bins = {r["bin"]: (r["n"], r["density"]) for r in S.histogram(values, "v", 10).collect()}
    assert len(bins) == 10 and bins[9] == (1, 0.25) and bins[5] == (0, 0.0)
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in S.histogram(constant, "v", 4).collect()) == 2
    assert {r[0]: r[1] for r in S.distinct_counts(df).collect()} == {"a": 1, "b": 1}


def test_exploration_report(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True), (2, 3.0, "y", None)], "a int, b double, s string, f boolean")
    tables = exploration.report(df, pearson=[["a", "b"]], crosstabs=[("s", "f")])
    assert {"missing_percent", "describe", "summary", "distribution:s", "distribution:f", "pearson:a,b", "crosstab:s,f"} == set(tables)
    assert all(t.count() > 0 for t in tables.values())


def test_scalar_rules(spark):
    df = spark.createDataFrame([(-3.0, "a", "4.5"), (5.0, None, "x"), (None, "z", None)], "v double, s string, t string")
    row = df.select(
        scalars.log_shift(F.col("v"), -3.0).alias("l"),
        scalars.sqrt_shift(F.col("v"), None).alias("q"),
        scalars.cube_root(F.col("v")).alias("c"),
        scalars.keep_or_bin(F.col("s"), ["a"], "o").alias("k"),
        scalars.above(F.col("v"), 5).alias("t"),
        scalars.try_number(F.col("t")).alias("n"),
    ).collect()
    assert row[0]["l"] == 0 and row[0]["c"] != row[0]["c"]  # NaN
    assert row[1]["q"] == pytest.approx(5**0.5) and row[1]["t"] == 0
    assert [r["k"] for r in row] == ["a", None, "o"] and [r["n"] for r in row] == [4.5, None, None]


RULES = Rules(
    fill={"count": 0}, log=["count", "near"], keep=[("kind", [1, 2], 9)], above=[("near", 1), ("count", 0)],
    flags=[("late", "Y")], null_zero_with=[("size", "count")], dates=[("day", "sold")], drop=["gone"],
)


def test_preprocess_modes(spark, tmp_path):
    rows = [(None, 1.0, 7, "Y", 0, "2020-02-29", 1), (3, None, 1, None, 0, None, 1)]
    df = spark.createDataFrame(rows, "count int, near double, kind int, late string, size int, day string, gone int")
    df = df.withColumn("day", F.to_date("day"))
    done = preprocess(df, RULES).collect()
    assert done[0]["count"] == 0 and done[0]["kind"] == 9 and done[0]["late"] == 1 and done[0]["size"] == 0
    assert done[1]["count"] == pytest.approx(1.3862943) and done[1]["size"] is None and done[1]["count_bin"] == 1
    assert done[0]["near_bin"] == 0 and (done[0]["sold_year"], done[0]["sold_month"], done[0]["sold_day"]) == (2020, 2, 29)
    coded = preprocess(df, RULES, mode="as_coded").collect()
    assert coded[1]["count"] == 3.0 and coded[0]["kind"] == 7.0 and coded[1]["size"] == 0.0
    assert [r["near"] for r in coded] == [0, 0] and "near_bin" not in coded[0].asDict()
    with pytest.raises(ValueError):
        Preprocess(mode="other")
    with pytest.raises(ValueError):
        preprocess(df.drop("near"), RULES, strict=True)
    assert "near" not in preprocess(df.drop("near"), RULES).columns
    model = Preprocess(rules=RULES).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PreprocessModel.load(str(tmp_path / "m")).transform(df).collect()
    assert again == model.transform(df).collect()


def test_fixed_values_are_consistent():
    names = [d.split()[0] for d in [*V.TRANSACTIONS, *V.PROPERTIES[1:], *V.EXTERNAL_FEATURES[1:]]]
    assert (len(V.PROPERTIES), len(V.EXTERNAL_FEATURES), len(set(names))) == (58, 26, len(names))
    assert PROPERTY_RULES.columns() <= set(names) and set(V.DROP) <= set(names)


def test_release_removes_only_the_runs_tables(spark):
    written = materialize(spark.range(3), "kept-for-now")
    path = written.inputFiles()[0].removeprefix("file://")
    assert run_folder(spark) in path and os.path.exists(path)
    release(spark)
    assert not os.path.exists(path) and os.path.isdir(scratch_dir(spark).removeprefix("file:"))
