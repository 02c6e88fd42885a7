"""Exact search against all products in Python's integers."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelflow.llm import vafile


def plain(rows, divisor, k=5):
    """(query_id, ranks) per query row, as sorted lists."""
    usable = []
    for row, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((row, i, [max(-(1 << 62), min(1 << 62, math.floor(256.0 * float(np.float32(x))))) for x in v]))
    out = []
    for row, i, v in usable:
        if i is not None and i % divisor == 0:
            others = [(j, sum(a * b for a, b in zip(v, w))) for r, j, w in usable if r != row and len(w) == len(v)]
            others = [(j, max(-(1 << 63), min((1 << 63) - 1, s))) for j, s in others]
            best = sorted(others, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
            out.append((i, [(n, j, s) for n, (j, s) in enumerate(best, 1)]))
    return sorted((i, n, j is None, j or 0, s) for i, best in out for n, j, s in best)


def rows():
    rng = random.Random(3)
    unit = lambda n: [rng.gauss(0, 1) / n**0.5 for _ in range(n)]
    hot = unit(16)
    out = [(k, unit(16)) for k in range(200)]
    out += [(200 + k, hot) for k in range(150)]  # a third is one vector
    out += [(400 + k, [x + rng.gauss(0, 0.002) for x in hot]) for k in range(40)]
    out += [(500 + k, unit(3)) for k in range(12)]  # fewer candidates, of another length
    out += [(600, None), (605, [math.nan] * 16), (610, [None] + unit(15)), (615, [math.inf] + unit(15)), (620, []), (621, []), (625, [0.0] * 16)]
    out += [(None, hot), (None, unit(16)), (10, unit(16)), (15, out[15][1]), (15, out[15][1]), (-20, unit(16))]  # repeated ids and rows
    out += [(700, [3e38, -3e38]), (705, [3e38, 3e38]), (706, [-1e30, 1.0]), (707, [1e15, 1e15]), (710, [1e3] * 2), (711, [200.0, -300.0]), (800, unit(7))]
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in "row id dim v class q score rank part upper label own query_id".split():
        df = df.selectExpr("*", f"'x' as {name}")
    return df.repartition(4)


@pytest.mark.parametrize("changes", [{}, {"cells_rows": 9, "query_rows": 4, "first_reads": 2, "bits": 2, "tile": 20}, {"bits": 8, "cells_rows": 1}, {"first_reads": 0, "bits": 1}])
def test_search(spark, changes):
    limits = vafile.Settings(**changes)
    got = vafile.search(frame(spark, rows()), F.col("id") % 5 == 0, settings=limits)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted((r[0], r[1], r[2] is None, r[2] or 0, r[3]) for r in got.collect()) == plain(rows(), 5)


def test_few_rows(spark):
    few = frame(spark, rows()[:3])
    assert [tuple(r)[:2] for r in vafile.search(few, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert vafile.search(few.limit(0), F.col("id") == 0).count() == 0
    assert vafile.search(few, F.col("id") == 999).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.integers(1, 8), st.sampled_from([3, 300, 1 << 40]), st.integers(0, 1 << 30))
def test_bounds_hold(dim, n, bits, most, seed):
    rng = np.random.default_rng(seed)
    v, q = (rng.integers(-most, most + 1, (m, dim)) for m in (n, 3))
    low, high = v.min(axis=0).astype(float), v.max(axis=0).astype(float)
    width = np.ceil((high - low + 1) / (1 << bits))
    upper, gap = vafile.bounds(q.astype(float), low, width, ((v - low) // width).astype(np.uint8))
    for a in range(3):
        for b in range(n):
            exact = sum(int(x) * int(y) for x, y in zip(q[a], v[b]))
            assert upper[a, b] - gap[a] <= exact <= upper[a, b]


def test_encoding():
    flat = np.array([1, -32768, 40000, 5, 1 << 40, 7], np.int64)
    data = vafile.encoded(flat, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 6]))
    assert [len(d) for d in data] == [4, 8, 16, 0]
    assert vafile.matrix(data[:3], 2).tolist() == [[1, -32768], [40000, 5], [1 << 40, 7]]
