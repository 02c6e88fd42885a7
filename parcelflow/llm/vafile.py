"""Exact search for the k greatest inner products with a vector-approximation file.

Vectors are quantised to integers, floor(``levels`` * x) per component, and compared exactly.

1. Equal vectors are one class, with its k + 1 first members: no more of them can come among the first k.
2. The approximation file.  Classes lie in blocks; a block has a grid of its own, ``2^bits`` (256 at most) cells between the least and greatest component
   of each dimension, and keeps one byte per component, the cell.
3. Scan.  Every block of queries meets every block of cells.  For a query the middles of the cells and the cells' half widths give
   bounds on each product, one matrix product per pair of blocks.  A pair of blocks keeps the candidates whose upper bound reaches
   the kth greatest lower bound there; then the kth greatest lower bound of all blocks is asked.
4. Reading.  The first ``first_reads`` candidates of a query, in the order of upper bounds, are read exactly.  Of the others only
   those are read whose upper bound reaches the kth greatest product so far; after that the result is certain.

Each query meets all rows, in blocks: queries and cells are dealt to a grid of (group of cells, group of queries), both of bounded size,
so no task holds more than one such pair, and no key is hot.  Exact vectors move only to candidates.  Work grows with
queries times rows, as asked; what is written grows with candidates.

Defined results: a null vector, and one with a null or non-finite component, takes no part; a null id is a candidate after all others and never
a query; repeated rows are rows of their own, and only the query's own row is no candidate; vectors meet those of the
same length only; products beyond 64 bits become the nearest long, components beyond 62 bits too; empty tables give an empty result; other columns are
ignored; equal products go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.scratch import materialize

_MOST = 1 << 62
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Settings:
    """``cells_rows`` and ``query_rows`` bound a task's share, ``first_reads`` the first round of exact reading."""

    k: int = 5
    levels: int = 256
    bits: int = 6
    cells_rows: int = 1 << 14
    query_rows: int = 1 << 12
    first_reads: int = 24
    tile: int = 1 << 21  # bounds held at once


_VECTOR = "row long, id long, dim int, v binary"


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, settings: Settings) -> DataFrame:
    """(row, id, dim, v): the vectors that take part, as ``encoded``; rows are numbered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            lost = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(x * settings.levels)
                lost = lost | ~np.isfinite(x)
                q = np.clip(np.where(lost, 0.0, q), -float(_MOST), float(_MOST)).astype(np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(lost)])
            whole = (bad[ends] == bad[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(whole)
            columns = [
                pa.array(number + rows, pa.int64()),
                batch.column(0).take(pa.array(rows)),
                pa.array(sizes[rows], pa.int32()),
                pa.array(encoded(q, ends[rows] - sizes[rows], ends[rows]), pa.binary()),
            ]
            number += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "dim", "v"])

    held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return materialize(held.mapInArrow(run, _VECTOR), "vectors")


def encoded(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Stretches of integers as bytes, each in the smallest of 2, 4 or 8 bytes a component that holds it all."""
    narrow, out = {}, []
    for kind in ("<i2", "<i4", "<i8"):
        limits = np.iinfo(kind)
        beyond = np.concatenate([[0], np.cumsum((flat < limits.min) | (flat > limits.max))])
        narrow[kind] = beyond[ends] == beyond[starts], flat.astype(kind).tobytes(), limits.bits // 8
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        data, size = next((data, size) for fits, data, size in narrow.values() if fits[k])
        out.append(data[a * size : b * size])
    return out


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """The integers of encoded vectors of one length, a row each."""
    out = np.zeros((len(vectors), dim), np.int64)
    if dim:
        sizes = np.array([len(v) // dim for v in vectors])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            out[own] = np.frombuffer(b"".join([vectors[i] for i in own.tolist()]), f"<i{size}").reshape(len(own), dim)
    return out


def _blocks(vectors: DataFrame, rows: int, schema: str, make: Callable[[int, list[int], list[bytes]], list], label: str) -> DataFrame:
    """Rows (part, dim, ...) for every ``rows`` vectors (class, dim, v) of one length, the rest made by ``make``."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dim: int) -> pa.RecordBatch:
            values = [[number], [dim], *([x] for x in make(dim, *held.pop(dim)))]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "part" else pa.int32() if n == "dim" else pa.binary()) for n, v in zip(names, values)], names=names)

        for batch in batches:
            for name, dim, v in zip(*(c.to_pylist() for c in batch.columns)):
                classes, own = held.setdefault(dim, ([], []))
                classes.append(name)
                own.append(v)
                if len(own) == rows:
                    yield block(dim)
                    number += 1
        for dim in list(held):
            yield block(dim)
            number += 1

    return materialize(vectors.select("class", "dim", "v").mapInArrow(run, schema), label)


def _approximated(classes: DataFrame, settings: Settings) -> DataFrame:
    """The approximation file: blocks of classes of one length, each with its grid and the cell of every component."""

    def make(dim: int, names: list[int], vectors: list[bytes]) -> list[bytes]:
        v = matrix(vectors, dim).astype(np.float64)
        low, high = v.min(axis=0), v.max(axis=0)
        width = np.ceil((high - low + 1) / (1 << settings.bits))  # integers of a cell
        cells = np.clip((v - low) // width, 0, (1 << settings.bits) - 1).astype(np.uint8)
        return [np.array(names, "<i8").tobytes(), low.tobytes(), width.tobytes(), cells.tobytes()]

    return _blocks(classes, settings.cells_rows, "part long, dim int, classes binary, low binary, width binary, cells binary", make, "cells")


def _in_blocks(asked: DataFrame, settings: Settings) -> DataFrame:
    """The distinct queries in blocks."""

    def make(dim: int, names: list[int], vectors: list[bytes]) -> list[bytes]:
        return [np.array(names, "<i8").tobytes(), matrix(vectors, dim).astype("<f8").tobytes()]

    return _blocks(asked, settings.query_rows, "part long, dim int, classes binary, v binary", make, "queries")


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest possible product of each query with each vector of the cells, and by how much its least one is lower.

    The cell c of a dimension holds the integers from low + c * width to low + (c + 1) * width - 1.
    """
    half = (width - 1) / 2
    middle = (queries @ (low + half))[:, None] + (queries * width) @ cells.T.astype(np.float64)
    # Room for the rounding of integers, and of sums of products, to doubles.
    most = np.maximum(np.abs(low), np.abs(low + 256 * width))
    rounding = (np.abs(queries) @ most + 1) * (8 * (len(low) + 4) * np.finfo(np.float64).eps)
    reach = np.abs(queries) @ half + rounding
    return middle + reach[:, None], 2 * reach


def _floats(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(shape) if data else np.zeros(shape)


_FOUND = "q long, class long, upper double, lower double"


def _scan(queries: DataFrame, cells: DataFrame, settings: Settings) -> DataFrame:
    """(q, class, upper, lower): per query and block of cells the candidates among its k + 1 best there."""
    k = settings.k + 1

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for c in left.itertuples():
            names = np.frombuffer(c.classes, "<i8")
            low, width = _floats(c.low, c.dim), _floats(c.width, c.dim)
            grid = np.frombuffer(c.cells or b"", np.uint8).reshape(len(names), c.dim)
            for b in right.itertuples():
                asked = np.frombuffer(b.classes, "<i8")
                v = _floats(b.v, len(asked), c.dim)
                step = max(1, settings.tile // len(names))
                for a in range(0, len(asked), step):
                    upper, gap = bounds(v[a : a + step], low, width, grid)
                    if len(names) > k:
                        kth = np.partition(upper, len(names) - k, axis=1)[:, len(names) - k] - gap
                        rows, at = np.nonzero(upper >= kth[:, None])
                    else:
                        rows, at = np.nonzero(np.ones_like(upper, bool))
                    top = upper[rows, at]
                    found.append(pd.DataFrame({"q": asked[a : a + step][rows], "class": names[at], "upper": top, "lower": top - gap[rows]}))
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in ("q", "class", "upper", "lower")})

    # The grid: cells go to all groups of queries of their length, queries to all groups of cells.
    numbers = lambda df: df.groupBy("dim").agg(F.sort_array(F.collect_list("part")).alias("others")).withColumnRenamed("dim", "d")
    left = cells.join(numbers(queries), F.col("dim") == F.col("d")).withColumn("asked", F.explode("others")).withColumnRenamed("part", "block")
    right = queries.join(numbers(cells), F.col("dim") == F.col("d")).withColumn("block", F.explode("others")).withColumnRenamed("part", "asked")
    left = left.select("block", "asked", "dim", "classes", "low", "width", "cells").groupBy("block", "asked")
    return left.cogroup(right.select("block", "asked", "classes", "v").groupBy("block", "asked")).applyInPandas(run, _FOUND)


def _products(pairs: DataFrame) -> DataFrame:
    """(q, class, score) of the pairs with their vectors qv and cv: exact, in doubles where those are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            score = np.zeros(len(dims), np.int64)
            left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                a, b = (matrix([x[i] for i in own.tolist()], dim) for x in (left, right))
                score[own] = exact_products(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "class", "score"])

    return pairs.select("q", "class", "dim", "qv", "cv").mapInArrow(run, "q long, class long, score long")


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; by Python's integers where 63 bits might not do."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    sums = [sum(x * y for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    return np.array([min(max(s, int(_LONG.min)), int(_LONG.max)) for s in sums], np.int64)


def _kth(scored: DataFrame, value: str, k: int) -> DataFrame:
    """(q, kth): the kth greatest value of each query, null if there are fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
    return scored.select("q", value, place.alias("place")).filter(F.col("place") == k).select(F.col("q").alias("of"), F.col(value).alias("kth"))


def search(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id fulfils ``asked``, a condition on the column ``id``, its k best other rows."""
    k = settings.k
    rows = _quantised(vectors, id_col, vector_col, settings)
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "row")
    place = F.row_number().over(Window.partitionBy("dim", "v").orderBy(F.col("id").isNull(), "id", "row"))
    firsts = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    members = firsts.groupBy("dim", "v").agg(F.sort_array(F.collect_list(order)).alias("members"))
    members = materialize(members.withColumn("class", F.monotonically_increasing_id()), "classes")
    wanted = rows.filter(asked & F.col("id").isNotNull()).select(F.col("row").alias("own"), F.col("id").alias("query_id"), F.col("dim").alias("d"), F.col("v").alias("qv"))
    same = (F.col("dim") == F.col("d")) & (F.col("v") == F.col("qv"))
    wanted = materialize(wanted.join(members.select("class", "dim", "v"), same).select("own", "query_id", F.col("class").alias("of"), "dim", "v"), "asked")

    distinct = wanted.select(F.col("of").alias("class"), "dim", "v").dropDuplicates(["class"])
    found = materialize(_scan(_in_blocks(distinct, settings), _approximated(members, settings), settings), "candidates")
    # One class more than asked for, as the query's own row may be all of its class.
    enough = _kth(found, "lower", k + 1)
    found = found.join(enough, F.col("q") == F.col("of"), "left").filter("kth is null or upper >= kth").select("q", "class", "upper")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "class"))
    found = materialize(found.withColumn("nth", nth), "in-order")

    queries = distinct.select(F.col("class").alias("of"), "dim", F.col("v").alias("qv"))
    exact = members.select(F.col("class").alias("c"), F.col("v").alias("cv"))
    read = lambda pairs: _products(pairs.join(queries, F.col("q") == F.col("of")).join(exact, F.col("class") == F.col("c")))
    scored = materialize(read(found.filter(F.col("nth") <= settings.first_reads).select("q", "class")), "first-read")
    certain = _kth(scored, "score", k + 1)
    rest = found.filter(F.col("nth") > settings.first_reads).join(certain, F.col("q") == F.col("of"), "left").filter("kth is null or upper >= kth")
    scored = scored.unionByName(read(rest.select("q", "class")))
    # Classes beyond the first k + 1 products cannot come in, but for ties.
    scored = scored.withColumn("level", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("level") <= k + 1)

    held = members.select(F.col("class").alias("c"), F.explode("members").alias("m"))
    best = scored.join(held, F.col("class") == F.col("c")).select("q", "score", "m.*")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "unknown", "id", "row")
    best = materialize(best.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1).drop("place"), "best")
    out = wanted.select("own", "query_id", "of").join(best, F.col("of") == F.col("q")).filter("own <> row")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "unknown", "id", "row"))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
