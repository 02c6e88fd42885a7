"""Convex hull of all points, and selection around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

_FAN_IN = 32


def _drop_inner(xy: np.ndarray) -> np.ndarray:
    """Drop points strictly inside the polygon of the extremes in eight directions."""
    x, y = xy[:, 0], xy[:, 1]
    ring = [xy[np.argmax(d)] for d in (x, x + y, y, y - x, -x, -x - y, -y, x - y)]
    inside = np.ones(len(xy), dtype=bool)
    corners = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ax == bx and ay == by:
            continue
        corners += 1
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
    return xy if corners < 3 else xy[~inside]


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the leftmost; collinear points are left out."""
    if len(xy) > 64:
        xy = _drop_inner(xy)
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def half(points):
        chain: list = []
        for p in points:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    corners = xy.tolist()
    return np.array(half(corners) + half(corners[::-1]))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners = np.empty((0, 2))
    for batch in batches:
        corners = _hull(np.vstack([corners, batch[["x", "y"]].to_numpy(dtype=float)]))
    yield pd.DataFrame(corners, columns=["x", "y"])


def _final(group: pd.DataFrame) -> pd.DataFrame:
    corners = pd.DataFrame(_hull(group[["x", "y"]].to_numpy(dtype=float)), columns=["x", "y"])
    corners.insert(0, "seq", np.arange(len(corners), dtype=np.int64))
    return corners


def convex_hull(points: DataFrame) -> DataFrame:
    """Hull corners ``(seq, x, y)`` of the points ``(x, y)``.

    Every task reduces its rows to the corners of their hull, the corners are reduced again in
    a few tasks, and only what is left (at most ``_FAN_IN`` hulls) meets in the last one.
    """
    schema = "x double, y double"
    located = points.select(F.col("x").cast("double"), F.col("y").cast("double")).dropna("any")
    corners = located.mapInPandas(_partial, schema)
    corners = corners.repartition(_FAN_IN, "x", "y").mapInPandas(_partial, schema)
    return corners.groupBy().applyInPandas(_final, "seq bigint, x double, y double")


def hull_edges(hull: DataFrame) -> Column:
    """The hull's edges as a scalar subquery (a hull has few corners)."""
    corners = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return hull.agg(corners.alias("ring")).select(geo.ring_edges(F.col("ring"))).scalar()


def select_pois(pois: DataFrame, tags: dict[str, list[str]], hull: DataFrame, buffer: float) -> DataFrame:
    """POIs ``(key, value, x, y)`` with a requested tag, within ``buffer`` of the hull."""
    asked = [(F.col("key") == F.lit(k)) & F.col("value").isin(list(v)) for k, v in tags.items()]
    wanted = asked[0]
    for condition in asked[1:]:
        wanted = wanted | condition
    near = geo.point_ring_distance(F.col("x"), F.col("y"), F.col("_hull")) <= F.lit(buffer)
    return pois.filter(wanted).withColumn("_hull", hull_edges(hull)).filter(near).drop("_hull")
