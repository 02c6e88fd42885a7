"""Raster tiles as cell tables: merge and lookup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


@dataclass(frozen=True)
class Grid:
    """Where cells lie: cell (row, col) spans from ``(x0 + col * dx, y0 + row * dy)``; a negative ``dy`` counts rows downwards."""

    x0: float
    y0: float
    dx: float
    dy: float


def _centres(index: str, start: float, step: float, to_start: float, to_step: float) -> Column:
    """Indices of the target cells whose centres lie in a cell, its lower edge included; an empty array if there are none."""
    edge = lambda k: F.lit(float(start)) + k * F.lit(float(step))
    at = lambda e: (e - F.lit(float(to_start))) / F.lit(float(to_step)) - F.lit(0.5)
    sides = [at(edge(F.col(index))), at(edge(F.col(index) + 1))]
    # Counted towards larger coordinates, the lower edge belongs to the cell; where target indices fall with them, it is the upper index.
    if to_step > 0:
        low, high = (F.ceil(f(*sides)).cast("bigint") for f in (F.least, F.greatest))
    else:
        low, high = ((F.floor(f(*sides)) + 1).cast("bigint") for f in (F.least, F.greatest))
    return F.when(low < high, F.sequence(low, high - 1))


def align_tile(cells: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """The ``(row, col, value)`` cells of a tile on another grid: each target cell takes the value at its centre.

    A coarse cell gives many target cells, a fine one none or one; no two cells of a tile give the same.
    """
    cols = _centres("col", grid.x0, grid.dx, target.x0, target.dx)
    rows = _centres("row", grid.y0, grid.dy, target.y0, target.dy)
    found = cells.select(rows.alias("rows"), cols.alias("cols"), "value").select("rows", F.explode("cols").alias("col"), "value")
    return found.select(F.explode("rows").alias("row"), "col", "value")


def merge_georeferenced(tiles: list[tuple[DataFrame, Grid]], target: Grid | None = None) -> DataFrame:
    """One raster on ``target`` (the first tile's grid by default) from tiles with grids of their own; the first value wins."""
    target = target or tiles[0][1]
    return merge_tiles([align_tile(cells, grid, target) for cells, grid in tiles])


def merge_tiles(tiles: list[DataFrame]) -> DataFrame:
    """One raster from several ``(row, col, value)`` tiles; where they overlap, the first with a value wins.

    A cell that no tile has a value for (null or NaN) is null.
    """
    ranked = [t.select("row", "col", "value", F.lit(i).alias("tile_order")) for i, t in enumerate(tiles)]
    # Cells of a tile hardly share a key, so combining them before the shuffle only holds a whole input split in one task.
    cells = reduce(DataFrame.unionByName, ranked).repartition("row", "col")
    valued = cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    order = F.when(F.col("value").isNotNull(), F.col("tile_order"))
    return valued.groupBy("row", "col").agg(F.min_by("value", order).alias("value"))


def raster_lookup(
    points: DataFrame,
    cells: DataFrame,
    x0: float,
    y0: float,
    cell_size: float,
    column: str = "elevation",
) -> DataFrame:
    """Value of the cell that holds each point, null outside the raster.

    ``(x0, y0)`` is the lower-left corner, rows count upwards. Points without coordinates are dropped.
    """
    located = points.filter(geo.is_located(F.col("x"), F.col("y"))).withColumns(
        {
            "row": F.floor((F.col("y") - F.lit(y0)) / F.lit(cell_size)).cast("bigint"),
            "col": F.floor((F.col("x") - F.lit(x0)) / F.lit(cell_size)).cast("bigint"),
        }
    )
    values = cells.select("row", "col", F.col("value").alias(column))
    return located.join(values, on=["row", "col"], how="left").drop("row", "col")
