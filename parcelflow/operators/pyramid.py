"""A persisted pyramid of grid cells over located sites.

Cells are squares whose side is a power of four metres counted from the origin, so the cells of any two tables fit into each other.
The finest cells are aggregated from the sites once; every coarser level is made of them, and all levels are one written table.
A cell carries its count and the tight box of its members, so joins compare cells before points: a pair of cells is settled as a whole
(too far apart, wholly within reach, never the nearest) or opened.

The finest side follows the density of the table.  Crowded spots need smaller cells than that: there ``opened`` goes on with the sites
of the cells that are still open, and with no others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

STEP = 2  # a level's side is 2^STEP times that of the level below
PER_CELL = 64  # sites that a finest cell of an even table holds at most
_BITS = 44  # of the greatest coordinate, below which places are not told apart


def cell(v: Column | str, exponent: int | Column) -> Column:
    """Index of the cell of side 2^exponent that holds a coordinate."""
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * (F.lit(2.0**-exponent) if isinstance(exponent, int) else F.pow(F.lit(2.0), -exponent)))


def _even(x: float) -> int:
    return STEP * math.floor(x / STEP)


@dataclass(frozen=True)
class Pyramid:
    """``sites`` (by, mx, my, weight, ...) and ``cells`` (level, by, x, y, n, w, box), both written; levels go from ``finest`` to ``top``.

    Sites with an extent have boxes ``xmin`` to ``ymax`` and a point that surely belongs to them (``rx, ry``); the boxes of
    those points are kept as ``r...``.
    """

    sites: DataFrame
    cells: DataFrame
    by: tuple[str, ...]
    finest: int
    top: int
    deepest: int

    @property
    def extended(self) -> bool:
        return "xmin" in self.sites.columns

    def at(self, level: int, prefix: str) -> DataFrame:
        """The cells of a level, with columns named for a side of a join, and their parents ``<prefix>px, <prefix>py``."""
        if level > self.top:  # a few cells
            found = _merged(self.cells.filter(F.col("level") == self.top), self.by, level - self.top).drop("level")
        elif level >= self.finest:
            found = self.cells.filter(F.col("level") == level).drop("level")
        else:
            found = _finest(self.sites, self.by, level)
        named = found.select(*self.by, *[F.col(c).alias(prefix + c) for c in found.columns if c not in self.by])
        return named.withColumns({f"{prefix}p{a}": F.shiftright(f"{prefix}{a}", STEP) for a in "xy"})

    def placed(self, level: int, prefix: str) -> DataFrame:
        """The sites with their cell of a level as ``<prefix>x, <prefix>y``."""
        return self.sites.withColumns({f"{prefix}x": cell("mx", level), f"{prefix}y": cell("my", level)})

    def opened(self, cells: DataFrame, level: int, prefix: str) -> Pyramid:
        """Only the sites in the given cells (<prefix>x, <prefix>y) of a level, to go on below it."""
        keys = [f"{prefix}x", f"{prefix}y"]
        inside = self.placed(level, prefix).join(cells.select(*keys).distinct(), keys, "left_semi").drop(*keys)
        return replace(self, sites=materialize(inside, "open-sites"), finest=level)


def _finest(sites: DataFrame, by: tuple[str, ...], level: int) -> DataFrame:
    extended = "xmin" in sites.columns
    ends = {"x1": F.min("xmin"), "x2": F.max("xmax"), "y1": F.min("ymin"), "y2": F.max("ymax")} if extended else {}
    sure_x, sure_y = ("rx", "ry") if extended else ("mx", "my")
    sure = {"x1": F.min(sure_x), "x2": F.max(sure_x), "y1": F.min(sure_y), "y2": F.max(sure_y)}
    measures = {**sure, **ends, **({f"r{k}": v for k, v in sure.items()} if extended else {})}
    keys = [*by, cell("mx", level).alias("x"), cell("my", level).alias("y")]
    return sites.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *[m.alias(k) for k, m in measures.items()])


def _merged(cells: DataFrame, by: tuple[str, ...], up: Column | int) -> DataFrame:
    """The cells ``up`` bits above."""
    up = F.lit(up) if isinstance(up, int) else up
    cells = cells.withColumn("up", up).withColumns({a: F.expr(f"shiftright({a}, up)") for a in "xy"})
    measures = [c for c in cells.columns if c[-2:] in ("x1", "x2", "y1", "y2")]
    boxes = [(F.min if c.endswith("1") else F.max)(c).alias(c) for c in measures]
    return cells.groupBy("level", *by, "x", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *boxes)


def build(sites: DataFrame, by: tuple[str, ...] = (), below: Pyramid | None = None) -> Pyramid | None:
    """The pyramid of written sites, nothing for no sites; it reaches as high as ``below``, a pyramid it is to be joined with."""
    box = [F.count("*"), F.min("mx"), F.max("mx"), F.min("my"), F.max("my")]
    n, x1, x2, y1, y2 = sites.agg(*box).first()
    if n == 0:
        return None
    most = math.log2(max(abs(x1), abs(x2), abs(y1), abs(y2), 1.0))
    deepest = _even(most) - _BITS
    wide, high = x2 - x1, y2 - y1
    side = max(math.sqrt(PER_CELL * wide / n * high), PER_CELL * max(wide, high) / n)
    finest = max(_even(math.log2(side)), deepest + STEP) if side > 0 else deepest + STEP
    top = max(_even(most) + 2 * STEP, finest)  # whatever lies there is in the four cells around the origin
    if below is not None:
        top = max(top, below.top)
    lowest = _finest(sites, by, finest)
    levels = F.explode(F.sequence(F.lit(finest), F.lit(top), F.lit(STEP)))
    cells = _merged(lowest.withColumn("level", levels), by, F.col("level") - finest)
    return Pyramid(sites, materialize(cells.sortWithinPartitions("level", "x", "y"), "cells"), by, finest, top, deepest)


BOX = ["tx1", "tx2", "ty1", "ty2"]


def box_gap() -> Column:
    """Least distance between the boxes of a target cell ``t`` and a source cell ``s``."""
    dx = F.greatest(F.lit(0.0), F.col("sx1") - F.col("tx2"), F.col("tx1") - F.col("sx2"))
    dy = F.greatest(F.lit(0.0), F.col("sy1") - F.col("ty2"), F.col("ty1") - F.col("sy2"))
    return F.sqrt(dx * dx + dy * dy)


def box_span(sure: bool = False) -> Column:
    """Greatest distance between two points of the boxes; with ``sure``, to the points that surely
    belong to the sources, so that each target has a source at most this far away."""
    s = "sr" if sure else "s"
    dx = F.greatest(F.col(f"{s}x2") - F.col("tx1"), F.col("tx2") - F.col(f"{s}x1"))
    dy = F.greatest(F.col(f"{s}y2") - F.col("ty1"), F.col("ty2") - F.col(f"{s}y1"))
    return F.sqrt(dx * dx + dy * dy)


def around(reach: Column, level: int | Column) -> tuple[Column, Column]:
    """Columns of the cells (x, y) of a level that the box of a target cell, grown by ``reach``, touches."""
    ranges = [F.sequence(cell(F.col(f"t{a}1") - reach, level), cell(F.col(f"t{a}2") + reach, level)) for a in "xy"]
    return ranges[0], ranges[1]


def split(pairs: DataFrame, targets: Pyramid, sources: Pyramid, t_level: int, s_level: int, reach: Column, keep: list[str]) -> DataFrame:
    """Pairs of the occupied children of each pair of cells at the two levels.

    Source children farther than ``reach`` from the whole target cell go before the target is split.
    """
    parents = pairs.select(*sources.by, *keep, *BOX, *[F.col(c).alias(f"{c[0]}p{c[1]}") for c in ("tx", "ty", "sx", "sy")])
    near = parents.join(sources.at(s_level - STEP, "s"), [*sources.by, "spx", "spy"]).filter(box_gap() <= reach).drop(*BOX)
    return near.join(targets.at(t_level - STEP, "t"), ["tpx", "tpy"])


def members(
    pairs: DataFrame, targets: Pyramid, sources: Pyramid, t_level: int, s_level: int, comparisons: int, keep: list[str] | None = None, worth: Column | None = None
) -> DataFrame:
    """The members of small pairs of cells, side by side: source columns and ``tmx, tmy``. Sources that are not ``worth`` it go before the shuffle.

    A pair stands for a bounded number of comparisons, so what meets at a target cell is bounded by its pairs.  Few bytes
    stand for many comparisons here: the partitions are set by their number and not left to a merge by size.
    """
    t = targets.placed(t_level, "t").select("tx", "ty", F.col("mx").alias("tmx"), F.col("my").alias("tmy"))
    s = sources.placed(s_level, "s")
    with_sources = pairs.select(*sources.by, "tx", "ty", "sx", "sy", *(keep or [])).join(s, [*sources.by, "sx", "sy"])
    if worth is not None:
        with_sources = with_sources.filter(worth).drop(*BOX)
    usual = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(usual, comparisons // 100_000 + 1), comparisons // 1_000_000)
    return with_sources.repartition(tasks, "tx", "ty").join(t, ["tx", "ty"])
