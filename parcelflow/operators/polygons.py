"""Point-in-polygon join and area density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import materialize


_ROW = "_polygon_row"


def area_density(polygons: DataFrame, variables: list[str]) -> DataFrame:
    """Divide each variable by the polygon's area, in the units of its own coordinates.

    Polygons bring one ``ring``, or ``rings`` with parts and holes.
    """
    area = geo.rings_area(F.col("rings")) if "rings" in polygons.columns else geo.ring_area(geo.ring_edges(F.col("ring")))
    return polygons.withColumn("area", area).withColumns({v: F.col(v) / F.col("area") for v in variables})


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("bigint")


def _levels(edges_per_cell: int) -> dict[str, Column]:
    """The levels of a polygon's largest and finest cells (sides are powers of two).

    The largest cell is at least as wide as the polygon's box. The finest holds about ``edges_per_cell`` edges if the outline runs
    through it once, and is not narrower than a quarter of the mean edge, so that all edges together touch cells in proportion to their number.
    """
    edges = F.col("edges")
    span = lambda c: F.array_max(F.transform(edges, lambda e: e[c])) - F.array_min(F.transform(edges, lambda e: e[c]))
    extent = F.greatest(span("x1"), span("y1"), F.lit(1e-9))
    outline = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + geo.distance(e["x1"], e["y1"], e["x2"], e["y2"]))
    width = F.greatest(extent * edges_per_cell / F.size(edges), outline / F.size(edges) / 4, extent / 2**20)
    level = lambda size: F.ceil(F.log2(size)).cast("int")
    return {"top": level(extent), "fine": F.least(level(extent), level(width))}


def _whole(shapes: DataFrame) -> DataFrame:
    """The same rows as ``_cells`` makes, for polygons that are not split: up to four cells, each with all edges."""
    at = lambda pick, c: _cell(pick(F.transform("edges", lambda e: e[c])), F.col("top"))
    columns = {name: F.explode(F.sequence(at(F.array_min, c), at(F.array_max, c))) for name, c in (("cx", "x1"), ("cy", "y1"))}
    for name, cells in columns.items():
        shapes = shapes.withColumn(name, cells)
    return shapes.select(_ROW, F.col("top").alias("level"), "cx", "cy", F.lit(False).alias("odd"), "edges")


def _touched(edges: DataFrame) -> DataFrame:
    """One row per edge and row of finest cells, with the first and last column that it can touch there.

    Columns are taken a little too far on both sides: an edge that is not listed for a cell runs surely left or right of it.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    width = F.pow(F.lit(2.0), F.col("fine"))
    per_row = edges.withColumn("cy", F.explode(F.sequence(_cell(low, F.col("fine")), _cell(high, F.col("fine")))))

    def at(y: Column, flat: Column) -> Column:
        x = x1 + (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0))
        return F.when(y1 == y2, flat).otherwise(F.greatest(F.least(x1, x2), F.least(F.greatest(x1, x2), x)))

    one = at(F.greatest(low, F.col("cy") * width), x1)
    two = at(F.least(high, (F.col("cy") + 1) * width), x2)
    slack = width * 1e-9 + (F.abs(x1) + F.abs(x2)) * 1e-12
    return per_row.withColumns(
        {"first": _cell(F.least(one, two) - slack, F.col("fine")), "last": _cell(F.greatest(one, two) + slack, F.col("fine"))}
    )


def _cells(shapes: DataFrame) -> DataFrame:
    """The quad-trees: ``level, cx, cy``, polygon row, ``odd`` and, in cells with a boundary, the ``edges`` that can touch the cell.

    Cells without edges are kept where they lie inside, as large as they come. ``odd`` tells for the lower left finest cell within a cell whether
    an odd number of the edges that pass right of it cross the lower side's height.
    """
    edges = shapes.select(_ROW, "top", "fine", F.explode("edges").alias("e")).select(_ROW, "top", "fine", "e.*")
    touched = materialize(_touched(edges), "touched")
    boundary = touched.withColumn("cx", F.explode(F.sequence("first", "last")))
    bordered = boundary.groupBy(_ROW, "top", "fine", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    bordered = materialize(bordered, "bordered")

    climbed = bordered.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("top") - F.col("fine"))))
    shifted = lambda c, by: F.call_function("shiftright", F.col(c), by)
    mixed = climbed.select(_ROW, "fine", "up", shifted("cx", F.col("up")).alias("cx"), shifted("cy", F.col("up")).alias("cy")).distinct()
    mixed = materialize(mixed, "mixed")
    quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    children = mixed.filter("up > 0").withColumn("q", quarters)
    children = children.select(_ROW, "fine", (F.col("up") - 1).alias("up"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"))
    empty = children.join(mixed, [_ROW, "fine", "up", "cx", "cy"], "left_anti")

    # Every cell asks its lower left finest cell; the edges in that row answer by whole columns, never by rounded places.
    scaled = lambda c: F.call_function("shiftleft", F.col(c), F.col("up")).alias(c)
    asked = bordered.select(_ROW, "fine", F.lit(0).alias("up"), "cx", "cy").unionByName(empty.select(_ROW, "fine", "up", scaled("cx"), scaled("cy")))
    floor = F.col("cy") * F.pow(F.lit(2.0), F.col("fine"))
    crossing = touched.filter((F.col("y1") > floor) != (F.col("y2") > floor))
    events = asked.withColumn("right", F.lit(0)).unionByName(
        crossing.select(_ROW, "fine", F.lit(None).cast("int").alias("up"), F.col("first").alias("cx"), "cy", F.lit(1).alias("right"))
    )
    beyond = Window.partitionBy(_ROW, "cy").orderBy(F.desc("cx"), "right").rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumn("odd", F.sum("right").over(beyond) % 2 == 1).filter("right = 0").drop("right")
    told = told.join(bordered.select(_ROW, F.lit(0).alias("up"), "cx", "cy", "edges"), [_ROW, "up", "cx", "cy"], "left")
    return told.filter("odd or edges is not null").select(
        _ROW, (F.col("fine") + F.col("up")).alias("level"), shifted("cx", F.col("up")).alias("cx"), shifted("cy", F.col("up")).alias("cy"), "odd", "edges"
    )


def _inside(x: Column, y: Column) -> Column:
    """Whether the point lies inside or on the boundary, from the edges that can touch its cell.

    The ray to the right meets the edges of the cell, and others right of it. At the cell's lower side ``odd`` tells of those; going up to the
    point, that changes at every vertex right of the cell between an edge of the cell and another one. A vertex between two edges of the cell counts twice.
    """
    width = F.pow(F.lit(2.0), F.col("level"))
    right, floor = (F.col("cx") + 1) * width, F.col("cy") * width

    def passed(vx: Column, vy: Column) -> Column:
        return ((vx > right) & (vy > floor) & (vy <= y)).cast("int")

    def flips(e: Column) -> Column:
        return geo.edge_crossing(x, y, e) + passed(e["x1"], e["y1"]) + passed(e["x2"], e["y2"])

    near = F.col("edges")
    total = F.aggregate(near, F.col("odd").cast("int"), lambda acc, e: acc + flips(e))
    return near.isNull() | (total % 2 == 1) | F.exists(near, lambda e: geo.on_edge(x, y, e))


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    columns: list[str],
    polygon_id: str,
    dedupe: str | None = None,
    digits: int | None = None,
    edges_per_cell: int = 16,
) -> DataFrame:
    """Attach the columns of the polygons that hold each point (boundary included).

    Points (``x, y``) without a polygon are kept with nulls; a point on a shared edge gives one
    row per polygon, or only the polygon with the smallest id when ``dedupe="first"``. ``digits``
    compares coordinates rounded to so many decimals: a reprojected edge is only exact up to that.
    Polygons bring one ``ring``, or ``rings`` with parts and holes; a hole's boundary still belongs to the polygon.

    Each polygon is cut by a quad-tree into cells wholly inside, where a point needs no test, and cells with some of the boundary,
    where only the edges that can touch the cell are tested. Polygons of up to ``edges_per_cell`` edges are not split.
    A point is looked up once per level in use. The answer is that of testing all edges, whatever ``edges_per_cell`` is.
    """

    if dedupe not in (None, "first"):
        raise ValueError("dedupe must be None or 'first'")

    def snapped(c):
        return c if digits is None else F.round(c, digits)

    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    vertex = lambda p: F.struct(snapped(p["x"]).alias("x"), snapped(p["y"]).alias("y"))
    snapped_rings = F.transform(rings, lambda ring: F.transform(ring, vertex))
    keep = list(dict.fromkeys([polygon_id, *columns]))
    # A number per row, written: two rows with equal id and values are still two polygons.
    known = F.filter(geo.rings_edges(snapped_rings), lambda e: (e["x1"] + e["y1"] + e["x2"] + e["y2"]).isNotNull())
    shapes = polygons.select(F.monotonically_increasing_id().alias(_ROW), *keep, known.alias("edges")).filter(F.size("edges") > 0)
    shapes = materialize(shapes.withColumns(_levels(edges_per_cell)), "polygons")
    outlines = shapes.select(_ROW, "top", "fine", "edges")
    split = outlines.filter(F.size("edges") > edges_per_cell)
    filed = _whole(outlines.filter(F.size("edges") <= edges_per_cell))
    if not split.isEmpty():
        filed = materialize(filed.unionByName(_cells(split)), "cells")
    levels = sorted(r[0] for r in filed.select("level").distinct().collect())  # powers of two: few
    if not levels:
        blank = {c: F.lit(None).cast(polygons.schema[c].dataType) for c in columns}
        return points.withColumns(blank)

    sites = points.select("x", "y").filter(geo.is_located(F.col("x"), F.col("y"))).distinct()
    looked_up = sites.withColumns({"px": snapped(F.col("x")), "py": snapped(F.col("y"))})
    looked_up = looked_up.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    looked_up = looked_up.withColumns({"cx": _cell(F.col("px"), F.col("level")), "cy": _cell(F.col("py"), F.col("level"))})
    held = looked_up.join(filed, on=["level", "cx", "cy"]).filter(_inside(F.col("px"), F.col("py"))).select("x", "y", _ROW)
    held = held.join(shapes.select(_ROW, *keep), _ROW).select("x", "y", *keep)
    if dedupe == "first":
        held = held.groupBy("x", "y").agg(F.min_by(F.struct(*keep), F.col(polygon_id)).alias("p")).select("x", "y", "p.*")
    return points.join(held.select("x", "y", *columns), on=["x", "y"], how="left")
