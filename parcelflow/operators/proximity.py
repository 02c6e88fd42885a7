"""Distance joins between located rows: count within a radius, and nearest.

Coordinates are planar (metres). Sources are points (``x, y``) or polygons (``edges``). Both sides are written pyramids of
cells, see ``pyramid``; pairs of cells are found by equal cells, and of those that cannot be settled as a whole at most ``pair_limit``
targets and sources are compared.  Where areas overlap, a cell of targets that lies wholly inside one is at distance 0 from it, and only areas
that are ranked before the best of these are compared there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import materialize
from .pyramid import BOX, STEP, Pyramid, around, box_gap, box_span, build, cell, members, split


def target_sites(points: DataFrame) -> Pyramid | None:
    """Distinct locations of the points and the cells over them, written once: copies at one place are handled together.

    The result can be passed as ``sites`` to several joins over the same points; there is none without a located point.
    """
    located = points.filter(geo.is_located(F.col("x"), F.col("y")))
    sites = located.groupBy(F.col("x").alias("mx"), F.col("y").alias("my")).agg(F.count("*").alias("weight"))
    return build(materialize(sites, "targets"))


def _located(sources: DataFrame) -> DataFrame:
    """Replace ``x, y`` or describe ``edges`` by the columns the cells work with."""
    if "edges" not in sources.columns:
        return sources.filter(geo.is_located(F.col("x"), F.col("y"))).withColumnsRenamed({"x": "mx", "y": "my"})
    # Every vertex starts one edge, so the first ends of the edges are all vertices.
    ends = {
        f"{axis}{end}": pick(F.col(f"edges.{axis}1"))
        for axis in ("x", "y")
        for end, pick in (("min", F.array_min), ("max", F.array_max))
    }
    first = F.get("edges", F.lit(0))
    return (
        sources.filter((F.size("edges") > 0) & F.forall("edges", lambda e: geo.is_located(e["x1"], e["y1"])))
        .withColumns({**ends, "rx": first["x1"], "ry": first["y1"]})
        .withColumns({"mx": (F.col("xmin") + F.col("xmax")) / 2, "my": (F.col("ymin") + F.col("ymax")) / 2})
    )


_SHAPE = ("mx", "my", "xmin", "xmax", "ymin", "ymax", "rx", "ry", "edges")


def _shape(sources: DataFrame) -> list[str]:
    return [c for c in _SHAPE if c in sources.columns]


def _counted(sources: DataFrame, category: str, wanted: list) -> DataFrame:
    """Sources of the wanted categories; equal shapes of one category become one with a weight."""
    shaped = _located(sources.filter(F.col(category).isin(wanted)).withColumn("cat", F.col(category)))
    merged = shaped.groupBy("cat", *_shape(shaped)).agg(F.count("*").alias("weight"))
    return materialize(_sized(merged).withColumn("source", F.monotonically_increasing_id()), "sources")


_POINT = -(1 << 20)  # the size of sources without an extent


def _sized(sources: DataFrame) -> DataFrame:
    """Add ``_extent``, by which large areas are kept apart from small ones: its power of two is half their width at least."""
    if "xmin" not in sources.columns:
        return sources.withColumn("_extent", F.lit(_POINT))
    half = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / 2
    return sources.withColumn("_extent", F.coalesce(F.ceil(F.log2(half) / STEP).cast("int") * STEP, F.lit(_POINT)))


def _states(pairs: DataFrame) -> dict[str, tuple[int, int]]:
    """Pairs, and comparisons they stand for, in each state that occurs; there are at most three."""
    return {r[0]: (r[1], r[2]) for r in pairs.groupBy("state").agg(F.count("*"), F.sum("size")).collect()}


def _size() -> Column:
    return (F.col("tn") * F.col("sn")).alias("size")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _point_gap() -> Column:
    return geo.distance(F.col("tmx"), F.col("tmy"), F.col("mx"), F.col("my"))


def count_within(
    points: DataFrame,
    pois: DataFrame,
    radius: float,
    keys: dict[str, str],
    category: str = "key",
    pair_limit: int = 1 << 14,
    sites: Pyramid | None = None,
) -> DataFrame:
    """Count POIs of each key within ``radius`` of each point; every point is kept.

    ``points`` needs ``x, y``; ``pois`` needs ``x, y`` or ``edges``, and the category column. A
    polygon counts only when it lies wholly within the radius. ``keys`` maps a category value to
    its output column.
    """
    targets = target_sites(points) if sites is None else sites
    columns = [category, *(["edges"] if "edges" in pois.columns else ["x", "y"])]
    sources = targets and build(_counted(pois.select(*columns), category, list(keys)), ("cat",), targets)
    found = _counts(targets, sources, float(radius), pair_limit) if sources else []
    outputs = list(keys.values())
    if not found:
        return points.withColumns({c: F.lit(0).cast("bigint") for c in outputs})
    per_site = _union(found).groupBy("x", "y", "cat").agg(F.sum("n").alias("n"))
    per_key = [F.sum(F.when(F.col("cat") == F.lit(k), F.col("n"))).alias(out) for k, out in keys.items()]
    counts = per_site.groupBy("x", "y").agg(*per_key)
    return points.join(counts, on=["x", "y"], how="left").fillna(0, subset=outputs)


def _counts(targets: Pyramid, sources: Pyramid, radius: float, pair_limit: int) -> list[DataFrame]:
    """(x, y, cat, n) of the sources within the radius, in parts that add up."""
    level = max(targets.finest, sources.finest)
    while level + STEP <= sources.top and 2.0**level < radius:
        level += STEP
    # A counted source has its middle at most one radius away on each axis.
    xs, ys = around(F.lit(radius), level)
    reached = targets.at(level, "t").withColumn("sx", F.explode(xs)).withColumn("sy", F.explode(ys))
    pairs = reached.join(sources.at(level, "s"), ["sx", "sy"])
    found = []
    while True:
        crowded = F.col("tn") * F.col("sn") > pair_limit if level > targets.deepest else F.lit(False)
        state = F.when(box_span() <= radius, "inside").when(crowded, "split").otherwise("compare")
        pairs = materialize(
            pairs.filter(box_gap() <= radius).select("cat", "tx", "ty", "sx", "sy", "sw", *BOX, _size(), state.alias("state")),
            "pairs",
        )
        states = _states(pairs)
        if "inside" in states:
            whole = pairs.filter("state = 'inside'").groupBy("cat", "tx", "ty").agg(F.sum("sw").alias("n"))
            at = targets.placed(level, "t").select("tx", "ty", "mx", "my")
            found.append(whole.join(at, ["tx", "ty"]).select(F.col("mx").alias("x"), F.col("my").alias("y"), "cat", "n"))
        if "compare" in states:
            held = members(pairs.filter("state = 'compare'"), targets, sources, level, level, states["compare"][1])
            found.append(_within(held, radius).select(F.col("tmx").alias("x"), F.col("tmy").alias("y"), "cat", F.col("weight").alias("n")))
        if "split" not in states:
            return found
        crowd = pairs.filter("state = 'split'")
        targets, sources = _below(targets, sources, crowd, level, level)
        pairs = split(crowd, targets, sources, level, level, F.lit(radius), [])
        level -= STEP


def _below(targets: Pyramid, sources: Pyramid, crowd: DataFrame, t_level: int, s_level: int) -> tuple[Pyramid, Pyramid]:
    """Both sides, ready for the level below: as they are within the pyramid, and further down the open cells' sites only."""
    if t_level <= targets.finest:
        targets = targets.opened(crowd, t_level, "t")
    if s_level <= sources.finest:
        sources = sources.opened(crowd, s_level, "s")
    return targets, sources


def _within(members: DataFrame, radius: float) -> DataFrame:
    """Pairs whose source lies wholly within the radius."""
    if "edges" not in members.columns:
        return members.filter(_point_gap() <= radius)
    reach = geo.distance(F.col("tmx"), F.col("tmy"), F.col("e.x1"), F.col("e.y1"))
    return (
        members.select("cat", "tmx", "tmy", "source", "weight", F.explode("edges").alias("e"))
        .groupBy("cat", "tmx", "tmy", "source", "weight")
        .agg(F.max(reach).alias("reach"))
        .filter(F.col("reach") <= radius)
    )


def _tie_order(ties: str | None, ascending: bool, source_id: str) -> list[Column]:
    order = []
    if ties:
        order.append(F.col(ties).asc_nulls_last() if ascending else F.col(ties).desc_nulls_last())
    return [*order, F.col(source_id).asc()]


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per key; Spark limits each group before the shuffle, so hot keys stay small."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def _bounded(targets: Pyramid, sources: Pyramid, levels: list[int]) -> DataFrame:
    """The finest cells of the targets, each with every category and size of sources, and the distance within which all its
    targets have a source of the category: a source cell at any level that the cell's surroundings hold tells one."""
    t = targets.at(targets.finest, "t").drop("tpx", "tpy", "tw")
    near = t.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    for a in "xy":
        up = F.expr(f"shiftright(t{a}, level - ({targets.finest}))")
        near = near.withColumn(f"s{a}", F.explode(F.sequence(up - 1, up + 1)))
    held = sources.cells.filter(F.col("level").isin(levels))
    held = held.select("level", "cat", "_extent", *[F.col(c).alias(f"s{c}") for c in held.columns if c not in ("level", "cat", "_extent")])
    same = t.columns
    found = near.join(held, ["level", "sx", "sy"]).groupBy(*same, "cat").agg(
        F.min(box_span(sure=sources.extended)).alias("bound"), F.collect_set("_extent").alias("extents")
    )
    return found.withColumn("bound", F.col("bound") * F.lit(1 + 1e-9)).withColumn("_extent", F.explode("extents")).drop("extents")


def _near_cells(targets: Pyramid, sources: Pyramid, standing: Standing) -> DataFrame:
    """Pairs of finest cells that can hold a nearest pair: (cat, _extent, tx, ty, sx, sy, bound, the target's box, tn, sn), and with areas
    the best standing of those that cover the target's cell: there the distance is 0, and worse areas have lost."""
    lowest = max(targets.finest, sources.finest)
    levels = list(range(lowest, sources.top + 1, STEP))
    bounded = _bounded(targets, sources, levels)
    if sources.extended:
        covered = materialize(_covers(targets, sources.sites, standing), "covers")
        bounded = bounded.join(covered, ["cat", "tx", "ty"], "left")
        bounded = bounded.withColumn("bound", F.when(F.col("_covered"), F.lit(0.0)).otherwise(F.col("bound"))).drop("_covered")
    # A level whose cells are as wide as the bound, and as the sources: a few of them cover what is in reach.
    wide = F.greatest(F.coalesce(F.ceil(F.log2(F.col("bound")) / STEP).cast("int") * STEP, F.lit(lowest)), F.lit(lowest), F.col("_extent"))
    bounded = bounded.withColumn("level", F.least(wide, F.lit(sources.top)))
    xs, ys = around(F.col("bound") + F.when(F.col("_extent") > _POINT, F.pow(F.lit(2.0), "_extent")).otherwise(0.0), F.col("level"))
    reached = bounded.withColumn("lx", F.explode(xs)).withColumn("ly", F.explode(ys))
    fine = sources.at(sources.finest, "s").drop("spx", "spy", "sw").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    fine = fine.withColumns({f"l{a}": F.expr(f"shiftright(s{a}, level - ({sources.finest}))") for a in "xy"})
    if sources.extended:
        own = sources.placed(sources.finest, "s").groupBy("cat", "_extent", "sx", "sy")
        # Without a null among them the best of a cell stands for all its areas.
        first = F.when(F.count(standing.column) == F.count("*"), standing.best(standing.column))
        leads = own.agg(first.alias("_lead"))
        fine = fine.join(leads, ["cat", "_extent", "sx", "sy"])
    near = reached.join(fine, ["cat", "_extent", "level", "lx", "ly"]).filter(box_gap() <= F.col("bound"))
    if not sources.extended:
        return near
    return near.filter(F.col("_lead").isNull() | standing.holds(F.col("_lead"), F.col("_best"))).drop("_lead")


@dataclass(frozen=True)
class Standing:
    """The column by which areas of equal distance are ranked; what an area that covers a cell beats there need not be compared."""

    column: str
    ascending: bool
    nulls_last: bool = True

    def best(self, name: str) -> Column:
        return (F.min if self.ascending else F.max)(name)

    def holds(self, own: Column, best: Column) -> Column:
        """Not behind the best, as far as that is known."""
        ahead = own <= best if self.ascending else own >= best
        return best.isNull() | F.coalesce(ahead, F.lit(not self.nulls_last))


_COVER_EDGES = 64  # areas of more edges are compared, but cover nothing
_COVER_CELLS = 8  # least cells along the longer side of an area


def _covers(targets: Pyramid, areas: DataFrame, standing: Standing) -> DataFrame:
    """(cat, tx, ty, _best, _covered): finest cells of the targets that lie wholly inside an area, and the best standing of such areas.

    An area is cut into cells by its size, so that it makes a bounded number of them; a cell knows those of all cells around it.
    No edge touches a cell inside, so all its places have the parity of its middle. Boxes are grown beyond rounding.
    """
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.greatest(F.floor(F.log2(wide / _COVER_CELLS) / STEP).cast("int") * STEP, F.lit(targets.finest))
    cut = areas.select("cat", "edges", "xmin", "xmax", "ymin", "ymax", F.col(standing.column).alias("_standing"))
    cut = cut.filter((wide > 0) & (F.size("edges") <= _COVER_EDGES)).withColumn("level", F.least(level, F.lit(targets.top)))
    cut = cut.withColumn("side", F.pow(F.lit(2.0), F.col("level")))
    for a in "xy":
        low, high = cell(f"{a}min", F.col("level")) + 1, cell(f"{a}max", F.col("level")) - 1
        cut = cut.withColumns({f"{a}low": low, f"{a}high": high}).filter(F.col(f"{a}low") <= F.col(f"{a}high"))
        cut = cut.withColumn(f"c{a}", F.explode(F.sequence(f"{a}low", f"{a}high")))
    rim = F.lit(1e-9) * F.greatest(F.lit(1.0), *[F.abs(F.col(f"{a}{end}")) for a in "xy" for end in ("min", "max")])
    cut = cut.withColumns({f"{a}{n}": (F.col(f"c{a}") + n - 1) * F.col("side") + (2 * n - 3) * rim for a in "xy" for n in (1, 2)})
    middle = [(F.col(f"c{a}") + 0.5) * F.col("side") for a in "xy"]

    def clear(e: Column) -> Column:
        beside = [
            (F.greatest(e[f"{a}1"], e[f"{a}2"]) < F.col(f"{a}1")) | (F.least(e[f"{a}1"], e[f"{a}2"]) > F.col(f"{a}2")) for a in "xy"
        ]
        sides = [(e["x2"] - e["x1"]) * (F.col(y) - e["y1"]) - (e["y2"] - e["y1"]) * (F.col(x) - e["x1"]) for x in ("x1", "x2") for y in ("y1", "y2")]
        return beside[0] | beside[1] | (F.least(*sides) > 0) | (F.greatest(*sides) < 0)

    crossings = F.aggregate("edges", F.lit(0), lambda n, e: n + geo.edge_crossing(middle[0], middle[1], e))
    cut = cut.filter(F.forall("edges", clear) & (crossings % 2 == 1))
    inside = cut.groupBy("cat", "level", "cx", "cy").agg(standing.best("_standing").alias("_best"))
    levels = F.sequence(F.lit(targets.finest), F.lit(targets.top), F.lit(STEP))
    own = targets.at(targets.finest, "t").select("tx", "ty", F.explode(levels).alias("level"))
    own = own.withColumns({f"c{a}": F.expr(f"shiftright(t{a}, level - ({targets.finest}))") for a in "xy"})
    return own.join(inside, ["level", "cx", "cy"]).groupBy("cat", "tx", "ty").agg(standing.best("_best").alias("_best"), F.lit(True).alias("_covered"))


def _nearest_candidates(points: Pyramid | None, found: DataFrame, payload: list[str], pair_limit: int, standing: Standing) -> DataFrame | None:
    """Pairs of target sites and sources that include every nearest pair, with their distance."""
    targets, sources = points, points and build(found, ("cat", "_extent"), points)
    if sources is None:
        return None
    polygons = sources.extended
    shape = _shape(found) if polygons else ["mx", "my"]
    kept = ["bound", "_best"] if polygons else ["bound"]
    candidates = []
    t_level, s_level = targets.finest, sources.finest
    pairs = _near_cells(targets, sources, standing)
    while True:
        # No target of this cell can be farther from its nearest source than `bound`.
        own = Window.partitionBy("tx", "ty", "cat")
        bound = F.least(F.min(box_span(sure=polygons)).over(own) * F.lit(1 + 1e-9), F.col("bound"))
        crowded = F.col("tn") * F.col("sn") > pair_limit if t_level > targets.deepest else F.lit(False)
        state = F.when(crowded, "split").otherwise("compare")
        pairs = materialize(
            pairs.withColumn("bound", bound)
            .filter(box_gap() <= F.col("bound"))
            .select("cat", "_extent", "tx", "ty", "sx", "sy", *kept, *BOX, _size(), state.alias("state")),
            "pairs",
        )
        states = _states(pairs)
        if "compare" in states:
            worth = (_area_gap() <= F.col("bound")) & standing.holds(F.col(standing.column), F.col("_best")) if polygons else None
            meet = pairs.filter("state = 'compare'")
            held = members(meet, targets, sources, t_level, s_level, states["compare"][1], [*kept, *(BOX if polygons else [])], worth)
            candidates.append(held.select("cat", "tmx", "tmy", "bound", *payload, *shape))
        if "split" not in states:
            break
        crowd = pairs.filter("state = 'split'")
        targets, sources = _below(targets, sources, crowd, t_level, s_level)
        pairs = split(crowd, targets, sources, t_level, s_level, F.col("bound"), kept)
        t_level, s_level = t_level - STEP, s_level - STEP
    candidates = _union(candidates)
    if not polygons:
        return candidates.withColumn("distance", _point_gap()).filter(F.col("distance") <= F.col("bound"))
    by = ["cat", "tmx", "tmy", *payload]
    near = candidates.filter(_point_box_gap() <= F.col("bound"))
    return _polygon_distances(near.select(*by, F.explode("edges").alias("e")), by)


def _area_gap() -> Column:
    """Least distance between a target cell's box and the box of an area."""
    dx = F.greatest(F.lit(0.0), F.col("xmin") - F.col("tx2"), F.col("tx1") - F.col("xmax"))
    dy = F.greatest(F.lit(0.0), F.col("ymin") - F.col("ty2"), F.col("ty1") - F.col("ymax"))
    return F.sqrt(dx * dx + dy * dy)


def _point_box_gap() -> Column:
    dx = F.greatest(F.lit(0.0), F.col("xmin") - F.col("tmx"), F.col("tmx") - F.col("xmax"))
    dy = F.greatest(F.lit(0.0), F.col("ymin") - F.col("tmy"), F.col("tmy") - F.col("ymax"))
    return F.sqrt(dx * dx + dy * dy)


def _polygon_distances(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distance from ``(tmx, tmy)`` to the polygon whose edges are the rows: 0 inside."""
    x, y, e = F.col("tmx"), F.col("tmy"), F.col("e")
    return (
        edges.groupBy(*by)
        .agg(F.min(geo.segment_distance(x, y, e)).alias("gap"), F.sum(geo.edge_crossing(x, y, e)).alias("crossings"))
        .withColumn("distance", F.when(F.col("crossings") % 2 == 1, F.lit(0.0)).otherwise(F.col("gap")))
        .drop("gap", "crossings")
    )


def nearest_sites(
    sites: Pyramid | None,
    sources: DataFrame,
    source_id: str,
    ties: str | None = None,
    ascending: bool = True,
    columns: list[str] | None = None,
    category: str | None = None,
    pair_limit: int = 1 << 13,
) -> DataFrame | None:
    """The nearest source of each site, per category: ``x, y, cat``, the columns and ``distance``.

    All categories share the same rounds. Without any source there is no result.
    """
    columns = columns or [c for c in sources.columns if c not in ("x", "y", "edges")]
    order = _tie_order(ties, ascending, source_id)
    payload = list(dict.fromkeys([source_id, *([ties] if ties else []), *columns]))
    shape = ["edges"] if "edges" in sources.columns else ["x", "y"]
    cat = F.col(category) if category else F.lit(0)
    shaped = _located(sources.select(*payload, *shape, cat.alias("cat")))
    # Of several sources of a category at one place only the best can win.
    shaped = _first(shaped, ["cat", *_shape(shaped)], order).withColumn("weight", F.lit(1))
    # Polygons that agree in all columns are still different shapes.
    numbered = materialize(_sized(shaped).withColumn("_shape", F.monotonically_increasing_id()), "sources")
    standing = Standing(ties, ascending, nulls_last=True) if ties else Standing(source_id, True, nulls_last=False)
    candidates = _nearest_candidates(sites, numbered, [*payload, "_shape"], pair_limit, standing)
    if candidates is None:
        return None
    best = _first(candidates, ["tmx", "tmy", "cat"], [F.col("distance"), *order])
    return best.select(F.col("tmx").alias("x"), F.col("tmy").alias("y"), "cat", *columns, "distance")


def nearest(
    points: DataFrame,
    sources: DataFrame,
    source_id: str,
    ties: str | None = None,
    ascending: bool = True,
    columns: list[str] | None = None,
    pair_limit: int = 1 << 13,
    sites: Pyramid | None = None,
) -> DataFrame:
    """The nearest source of each point: ``columns`` of the source and ``distance``.

    Equal distances are settled by ``ties`` (nulls last), then by ``source_id``. Points are all
    kept; without any source the added columns are null.
    """
    columns = columns or [c for c in sources.columns if c not in ("x", "y", "edges")]
    sites = target_sites(points) if sites is None else sites
    best = nearest_sites(sites, sources, source_id, ties, ascending, columns, pair_limit=pair_limit)
    if best is None:
        blank = {c: F.lit(None).cast(sources.schema[c].dataType) for c in columns}
        return points.withColumns({**blank, "distance": F.lit(None).cast("double")})
    return points.join(best.drop("cat"), on=["x", "y"], how="left")


def nearest_by_type(
    points: DataFrame,
    pois: DataFrame,
    types: dict[str, str],
    category: str = "value",
    pair_limit: int = 1 << 13,
    sites: Pyramid | None = None,
) -> DataFrame:
    """Distance to the nearest POI of each type, one column per type found in the data.

    ``types`` maps a category value to its output column; types without any POI are skipped.
    """
    targets = target_sites(points) if sites is None else sites
    columns = [category, *(["edges"] if "edges" in pois.columns else ["x", "y"])]
    sources = _counted(pois.select(*columns), category, list(types))
    present = {r[0] for r in sources.select("cat").distinct().collect()}  # at most len(types) values
    # Of areas at distance 0 any will do: the first by number.
    candidates = _nearest_candidates(targets, sources, ["source"] if "edges" in columns else [], pair_limit, Standing("source", True))
    if candidates is None:
        return points
    closest = candidates.groupBy("tmx", "tmy", "cat").agg(F.min("distance").alias("distance"))
    per_type = [
        F.min(F.when(F.col("cat") == F.lit(t), F.col("distance"))).alias(out) for t, out in types.items() if t in present
    ]
    best = closest.groupBy(F.col("tmx").alias("x"), F.col("tmy").alias("y")).agg(*per_type)
    return points.join(best, on=["x", "y"], how="left")
