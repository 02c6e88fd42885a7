"""The geospatial feature table: every source joined to the properties in one lineage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.polygons import area_density, points_in_polygons
from ..operators.proximity import count_within, nearest_by_type, nearest_sites, target_sites
from ..operators.pyramid import Pyramid
from ..operators.raster import Grid, merge_georeferenced, raster_lookup
from ..operators.relational import align, first_per_key
from ..scratch import materialize
from . import fixed_values as V


@dataclass(frozen=True)
class FeatureSources:
    """Tables around the properties.

    ``pois``: key, value, latitude, longitude. ``raster``: row, col, value on a degree grid from
    ``(raster_lon, raster_lat)`` with ``raster_step``, or a list of ``(cells, Grid)`` tiles, which are merged on that grid. ``tracts``: id, variables, Mercator ``ring`` or ``rings``.
    ``cities``: name, population, latitude, longitude. POIs and cities may be areas instead: with a column ``rings``
    (parts and holes, x = longitude, y = latitude; null for a point) distances are 0 inside, and only POIs wholly
    within the radius count.
    """

    pois: DataFrame
    raster: DataFrame | list[tuple[DataFrame, Grid]]
    tracts: DataFrame
    cities: DataFrame
    raster_lon: float
    raster_lat: float
    raster_step: float
    tract_id: str = "tract"
    variables: list = field(default_factory=lambda: list(V.CENSUS_VARIABLES))
    keys: dict = field(default_factory=lambda: {k: k for k in V.POI_TAGS})
    types: dict = field(default_factory=lambda: {v: v for values in V.POI_TAGS.values() for v in values})
    radius: float = V.POI_RADIUS_METRES
    big_city: float = V.BIG_CITY_POPULATION
    drop: list = field(default_factory=lambda: list(V.REDUNDANT_FEATURES))


def property_points(df: DataFrame, key: str = "parcelid") -> DataFrame:
    """One row per property in degrees, from micro-degree columns ``latitude`` and ``longitude``."""
    one_each = first_per_key(df.select(key, "latitude", "longitude"), [key], ["latitude", "longitude"])
    return one_each.withColumns({c: geo.from_micro(F.col(c)) for c in ("latitude", "longitude")})


def projected(df: DataFrame) -> DataFrame:
    """Add planar metres ``x, y`` for ``latitude, longitude`` in degrees."""
    x, y = geo.albers(F.col("latitude"), F.col("longitude"))
    return df.withColumns({"x": x, "y": y})


def _placed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with planar ``x, y``, or with planar ``edges`` where the table has areas; a point is an edge of no length."""
    if "rings" not in df.columns:
        return projected(df).select(*columns, "x", "y")

    def vertex(p):
        x, y = geo.albers(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    point = F.array(F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))))
    rings = F.coalesce("rings", point) if "longitude" in df.columns else F.col("rings")
    planar = F.transform(rings, lambda ring: F.transform(ring, vertex))
    return df.withColumn("_planar", planar).select(*columns, geo.rings_edges(F.col("_planar")).alias("edges"))


def _tract_degrees(tracts: DataFrame) -> DataFrame:
    if "rings" in tracts.columns:
        return tracts.withColumn("rings", F.transform("rings", geo.mercator_ring_to_degrees))
    return tracts.withColumn("ring", geo.mercator_ring_to_degrees(F.col("ring")))


def city_features(
    points: DataFrame,
    cities: DataFrame,
    big_city: float,
    key: str = "parcelid",
    sites: Pyramid | None = None,
) -> DataFrame:
    """Name, population and distance of the nearest city and of the nearest big city.

    Both searches share their rounds: a big city takes part twice, once in each category.
    """
    sites = target_sites(points) if sites is None else sites
    kinds = {"all": "_close_city", "big": "_close_big_city"}
    roles = F.when(F.col("population") > big_city, F.array(F.lit("all"), F.lit("big"))).otherwise(F.array(F.lit("all")))
    columns = ["name", "population"]
    best = nearest_sites(
        sites, cities.withColumn("kind", F.explode(roles)), "name", "population", False, columns, category="kind"
    )
    found = [*columns, "distance"]
    outputs = {f"{c}{suffix}": (kind, c) for kind, suffix in kinds.items() for c in found}
    if best is None:
        types = {**{c: cities.schema[c].dataType for c in columns}, "distance": "double"}
        return points.select(key, *[F.lit(None).cast(types[c]).alias(out) for out, (_, c) in outputs.items()])
    row = F.struct(*found)
    sides = [F.max(F.when(F.col("cat") == kind, row)).alias(kind) for kind in kinds]  # one row per category
    per_site = best.groupBy("x", "y").agg(*sides)
    picked = per_site.select("x", "y", *[F.col(kind)[c].alias(out) for out, (kind, c) in outputs.items()])
    return points.join(picked, on=["x", "y"], how="left").select(key, *outputs)


def geo_features(df: DataFrame, sources: FeatureSources, key: str = "parcelid") -> DataFrame:
    """Elevation, POI counts, census densities, city features and nearest POIs per property."""
    points = materialize(projected(property_points(df, key)), "properties")
    degrees = points.select(key, F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    metres = points.select(key, "x", "y")
    pois = materialize(_placed(sources.pois, ["key", "value"]), "pois")
    cities = _placed(sources.cities, ["name", "population"])
    tracts = _tract_degrees(area_density(sources.tracts, sources.variables))

    raster = sources.raster
    if isinstance(raster, list):
        raster = merge_georeferenced(raster, Grid(sources.raster_lon, sources.raster_lat, sources.raster_step, sources.raster_step))
    elevation = raster_lookup(degrees, raster, sources.raster_lon, sources.raster_lat, sources.raster_step)
    sites = target_sites(metres)
    counts = count_within(metres, pois, sources.radius, sources.keys, sites=sites)
    census = points_in_polygons(degrees, tracts, sources.variables, sources.tract_id, dedupe="first", digits=9)
    near_cities = city_features(metres, cities, sources.big_city, key, sites)
    near_pois = nearest_by_type(metres, pois, sources.types, sites=sites)
    frames = [f.drop("x", "y") for f in (elevation, counts, census, near_cities, near_pois)]
    return align(frames, key).drop(*sources.drop)
