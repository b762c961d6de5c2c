"""Spatial joins (E1-E5): nearest neighbour and point-to-polyline distance.

Two physical forms, same answers (ties -> smallest ``ord``, i.e. first in file order):

* **unrolled form** - the dimension has a checked size bound (``UNROLL_LIMIT`` points):
  its rows are read once and every listing evaluates
  ``least(struct(dist_1, ord_1, name_1), ..., struct(dist_m, ord_m, name_m))`` with the
  coordinates as literals. One projection, no shuffle, no row explosion, and it stays in
  whole-stage codegen (a ``transform`` over a broadcast array is interpreted and was 9x
  slower at sf0.1).
* **index form** - dimensions of any size (``near_index``): a broadcast box tree while the
  count is proven small, tiles cut by range partitioning beyond. Candidates come from the
  index; their distances are computed by the same Column formula as in the other form, so
  both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import (EARTH_RADIUS_KM, haversine_km, point_segment_distance,
                             project_utm37, project_webmercator)
from ..session import bounded_row_count
from .near_index import ENDS, attach_nearest

# A dimension this small is inlined into the expression (checked with a bounded count).
UNROLL_LIMIT = 32
# Polylines are inlined up to this many segments.
SEGMENT_LIMIT = 512


def _small_points(dim: DataFrame, lat: str, lon: str, ord_col: str, name_col: str | None,
                  limit: int = UNROLL_LIMIT):
    """Rows of a dimension whose size is proven <= limit, else None."""
    d = dim.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if bounded_row_count(d, limit) is None:
        return None
    name = F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")
    return d.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
                    F.col(ord_col).cast("long").alias("ord"), name.alias("name")).collect()


def _nearest_unrolled(lat: Column, lon: Column, pts) -> Column:
    """Raw winner struct(dist, ord, name) over literal points (``dist`` is NULL when the
    listing has no coordinates). Measured at sf0.1: plain terms under one ``least`` run
    5-10x faster than variants that wrap the ``least`` in a ``when`` or share a
    subexpression between terms, so the NULL guard is applied by ``_finish`` in the next
    projection."""
    if not pts:
        return F.lit(None).cast("struct<dist:double,ord:bigint,name:string>")
    terms = [F.struct(haversine_km(lat, lon, p["lat"], p["lon"]).alias("dist"),
                      F.lit(p["ord"]).cast("long").alias("ord"),
                      F.lit(p["name"]).cast("string").alias("name")) for p in pts]
    return terms[0] if len(terms) == 1 else F.least(*terms)


def _finish(raw: Column) -> Column:
    """NULL instead of a winner without distance (no coordinates / no points)."""
    return F.when(raw["dist"].isNotNull(), raw)


def nearest_one(left: DataFrame, dim: DataFrame, out: str = "_nn", lat: str = "latitude",
                lon: str = "longitude", dim_lat: str = "lat", dim_lon: str = "lon",
                dim_ord: str = "ord", dim_name: str | None = "name", key: str = "listing_id",
                force: str | None = None) -> DataFrame:
    """Adds struct column ``out`` = (dist km unrounded, ord, name) of the nearest
    dimension point; NULL when the listing has no coordinates or the dimension is empty."""
    pts = None if force == "grid" else _small_points(dim, dim_lat, dim_lon, dim_ord, dim_name)
    if pts is not None:
        raw = left.withColumn("_nnraw", _nearest_unrolled(F.col(lat), F.col(lon), pts))
        return raw.withColumn(out, _finish(F.col("_nnraw"))).drop("_nnraw")
    return _nearest_indexed(left, dim, out, lat, lon, dim_lat, dim_lon, dim_ord, dim_name, key)


def nearest_per_category(left: DataFrame, dim: DataFrame, category: str,
                         categories: list[str], out_names: dict[str, str],
                         lat: str = "latitude", lon: str = "longitude",
                         dim_lat: str = "latitude", dim_lon: str = "longitude",
                         dim_ord: str = "poi_id", key: str = "listing_id",
                         force: str | None = None) -> DataFrame:
    """Unrounded km to the nearest point of every category, one column each; NULL if
    the category is empty or the listing has no coordinates. Small categories are inlined, each
    other one is an index of its own."""
    out = left
    for c in categories:
        d = dim.where(F.col(category) == c)
        pts = None if force == "grid" else _small_points(d, dim_lat, dim_lon, dim_ord, None)
        if pts is not None:
            raw = out.withColumn("_nnraw", _nearest_unrolled(F.col(lat), F.col(lon), pts))
            out = raw.withColumn(out_names[c], _finish(F.col("_nnraw"))["dist"]).drop("_nnraw")
        else:
            found = _nearest_indexed(out, d, "_nnraw", lat, lon, dim_lat, dim_lon, dim_ord, None, key)
            out = found.withColumn(out_names[c], F.col("_nnraw")["dist"]).drop("_nnraw")
    return out


# ------------------------------------------------------------------ index form
def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Unit vector: straight distances between these grow with great-circle distances, across
    180 degrees and the poles too."""
    phi, lam = F.radians(lat.cast("double")), F.radians(lon.cast("double"))
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def _nearest_indexed(left: DataFrame, dim: DataFrame, out: str, lat: str, lon: str, dim_lat: str,
                     dim_lon: str, dim_ord: str, dim_name: str | None, key: str) -> DataFrame:
    """Adds ``out``, the winner struct(dist, ord, name), by ``near_index``. Points at the same place
    are one item, the one of least ``ord``; among the equally near the least (dist, ord) wins."""
    name = F.col(dim_name).cast("string") if dim_name else F.lit(None).cast("string")
    points = dim.where(F.col(dim_lat).isNotNull() & F.col(dim_lon).isNotNull()).groupBy(
        F.col(dim_lat).cast("double").alias("_plat"), F.col(dim_lon).cast("double").alias("_plon")).agg(
        F.min(F.struct(F.col(dim_ord).cast("long").alias("ord"), name.alias("name"))).alias("_first"))
    at = _on_sphere(F.col("_plat"), F.col("_plon"))
    items = points.select(
        *[c.alias(n) for c, n in zip([*at, *at], ENDS, strict=True)],
        F.struct(F.col("_plat").alias("lat"), F.col("_plon").alias("lon"), "_first.ord", "_first.name").alias("item"))
    near = attach_nearest(left, _on_sphere(F.col(lat), F.col(lon)), items, "_near", key)
    exact = F.transform("_near", lambda p: F.struct(
        haversine_km(F.col(lat), F.col(lon), p["lat"], p["lon"]).alias("dist"),
        p["ord"].alias("ord"), p["name"].alias("name")))
    return near.withColumn(out, F.array_min(exact)).drop("_near")


# ------------------------------------------------------------ polyline distance
def _distance_indexed(left: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    """Adds ``_rawd``, the least distance to any segment, by ``near_index``."""
    zero = F.lit(0.0)
    items = flat.distinct().select(
        F.col("x1"), F.col("y1"), zero.alias("z1"), F.col("x2"), F.col("y2"), zero.alias("z2"),
        F.struct("x1", "y1", "x2", "y2").alias("item"))
    near = attach_nearest(left, [F.col("_px"), F.col("_py"), zero], items, "_near", key, ties=False)
    return near.withColumn("_rawd", F.array_min(F.transform("_near", lambda s: point_segment_distance(
        F.col("_px"), F.col("_py"), s["x1"], s["y1"], s["x2"], s["y2"])))).drop("_near")


def point_to_polyline(left: DataFrame, segments: DataFrame, out: str, crs: str = "utm37",
                      lat: str = "latitude", lon: str = "longitude",
                      first_feature_only: bool = False, key: str = "listing_id") -> DataFrame:
    """E4 (UTM 37N) / E5 (Web Mercator, the feature with the smallest id only): unrounded km
    from the point to the nearest segment. A short polyline's vertices are projected once and
    inlined as literals; a longer one is indexed, so any length works. NULL coordinates give NULL; no segments is an error."""
    seg = segments
    if first_feature_only:
        first = segments.agg(F.min("feature_id")).first()[0]
        seg = segments.where(F.col("feature_id").eqNullSafe(F.lit(first)))
    count = bounded_row_count(seg, SEGMENT_LIMIT)
    if count == 0:
        raise ValueError("the polyline has no segments")
    proj = project_utm37 if crs == "utm37" else project_webmercator
    x1, y1 = proj(F.col("lat1"), F.col("lon1"))
    x2, y2 = proj(F.col("lat2"), F.col("lon2"))
    flat = seg.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    px, py = proj(F.col(lat), F.col(lon))
    tmp = left.withColumns({"_px": px, "_py": py})
    if count is None:
        tmp = _distance_indexed(tmp, flat, key)
    else:
        terms = [point_segment_distance(F.col("_px"), F.col("_py"), F.lit(s["x1"]), F.lit(s["y1"]),
                                        F.lit(s["x2"]), F.lit(s["y2"])) for s in flat.collect()]
        tmp = tmp.withColumn("_rawd", terms[0] if len(terms) == 1 else F.least(*terms))
    return (tmp
            .withColumn(out, F.when(F.col("_rawd").isNotNull() & F.col(lat).isNotNull()
                                    & F.col(lon).isNotNull(), F.col("_rawd") / 1000.0))
            .drop("_px", "_py", "_rawd"))
