"""Geo-enrichment stage: nearest station, centre / ring-road distances, POI distances,
provenance - one lazy plan over the listings with broadcast (size-checked) dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import center_distance_km, walk_minutes
from ..functions.numeric import metro_near_flag, rint_dp
from ..operators.projection import address_fill, provenance
from ..operators.spatial import nearest_one, nearest_per_category, point_to_polyline
from ..sources.dims import stations_dim

# POI categories and their output columns.
POI_TYPES = ["school", "kindergarten", "clinic", "mall"]
POI_OUT = {c: f"distance_to_{c}_km" for c in POI_TYPES}


def enrich_listings(listings: DataFrame, stations_raw: DataFrame, poi: DataFrame,
                    ring_segments: DataFrame, nn_form: str | None = None,
                    ring_crs: str = "utm37", gazetteer: DataFrame | None = None) -> DataFrame:
    """``gazetteer`` (latitude, longitude, address) fills empty addresses by coordinates (B13);
    without one they stay empty."""
    df = listings
    for c in ("address", "metro"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "metro_walk_min" not in df.columns:
        df = df.withColumn("metro_walk_min", F.lit(None).cast("int"))
    has_geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    st = stations_dim(stations_raw, extra=["station_ord"])
    df = nearest_one(df, st, out="_st", dim_ord="station_ord", dim_name="metro", force=nn_form)
    df = df.withColumns(provenance(has_geo, F.col("address"), F.col("metro")))
    if gazetteer is not None:
        df = address_fill(df, gazetteer)
    df = df.withColumns({
        "metro": F.when(has_geo, F.col("_st")["name"]).otherwise(F.col("metro")),
        "metro_walk_min": F.when(has_geo, walk_minutes(F.col("_st")["dist"]))
                           .otherwise(F.col("metro_walk_min")),
        "metro_distance_km": F.when(has_geo, rint_dp(F.col("_st")["dist"], 2)),
        "distance_to_center_km": F.when(has_geo, rint_dp(
            center_distance_km("latitude", "longitude"), 2)),
    }).drop("_st")
    df = point_to_polyline(df, ring_segments, "_ring", crs=ring_crs,
                           first_feature_only=(ring_crs != "utm37"))
    df = df.withColumn("distance_to_mkad_km", rint_dp(F.col("_ring"), 2)).drop("_ring")
    df = nearest_per_category(df, poi, "poi_type", POI_TYPES, POI_OUT, force=nn_form)
    return df.withColumns({c: rint_dp(F.col(c), 2) for c in POI_OUT.values()})


def reenrich(synthetic: DataFrame, *dims: DataFrame, **kw) -> DataFrame:
    """Synthetic rows without coordinates dropped, all geography computed again, and the flag
    of a near station with it."""
    rows = synthetic.na.drop(subset=["latitude", "longitude"])
    return enrich_listings(rows, *dims, **kw).withColumn("has_metro_near", metro_near_flag("metro_walk_min"))
