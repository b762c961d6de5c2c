"""The cleaning stage: normalise names, cast, drop, dedup, filter, impute, derive.

One lazy plan; the only barriers are the dedup aggregate and the one-row median table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.text import fill_norm_category
from ..operators import filters as D
from ..operators.projection import normalize_columns, present
from ..operators.ranks import column_quantiles
from ..session import stored

# Column lists of the cleaning stage. Names nobody produces are kept on
# purpose: the guards skip them exactly as the reference does.
NUMERIC_COLS = ["price", "area_total", "area_living", "area_kitchen", "floor", "floors_total",
                "build_year", "ceiling_height", "latitude", "longitude",
                "distance_to_center_km", "distance_to_mkad_km", "nearest_school_km",
                "nearest_kindergarten_km", "nearest_clinic_km", "nearest_mall_km",
                "metro_distance_km", "metro_walk_min"]
CRITICAL_COLS = ["price", "area_total", "latitude", "longitude"]
DEDUP_KEYS = ["address", "price", "area_total", "floor", "latitude", "longitude"]
MEDIAN_FILL_COLS = ["build_year", "ceiling_height", "area_living", "area_kitchen",
                    "metro_distance_km", "metro_walk_min", "nearest_school_km",
                    "nearest_kindergarten_km", "nearest_clinic_km", "nearest_mall_km"]
CATEGORICAL_COLS = ["address", "metro_station", "walls", "parking", "yard", "elevator",
                    "renovation", "building_type"]
AS_OF_YEAR = 2026


def coerce_listed(df: DataFrame, cols: list[str] = NUMERIC_COLS) -> DataFrame:
    """C1 over the present numeric columns (string sources only; numbers pass through)."""
    out = {}
    for f in df.schema.fields:
        if f.name in cols and f.dataType.simpleString() == "string":
            out[f.name] = N.coerce_numeric_locale(f.name)
    return df.withColumns(out) if out else df


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: NULL -> global exact median of the column (one-row table, broadcast)."""
    cols = present(df, cols)
    if not cols:
        return df
    med = column_quantiles(df, [], cols, {"_m": 0.5}, cheap=True)
    wide = med.agg(*[F.max(F.when(F.col("_feature") == c, F.col("_m"))).alias(f"_med_{c}")
                     for c in cols])
    out = df.crossJoin(F.broadcast(wide))
    # pandas turns a column with NULLs into float64, so imputed columns are doubles
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in cols
    }).drop(*[f"_med_{c}" for c in cols])


def clean_listings(df: DataFrame, order_col: str = "listing_id",
                   as_of_year: int = AS_OF_YEAR) -> DataFrame:
    df = normalize_columns(df)
    df = coerce_listed(df)
    df = D.drop_critical(df, CRITICAL_COLS)
    df = D.dedup_keep_first(df, DEDUP_KEYS, order_col)
    df = D.range_strict(df)
    df = D.floor_le_total(df)
    nulls = {}
    if "ceiling_height" in df.columns:
        nulls["ceiling_height"] = N.null_out_of_range("ceiling_height", 2.3, 6)
    if "build_year" in df.columns:
        nulls["build_year"] = N.null_out_of_range("build_year", 1800, as_of_year)
    df = df.withColumns(nulls) if nulls else df
    if "distance_to_center_km" in df.columns:
        df = df.where(F.col("distance_to_center_km") <= 60)
    if "distance_to_mkad_km" in df.columns:
        df = df.where(F.col("distance_to_mkad_km") <= 80)
    # the filtered base feeds both the median job and the final projection: write it once
    # to the shared checkpoint folder instead of recomputing the dedup shuffle twice
    df = stored(df)
    df = median_impute(df, MEDIAN_FILL_COLS)
    cats = present(df, CATEGORICAL_COLS)
    if cats:
        df = df.withColumns({c: fill_norm_category(c) for c in cats})
    feats = {}
    if {"price", "area_total"}.issubset(df.columns):
        feats["price_per_m2"] = N.ratio("price", "area_total")
    if {"floor", "floors_total"}.issubset(df.columns):
        feats["floor_ratio"] = N.ratio("floor", "floors_total")
    if "build_year" in df.columns:
        feats["house_age"] = N.house_age("build_year", as_of_year)
    if "metro_walk_min" in df.columns:
        feats["has_metro_near"] = N.metro_near_flag("metro_walk_min")
    return df.withColumns(feats) if feats else df
