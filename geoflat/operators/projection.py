"""Projection and schema operators (B1-B13). Plan-time column logic only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_empty


def normalize_columns(df: DataFrame) -> DataFrame:
    """B1: strip, lower, space -> '_'."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def present(df: DataFrame, cols: list[str]) -> list[str]:
    """B2: the subset of ``cols`` that exists (order of ``cols``)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """Raise if any required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing required columns {missing}")
    return df


def select_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Subset + rename in mapping order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def preferred_order(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Known columns first, the rest in their original order."""
    first = present(df, preferred)
    rest = [c for c in df.columns if c not in set(first)]
    return df.select(*first, *rest)


def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """B6."""
    return df.drop(*present(df, cols))


def keep_raw_copy(df: DataFrame, cols: list[str] = ("address", "metro")) -> DataFrame:
    """``c`` -> ``c_raw`` before cleaning."""
    return df.withColumns({f"{c}_raw": F.col(c) for c in present(df, list(cols))})


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# Name keywords of the noisy-copy augmentation.
DISTANCE_KEYWORDS = ["distance", "nearest", "metro", "mkad", "center", "school",
                     "kindergarten", "clinic", "mall"]
INTEGER_KEYWORDS = ["room", "floor", "year"]


def columns_by_keyword(df: DataFrame, exclude: list[str] = ()) -> dict[str, list[str]]:
    """Numeric columns split by substrings of the lower-cased name: distance-like
    (any numeric column), then among the rest (not excluded, no 'price' in the name)
    integer-like and continuous."""
    out = {"distance": [], "integer": [], "continuous": []}
    for c in numeric_columns(df):
        low = c.lower()
        if any(k in low for k in DISTANCE_KEYWORDS):
            out["distance"].append(c)
        elif c in exclude or "price" in low:
            continue
        elif any(k in low for k in INTEGER_KEYWORDS):
            out["integer"].append(c)
        else:
            out["continuous"].append(c)
    return out


# Geo-dependent columns blanked on synthetic rows.
GEO_KEYWORDS = ["distance_to_", "nearest_", "metro_distance", "metro_walk"]
GEO_EXACT = ["metro", "metro_source", "address", "address_source", "house_number",
             "has_metro_near"]


def nullify_geo(df: DataFrame) -> DataFrame:
    """NULL (keeping the declared type) for geo-dependent columns; link='synthetic'."""
    out = []
    for f in df.schema.fields:
        low = f.name.lower()
        if any(k in low for k in GEO_KEYWORDS) or f.name in GEO_EXACT:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == "link":
            out.append(F.lit("synthetic").alias("link"))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def provenance(has_geo: Column, address: Column, metro: Column) -> dict[str, Column]:
    """address_source raw/geo/missing, metro_source raw/geo_recomputed/missing.
    'geo' is set whenever coordinates exist and the raw address is empty, even if the
    lookup found nothing (reference behaviour)."""
    addr_src = (F.when(~is_empty(address), "raw")
                .when(has_geo, "geo").otherwise("missing"))
    metro_src = (F.when(has_geo, "geo_recomputed")
                 .when(~is_empty(metro), "raw").otherwise("missing"))
    return {"address_source": addr_src, "metro_source": metro_src}


def address_fill(listings: DataFrame, gazetteer: DataFrame, dp: int = 3) -> DataFrame:
    """Empty addresses filled from a (lat, lon) gazetteer table by coordinate cell
    (floor of coordinate x 10^dp, identical in every engine); existing addresses kept.
    The gazetteer is aggregated to one address per cell first, so the join cannot
    multiply rows."""
    scale = float(10 ** dp)
    cell = lambda lat, lon: [F.floor(F.col(lat) * scale).alias("_glat"),
                             F.floor(F.col(lon) * scale).alias("_glon")]
    g = (gazetteer.select(*cell("latitude", "longitude"), F.col("address").alias("_gaddr"))
         .where(F.col("_gaddr").isNotNull())
         .groupBy("_glat", "_glon").agg(F.min("_gaddr").alias("_gaddr")))
    l = listings.select("*", *cell("latitude", "longitude"))
    out = l.join(g, ["_glat", "_glon"], "left")
    return out.withColumn("address", F.when(is_empty(F.col("address")), F.col("_gaddr"))
                          .otherwise(F.col("address"))).drop("_glat", "_glon", "_gaddr")


_ident = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
