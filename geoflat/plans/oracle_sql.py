"""Shared DuckDB SQL fragments for the oracles (independent formulations of the stages)."""

from __future__ import annotations

import math

from ..functions.geo import (CENTER_LAT, CENTER_LON, UTM37_LON0, UTM_FALSE_EASTING, UTM_K0,
                             WEB_MERCATOR_R, WGS84_A, WGS84_F, haversine_sql)
from ..sources.fixtures import CLUSTER_EXPR, oracle_with


def clean_ctes(src: str = "listings", enriched: bool = False) -> str:
    """The cleaning stage as CTEs ``deduped, filtered, med, cleaned`` over ``src``."""
    med_cols = ["build_year", "ceiling_height"] + (
        ["metro_distance_km", "metro_walk_min", ] if enriched else [])
    extra_filter = (" AND distance_to_center_km <= 60 AND distance_to_mkad_km <= 80"
                    if enriched else "")
    cats = ["walls", "renovation", "parking", "elevator"] + (["address"] if enriched else [])
    dedup = "address, price, area_total, floor, latitude, longitude" if enriched else \
        "price, area_total, floor, latitude, longitude"
    med_sel = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in med_cols)
    repl = [f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in med_cols]
    repl += [f"lower(trim(coalesce({c}, 'unknown'))) AS {c}" for c in cats]
    feats = ["price / nullif(area_total, 0) AS price_per_m2",
             "CAST(floor AS DOUBLE) / nullif(CAST(floors_total AS DOUBLE), 0) AS floor_ratio",
             "2026 - coalesce(CAST(build_year AS DOUBLE), m_build_year) AS house_age"]
    if enriched:
        feats.append("CAST(coalesce(coalesce(CAST(metro_walk_min AS DOUBLE), m_metro_walk_min)"
                     " <= 15, false) AS INTEGER) AS has_metro_near")
    excl = ", ".join(f"m_{c}" for c in med_cols)
    return f"""
deduped AS (
  SELECT * FROM {src}
  WHERE price IS NOT NULL AND area_total IS NOT NULL AND latitude IS NOT NULL
    AND longitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {dedup} ORDER BY listing_id) = 1
),
filtered AS (
  SELECT * REPLACE (
      CASE WHEN ceiling_height < 2.3e0 OR ceiling_height > 6e0 THEN NULL
           ELSE ceiling_height END AS ceiling_height,
      CASE WHEN build_year < 1800 OR build_year > 2026 THEN NULL ELSE build_year END AS build_year)
  FROM deduped
  WHERE price BETWEEN 3000000 AND 300000000 AND area_total BETWEEN 10 AND 300
    AND floor BETWEEN 1 AND 100 AND floors_total BETWEEN 1 AND 100
    AND floor <= floors_total{extra_filter}
),
med AS (SELECT {med_sel} FROM filtered),
cleaned AS (
  SELECT * EXCLUDE ({excl}) REPLACE ({", ".join(repl)}), {", ".join(feats)}
  FROM filtered, med
)"""


CLEAN_CTES = clean_ctes()


def with_cleaned(*extra: str) -> str:
    """WITH listings..., cleaned AS (...), clustered_clean AS (...)"""
    return (oracle_with("listings", *extra).rstrip() + ", " + CLEAN_CTES.strip()
            + f", clustered_clean AS (SELECT *, {CLUSTER_EXPR} AS geo_generation_cluster "
            "FROM cleaned) ")


# ------------------------------------------------------------------ geodesy in SQL
def center_sql(lat: str = "latitude", lon: str = "longitude") -> str:
    return haversine_sql(lat, lon, f"{CENTER_LAT}e0", f"{CENTER_LON}e0")


def webmercator_sql(lat: str, lon: str) -> tuple[str, str]:
    x = f"({WEB_MERCATOR_R}e0*radians({lon}))"
    y = f"({WEB_MERCATOR_R}e0*ln(tan({math.pi / 4!r}+radians({lat})/2)))"
    return x, y


def utm37_sql(lat: str, lon: str) -> tuple[str, str]:
    f = WGS84_F
    n = f / (2 - f)
    big_a = WGS84_A / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5,
             61 * n ** 3 / 240]
    e = math.sqrt(f * (2 - f))
    sphi = f"sin(radians({lat}))"
    lam = f"(radians({lon}) - {math.radians(UTM37_LON0)!r})"
    at = lambda x: f"(0.5*ln((1+({x}))/(1-({x}))))"
    t = f"sinh({at(sphi)} - {e!r}*{at(f'{e!r}*{sphi}')})"
    xi_p = f"atan2({t}, cos({lam}))"
    eta_p = at(f"sin({lam})/sqrt(1+({t})*({t}))")
    xi = xi_p
    eta = eta_p
    for j, a in enumerate(alpha, start=1):
        xi += f" + {a!r}*sin({2 * j}*{xi_p})*cosh({2 * j}*{eta_p})"
        eta += f" + {a!r}*cos({2 * j}*{xi_p})*sinh({2 * j}*{eta_p})"
    return (f"({UTM_FALSE_EASTING!r} + {UTM_K0 * big_a!r}*({eta}))",
            f"({UTM_K0 * big_a!r}*({xi}))")


def seg_dist_sql(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    dx, dy = f"({x2}-{x1})", f"({y2}-{y1})"
    l2 = f"({dx}*{dx}+{dy}*{dy})"
    t = (f"least(greatest(CASE WHEN {l2} = 0 THEN 0.0 ELSE "
         f"(({px}-{x1})*{dx}+({py}-{y1})*{dy})/{l2} END, 0.0), 1.0)")
    qx, qy = f"({x1}+{t}*{dx})", f"({y1}+{t}*{dy})"
    return f"sqrt(({px}-{qx})*({px}-{qx})+({py}-{qy})*({py}-{qy}))"
