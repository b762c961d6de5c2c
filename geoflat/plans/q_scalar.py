"""Registered queries: scalar casts and text functions (C1-C13, C18-C27, C34, C35),
projection/schema operators (B1-B10, B12, B13) and row filters (D1-D6, D9-D11).
Each reads the listings derived from lineitem; each oracle is independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import filters as D
from ..operators import projection as B
from ..sources import fixtures as X
from ..sources.fixtures import oracle_with
from .catalog import query, rnd

L = oracle_with("listings")
NUM_RE = "'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
# a text column with the numeric traps: 'nan', '1d', ' 12.5', '' and NULL
MIXED_TEXT = ("CASE WHEN rooms IS NULL THEN 'nan' WHEN rooms = 1 THEN '1d' WHEN rooms = 2 THEN '' "
              "WHEN rooms = 3 THEN concat(' ', cast(area_total as string)) "
              "WHEN rooms = 4 THEN NULL ELSE cast(area_total as string) END")


def _l(spark, sf_dir):
    return X.listings(spark, sf_dir)


def _sql_num(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {NUM_RE}) THEN CAST({t} AS DOUBLE) END"


# ------------------------------------------------------------------ numeric casts
@query("coerce_numeric_locale", sql=L + "SELECT listing_id, " + _sql_num(
    "replace(replace(price_raw, ',', '.'), ' ', '')") + " AS price FROM listings")
def q_coerce_numeric_locale(spark, sf_dir):
    """C1: '68423,46 ' -> 68423.46 (comma decimal, spaces removed), bad text -> NULL."""
    return _l(spark, sf_dir).select("listing_id", N.coerce_numeric_locale("price_raw").alias("price"))


@query("coerce_numeric", sql=L + f"SELECT listing_id, {_sql_num('trim(' + MIXED_TEXT + ')')} AS v FROM listings")
def q_coerce_numeric(spark, sf_dir):
    """Text -> number; 'nan', '1d', '' and NULL -> NULL (never NaN)."""
    return _l(spark, sf_dir).select("listing_id", N.coerce_numeric(F.expr(MIXED_TEXT)).alias("v"))


@query("to_int_digits", sql=L + """
SELECT listing_id, TRY_CAST(nullif(regexp_replace(concat(cast(CAST(round(price) AS BIGINT) AS VARCHAR), ' ₽'),
       '[^0-9]', '', 'g'), '') AS BIGINT) AS price_int FROM listings""")
def q_to_int_digits(spark, sf_dir):
    """C3: '68423460 ₽' -> 68423460."""
    t = F.concat(F.round("price").cast("bigint").cast("string"), F.lit(" ₽"))
    return _l(spark, sf_dir).select("listing_id", N.to_int_digits(t).alias("price_int"))


@query("to_float_first", sql=L + """
SELECT listing_id, CAST(nullif(regexp_extract(replace(price_raw, ',', '.'), '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS v
FROM listings""")
def q_to_float_first(spark, sf_dir):
    """C4: first decimal number after ',' -> '.'."""
    return _l(spark, sf_dir).select("listing_id", N.to_float_first("price_raw").alias("v"))


# ------------------------------------------------------------------ text functions
_PAD = "concat(chr(10), '  ', renovation, chr(9), ' x  y ')"
_PAD_SQL = "(chr(10) || '  ' || renovation || chr(9) || ' x  y ')"  # NULL-propagating


@query("collapse_ws", sql=L + f"""
SELECT listing_id, trim(regexp_replace({_PAD_SQL}, '\\s+', ' ', 'g')) AS collapsed,
       nullif(trim(regexp_replace({_PAD_SQL}, '\\s+', ' ', 'g')), '') AS cleaned FROM listings""")
def q_collapse_ws(spark, sf_dir):
    """Whitespace runs -> one space, stripped; ``clean_text`` also blank -> NULL."""
    t = F.expr(_PAD)
    return _l(spark, sf_dir).select("listing_id", T.collapse_ws(t).alias("collapsed"),
                                    T.clean_text(t).alias("cleaned"))


@query("is_empty", sql=L + "SELECT listing_id, (renovation IS NULL OR trim(renovation) = '') AS empty FROM listings")
def q_is_empty(spark, sf_dir):
    """NULL or blank."""
    return _l(spark, sf_dir).select("listing_id", T.is_empty("renovation").alias("empty"))


@query("fill_norm_category", sql=L + """
SELECT listing_id, lower(trim(coalesce(renovation, 'unknown'))) AS renovation,
       lower(trim(coalesce(walls, 'unknown'))) AS walls FROM listings""")
def q_fill_norm_category(spark, sf_dir):
    """NULL -> 'unknown', strip, lower."""
    return _l(spark, sf_dir).select("listing_id", T.fill_norm_category("renovation").alias("renovation"),
                                    T.fill_norm_category("walls").alias("walls"))


_ST = "concat(' Щёлковская  ', walls, ' Ёлки ')"
_ST_SQL = "(' Щёлковская  ' || walls || ' Ёлки ')"


@query("normalize_station", sql=L + f"""
SELECT listing_id, replace(replace(trim(regexp_replace({_ST_SQL}, '\\s+', ' ', 'g')), 'ё', 'е'), 'Ё', 'Е') AS station
FROM listings""")
def q_normalize_station(spark, sf_dir):
    """Strip, collapse, ё -> е."""
    return _l(spark, sf_dir).select("listing_id", T.normalize_station(F.expr(_ST)).alias("station"))


def _multi_sql(c: str) -> str:
    parts = (f"list_filter(list_transform(string_split({c}, ','), lambda x: lower(trim(x))), "
             f"lambda x: x <> '')")
    j = f"array_to_string(list_sort(list_distinct({parts})), ', ')"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' OR {j} = '' THEN 'unknown' ELSE {j} END"


@query("multi_category", sql=L + f"""
SELECT listing_id, {_multi_sql('parking')} AS parking_norm, {_multi_sql('elevator')} AS elevator_norm
FROM listings""")
def q_multi_category(spark, sf_dir):
    """C9: 'A, B' and 'b ,a' normalise to the same sorted set."""
    return _l(spark, sf_dir).select("listing_id", T.multi_category("parking").alias("parking_norm"),
                                    T.multi_category("elevator").alias("elevator_norm"))


@query("keyword_flags", sql=L + ", n AS (SELECT listing_id, " + _multi_sql("parking") + " AS p, "
       + _multi_sql("elevator") + " AS e FROM listings) SELECT listing_id, " + ", ".join(
           [f"CAST(regexp_matches(p, '{pat}') AS INTEGER) AS {name}" for name, pat in T.PARKING_FLAGS.items()]
           + [f"CAST(regexp_matches(e, '{pat}') AS INTEGER) AS {name}" for name, pat in T.ELEVATOR_FLAGS.items()])
       + " FROM n")
def q_keyword_flags(spark, sf_dir):
    """0/1 parking and elevator flags from the normalised strings."""
    l = _l(spark, sf_dir).select("listing_id", T.multi_category("parking").alias("p"),
                                 T.multi_category("elevator").alias("e"))
    return l.select("listing_id",
                    *[T.keyword_flag(F.col("p"), pat).alias(n) for n, pat in T.PARKING_FLAGS.items()],
                    *[T.keyword_flag(F.col("e"), pat).alias(n) for n, pat in T.ELEVATOR_FLAGS.items()])


@query("walls_en", sql=L + """
SELECT listing_id, CASE WHEN walls IS NULL OR trim(walls) = '' THEN 'unknown'
  WHEN contains(lower(walls), 'монолит') THEN 'monolith' WHEN contains(lower(walls), 'кирп') THEN 'brick'
  WHEN contains(lower(walls), 'панел') THEN 'panel' WHEN contains(lower(walls), 'блок') THEN 'block'
  ELSE 'other' END AS walls_norm FROM listings""")
def q_walls_en(spark, sf_dir):
    """C11: ordered rules ('кирпично-монолитный' -> monolith)."""
    return _l(spark, sf_dir).select("listing_id", T.walls_en("walls").alias("walls_norm"))


@query("walls_ru", sql=L + """
, t AS (SELECT listing_id, nullif(trim(regexp_replace(walls, '\\s+', ' ', 'g')), '') AS w FROM listings)
SELECT listing_id, CASE WHEN w IS NULL THEN NULL WHEN contains(lower(w), 'монолит') THEN 'монолит'
  WHEN contains(lower(w), 'кирп') THEN 'кирпич' WHEN contains(lower(w), 'панел') THEN 'панель'
  WHEN contains(lower(w), 'железобетон') THEN 'железобетон' WHEN contains(lower(w), 'блок') THEN 'блок'
  ELSE lower(w) END AS walls_clean FROM t""")
def q_walls_ru(spark, sf_dir):
    """Older rules, fallback = lower-cased text, NULL stays NULL."""
    return _l(spark, sf_dir).select("listing_id", T.walls_ru("walls").alias("walls_clean"))


@query("renovation_norm", sql=L + """
SELECT listing_id, CASE WHEN renovation IS NULL OR trim(renovation) = '' THEN 'unknown'
  WHEN contains(lower(renovation), 'без ремонта') OR contains(lower(renovation), 'требует')
       OR contains(lower(renovation), 'чернов') THEN 'no_repair'
  WHEN contains(lower(renovation), 'дизайнер') THEN 'designer'
  WHEN contains(lower(renovation), 'евро') OR contains(lower(renovation), 'современ')
       OR contains(lower(renovation), 'хорош') OR contains(lower(renovation), 'качествен') THEN 'good'
  WHEN contains(lower(renovation), 'космет') THEN 'cosmetic' ELSE 'other' END AS renovation_norm
FROM listings""")
def q_renovation_norm(spark, sf_dir):
    """C13."""
    return _l(spark, sf_dir).select("listing_id", T.renovation_norm("renovation").alias("renovation_norm"))


@query("one_hot", sql=L + """
SELECT listing_id, """ + ", ".join(
    f"CAST(coalesce(CASE WHEN walls IS NULL OR trim(walls) = '' THEN 'unknown' "
    f"WHEN contains(lower(walls), 'монолит') THEN 'monolith' WHEN contains(lower(walls), 'кирп') THEN 'brick' "
    f"WHEN contains(lower(walls), 'панел') THEN 'panel' WHEN contains(lower(walls), 'блок') THEN 'block' "
    f"ELSE 'other' END = '{v}', false) AS INTEGER) AS walls_norm_{v}"
    for v in ["brick", "monolith", "other", "panel", "unknown"]) + " FROM listings")
def q_one_hot(spark, sf_dir):
    """One 0/1 column per observed category (sorted); the categories are found with
    a distinct aggregate, not by collecting the column."""
    from ..operators.ml import one_hot
    l = _l(spark, sf_dir).select("listing_id", T.walls_en("walls").alias("walls_norm"))
    return one_hot(l, "walls_norm")


# ------------------------------------------------------------------ arithmetic
@query("ratios", sql=L + """
SELECT listing_id, price / nullif(area_total, 0) AS price_per_m2,
       CAST(floor AS DOUBLE) / nullif(CAST(floors_total AS DOUBLE), 0) AS floor_ratio,
       2026 - build_year AS house_age FROM listings""")
def q_ratios(spark, sf_dir):
    """C18 + C19: price per m2, floor ratio (NULL on 0), house age."""
    return _l(spark, sf_dir).select("listing_id", N.ratio("price", "area_total").alias("price_per_m2"),
                                    N.ratio("floor", "floors_total").alias("floor_ratio"),
                                    N.house_age("build_year").alias("house_age"))


@query("metro_near_flag", sql=L + """
SELECT listing_id, CAST(coalesce(floor <= 15, false) AS INTEGER) AS has_metro_near FROM listings""")
def q_metro_near_flag(spark, sf_dir):
    """C20: minutes <= 15 -> 1, else / NULL -> 0 (floor stands in for minutes)."""
    return _l(spark, sf_dir).select("listing_id", N.metro_near_flag("floor").alias("has_metro_near"))


@query("clip_const", sql=L + """
SELECT listing_id,
  CASE WHEN area_total > 300 THEN 300 WHEN area_total < 10 THEN 10 ELSE area_total END AS area_total,
  CASE WHEN kitchen_area < 3 THEN 3 ELSE kitchen_area END AS kitchen_area,
  CASE WHEN ceiling_height > 6 THEN 6 WHEN ceiling_height < 2.3 THEN 2.3 ELSE ceiling_height END AS ceiling_height
FROM listings""")
def q_clip_const(spark, sf_dir):
    """Clamps that keep NULL."""
    return _l(spark, sf_dir).select("listing_id", N.clip("area_total", 10, 300).alias("area_total"),
                                    N.clip("kitchen_area", 3).alias("kitchen_area"),
                                    N.clip("ceiling_height", 2.3, 6).alias("ceiling_height"))


@query("clip_cross", sql=L + """
SELECT listing_id, CASE WHEN kitchen_area IS NULL OR area_total IS NULL THEN NULL
  ELSE least(kitchen_area, area_total * 0.6) END AS kitchen_area,
  CASE WHEN floor IS NULL OR floors_total IS NULL THEN NULL ELSE least(floor, floors_total) END AS floor
FROM listings""")
def q_clip_cross(spark, sf_dir):
    """Kitchen <= 0.6 area, floor <= floors_total; NULL in either -> NULL."""
    return _l(spark, sf_dir).select(
        "listing_id", N.min_strict("kitchen_area", F.col("area_total") * 0.6).alias("kitchen_area"),
        N.min_strict("floor", "floors_total").alias("floor"))


@query("null_out_of_range", sql=L + """
SELECT listing_id, CASE WHEN ceiling_height < 2.3e0 OR ceiling_height > 6e0 THEN NULL ELSE ceiling_height END AS ceiling_height,
  CASE WHEN build_year < 1800 OR build_year > 2026 THEN NULL ELSE build_year END AS build_year FROM listings""")
def q_null_out_of_range(spark, sf_dir):
    """Out-of-range value -> NULL, row kept."""
    return _l(spark, sf_dir).select("listing_id", N.null_out_of_range("ceiling_height", 2.3, 6).alias("ceiling_height"),
                                    N.null_out_of_range("build_year", 1800, 2026).alias("build_year"))


@query("missing_flag", sql=L + """
SELECT listing_id, CAST(kitchen_area IS NULL AS INTEGER) AS kitchen_area_missing,
       CAST(build_year IS NULL AS INTEGER) AS build_year_missing FROM listings""")
def q_missing_flag(spark, sf_dir):
    """C24."""
    return _l(spark, sf_dir).select("listing_id", N.missing_flag("kitchen_area").alias("kitchen_area_missing"),
                                    N.missing_flag("build_year").alias("build_year_missing"))


@query("inf_to_null", sql=L + """
SELECT listing_id, v FROM (SELECT listing_id,
  CASE WHEN floors_total = 0 OR floors_total IS NULL THEN NULL ELSE floor / floors_total END AS v FROM listings)
WHERE v IS NOT NULL""")
def q_inf_to_null(spark, sf_dir):
    """+-inf / NaN -> NULL, then rows with NULL dropped (division by a zero-floor count
    gives inf in pandas; the divisor is shifted so zeros occur)."""
    l = _l(spark, sf_dir).select("listing_id", "floor", (F.col("floors_total")).alias("ft"))
    v = F.when(F.col("ft").isNull(), F.lit(None)).otherwise(
        F.when(F.col("ft") == 0, F.lit(float("inf"))).otherwise(F.col("floor") / F.col("ft")))
    return l.select("listing_id", N.inf_to_null(v).alias("v")).na.drop()


@query("bin_cut", sql=L + """
SELECT listing_id, CASE WHEN price > 0 AND price <= 10000000 THEN '0-10M'
  WHEN price > 10000000 AND price <= 20000000 THEN '10-20M' WHEN price > 20000000 AND price <= 40000000 THEN '20-40M'
  WHEN price > 40000000 AND price <= 100000000 THEN '40-100M' WHEN price > 100000000 AND price <= 500000000 THEN '100M+'
  END AS price_bin FROM listings""")
def q_bin_cut(spark, sf_dir):
    """Right-closed price bins (pd.cut), outside -> NULL."""
    return _l(spark, sf_dir).select("listing_id", N.bin_cut("price").alias("price_bin"))


@query("round_dp", sql=L + """
SELECT listing_id, round_even(price_raw_v, 2) AS v2, round_even(price_raw_v, 0) AS v0 FROM
  (SELECT listing_id, l.price / 1000 / 7 AS price_raw_v FROM listings l)""")
def q_round_dp(spark, sf_dir):
    """Numpy half-even rounding to 2 and 0 decimals."""
    v = F.col("price") / 1000 / 7
    return _l(spark, sf_dir).select("listing_id", N.rint_dp(v, 2).alias("v2"), N.rint_dp(v, 0).alias("v0"))


@query("error_cols", sql=L + """
SELECT listing_id, (price * 1.1e0) - price AS delta, abs((price * 1.1e0) - price) AS abs_error,
  abs((price * 1.1e0) - price) / nullif(abs(price), 0) * 100 AS ape,
  abs((price * 1.1e0) - price) / nullif(area_total, 0) AS error_per_m2,
  price / nullif(area_total, 0) AS price_per_m2_real FROM listings""")
def q_error_cols(spark, sf_dir):
    """Delta, abs error, APE %, error per m2, real price per m2 (prediction = 1.1 x)."""
    l = _l(spark, sf_dir)
    cols = N.error_cols("price", F.col("price") * 1.1, "area_total")
    return l.select("listing_id", *[c.alias(k) for k, c in cols.items()])


# ------------------------------------------------------------------ projection / schema
@query("normalize_columns", sql=L + """
SELECT listing_id AS "listing_id", price AS "sale_price", area_total AS "area_total" FROM listings""")
def q_normalize_columns(spark, sf_dir):
    """B1: ' Sale Price ' -> 'sale_price'."""
    l = _l(spark, sf_dir).select(F.col("listing_id").alias(" Listing_ID"),
                                 F.col("price").alias(" Sale Price "), F.col("area_total").alias("AREA_TOTAL"))
    return B.normalize_columns(l)


@query("guarded_cols", sql=L + "SELECT listing_id, lower(walls) AS walls FROM listings")
def q_guarded_cols(spark, sf_dir):
    """B2: a step applied only to the listed columns that exist (metro_station is absent)."""
    l = _l(spark, sf_dir).select("listing_id", "walls")
    cols = B.present(l, ["walls", "metro_station"])
    return l.withColumns({c: F.lower(c) for c in cols})


@query("require_columns")
def q_require_columns(spark, sf_dir):
    """Plan-time check, raises on missing columns (rows-only)."""
    l = _l(spark, sf_dir)
    B.require_columns(l, ["price", "area_total"], "listings")
    try:
        B.require_columns(l, ["price", "no_such_column"], "listings")
        raise AssertionError("missing column not detected")
    except ValueError:
        pass
    return l.select("listing_id", "price")


@query("select_rename", sql=L + "SELECT lat, lon, metro FROM (SELECT 55.55e0+((n_nationkey*379) % 401)/1e3 AS lat, 37.35e0+((n_nationkey*211) % 503)/1e3 AS lon, concat('st_', CAST(n_nationkey AS VARCHAR)) AS metro FROM nation)")
def q_select_rename(spark, sf_dir):
    """Subset + rename."""
    s = X.stations(spark, sf_dir)
    return B.select_rename(s, {"lat": "lat", "lon": "lon", "metro": "metro"})


@query("preferred_order", sql=L + "SELECT price, link, listing_id, source_group FROM listings")
def q_preferred_order(spark, sf_dir):
    """Known columns first, the rest after in their original order."""
    l = _l(spark, sf_dir).select("listing_id", "source_group", "link", "price")
    return B.preferred_order(l, ["price", "no_such", "link"])


@query("drop_raw_text", sql=L + "SELECT listing_id, price FROM listings")
def q_drop_raw_text(spark, sf_dir):
    """Drop listed columns when present."""
    l = _l(spark, sf_dir).select("listing_id", "price", "price_raw", "link")
    return B.drop_if_present(l, ["price_raw", "link", "address"])


@query("keep_raw_copy", sql=L + "SELECT listing_id, walls, walls AS walls_raw FROM listings")
def q_keep_raw_copy(spark, sf_dir):
    """Raw copies before cleaning."""
    return B.keep_raw_copy(_l(spark, sf_dir).select("listing_id", "walls"), ["walls", "address"])


@query("constant_cols", sql=L + """
SELECT listing_id, 1 AS is_synthetic, 'original' AS generation_method, 'synthetic' AS link FROM listings""")
def q_constant_cols(spark, sf_dir):
    """Literal tag columns."""
    return _l(spark, sf_dir).select("listing_id").withColumns({
        "is_synthetic": F.lit(1), "generation_method": F.lit("original"), "link": F.lit("synthetic")})


@query("select_by_dtype", sql=L + """
SELECT price, area_total, rooms, floor, floors_total, latitude, longitude, build_year,
       ceiling_height, kitchen_area FROM listings""")
def q_select_by_dtype(spark, sf_dir):
    """All numeric columns."""
    l = _l(spark, sf_dir)
    return l.select(*B.numeric_columns(l))


@query("select_by_keyword", sql=L + """
SELECT listing_id, area_total, ceiling_height, kitchen_area FROM listings""")
def q_select_by_keyword(spark, sf_dir):
    """The continuous columns chosen by name keyword (distance-like, integer-like
    and excluded names are left out)."""
    l = _l(spark, sf_dir).withColumn("metro_distance_km", F.lit(1.0))
    groups = B.columns_by_keyword(l, exclude=["latitude", "longitude"])
    return l.select("listing_id", *groups["continuous"])


@query("provenance", sql=L + """
SELECT listing_id, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'geo' ELSE 'missing' END AS address_source,
  CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'geo_recomputed'
       WHEN walls IS NOT NULL AND trim(walls) <> '' THEN 'raw' ELSE 'missing' END AS metro_source FROM listings""")
def q_provenance(spark, sf_dir):
    """address/metro provenance (walls stands in for a raw metro text)."""
    l = _l(spark, sf_dir)
    has_geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    p = B.provenance(has_geo, F.lit(None).cast("string"), F.col("walls"))
    return l.select("listing_id", *[c.alias(k) for k, c in p.items()])


@query("address_fill", sql=L + """
, g AS (SELECT floor(latitude * 1000.0) AS glat, floor(longitude * 1000.0) AS glon,
               min('Москва, ул. Тестовая, ' || CAST(floors_total AS VARCHAR)) AS gaddr
        FROM listings WHERE floors_total IS NOT NULL GROUP BY 1, 2),
a AS (SELECT listing_id, latitude, longitude,
        CASE WHEN rooms = 0 THEN NULL ELSE 'raw ' || listing_id END AS address FROM listings)
SELECT a.listing_id, CASE WHEN a.address IS NULL OR trim(a.address) = '' THEN g.gaddr ELSE a.address END AS address
FROM a LEFT JOIN g ON g.glat = floor(a.latitude * 1000.0) AND g.glon = floor(a.longitude * 1000.0)""")
def q_address_fill(spark, sf_dir):
    """Empty addresses filled from a gazetteer (derived from the listings) on rounded
    coordinates; existing addresses kept."""
    l = _l(spark, sf_dir)
    gaz = l.where(F.col("floors_total").isNotNull()).select(
        "latitude", "longitude",
        F.concat(F.lit("Москва, ул. Тестовая, "), F.col("floors_total").cast("string")).alias("address"))
    a = l.select("listing_id", "latitude", "longitude",
                 F.when(F.col("rooms") == 0, F.lit(None)).otherwise(
                     F.concat(F.lit("raw "), F.col("listing_id"))).alias("address"))
    return B.address_fill(a, gaz).select("listing_id", "address")


# ------------------------------------------------------------------ filters
@query("drop_critical", sql=L + """
SELECT listing_id FROM listings WHERE rooms IS NOT NULL AND floor IS NOT NULL AND price IS NOT NULL""")
def q_drop_critical(spark, sf_dir):
    """Rows with NULL in a listed column dropped (absent columns ignored)."""
    return D.drop_critical(_l(spark, sf_dir), ["rooms", "floor", "price", "no_such"]).select("listing_id")


@query("range_strict", sql=L + """
SELECT listing_id FROM listings WHERE price BETWEEN 3000000 AND 300000000 AND area_total BETWEEN 10 AND 300
  AND floor BETWEEN 1 AND 100 AND floors_total BETWEEN 1 AND 100""")
def q_range_strict(spark, sf_dir):
    """Inclusive ranges, NULL fails."""
    return D.range_strict(_l(spark, sf_dir)).select("listing_id")


@query("range_null_ok", sql=L + """
SELECT listing_id FROM listings WHERE (rooms IS NULL OR rooms BETWEEN 0 AND 10)
  AND (kitchen_area IS NULL OR kitchen_area BETWEEN 2 AND 100) AND (floor IS NULL OR floor BETWEEN 1 AND 100)
  AND (floors_total IS NULL OR floors_total BETWEEN 1 AND 100)""")
def q_range_null_ok(spark, sf_dir):
    """D3: in range or NULL."""
    return D.range_null_ok(_l(spark, sf_dir)).select("listing_id")


@query("floor_le_total", sql=L + """
SELECT listing_id, 'strict' AS mode FROM listings WHERE floor <= floors_total
UNION ALL SELECT listing_id, 'null_ok' FROM listings WHERE floor IS NULL OR floors_total IS NULL OR floor <= floors_total""")
def q_floor_le_total(spark, sf_dir):
    """Strict and NULL-tolerant variants."""
    l = _l(spark, sf_dir)
    return (D.floor_le_total(l).select("listing_id", F.lit("strict").alias("mode"))
            .unionByName(D.floor_le_total(l, null_ok=True).select("listing_id", F.lit("null_ok").alias("mode"))))


@query("ppm2_band", sql=L + """
SELECT listing_id FROM (SELECT listing_id, price / nullif(area_total, 0) AS price_per_m2 FROM listings)
WHERE price_per_m2 BETWEEN 30000 AND 3000000""")
def q_ppm2_band(spark, sf_dir):
    """Price per m2 band 30k..3M inclusive."""
    l = _l(spark, sf_dir).select("listing_id", N.ratio("price", "area_total").alias("price_per_m2"))
    return D.ppm2_band(l).select("listing_id")


@query("dedup_keep_first", sql=L + """
SELECT link, listing_id, price FROM listings QUALIFY row_number() OVER (PARTITION BY link ORDER BY listing_id) = 1""")
def q_dedup_keep_first(spark, sf_dir):
    """One row per link, the first (smallest id) survives; aggregate, not a window."""
    l = _l(spark, sf_dir).select("link", "listing_id", "price")
    return D.dedup_keep_first(l, ["link"], "listing_id")


@query("junk_audit", sql=L + """
SELECT listing_id, renovation FROM listings WHERE regexp_matches(renovation, '(?i)(ремонт|отделка)')""")
def q_junk_audit(spark, sf_dir):
    """Rows whose text still matches a pattern, case-insensitive for Cyrillic."""
    return D.junk_audit(_l(spark, sf_dir), "renovation", "(ремонт|отделка)", ["listing_id"])


@query("deal_filter", sql=L + """
SELECT listing_id FROM (SELECT listing_id, price, price / nullif(area_total, 0) AS price_per_m2 FROM listings)
WHERE price > 5000000 AND price_per_m2 > 100000 AND price_per_m2 < 1000000""")
def q_deal_filter(spark, sf_dir):
    """D10."""
    l = _l(spark, sf_dir).select("listing_id", "price", N.ratio("price", "area_total").alias("price_per_m2"))
    return D.deal_filter(l).select("listing_id")


@query("membership", sql=L + """
SELECT listing_id FROM listings WHERE walls IN ('Монолитный', 'Кирпичный')
  AND link IN (SELECT 'https://example.org/realty/' || CAST(user_id AS VARCHAR) || '/' FROM events)""")
def q_membership(spark, sf_dir):
    """Value in a fixed set + key in a processed set (left-semi join)."""
    from ..sources.tables import read_table
    ev = read_table(spark, sf_dir, "events").select(F.concat(
        F.lit("https://example.org/realty/"), F.col("user_id").cast("string"), F.lit("/")).alias("link"))
    l = _l(spark, sf_dir).where(F.col("walls").isin("Монолитный", "Кирпичный"))
    return l.join(ev, "link", "left_semi").select("listing_id")


_ = rnd
