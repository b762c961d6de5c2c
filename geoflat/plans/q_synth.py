"""Registered queries: split, interpolation synthesis, constraints, augmentation, reports
and before/after distribution checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import metro_near_flag
from ..functions.rand import (hash_beta22_sql, hash_normal_sql, hash_u64_sql,
                              hash_uniform52_sql, hash_uniform_sql)
from ..operators import stats as S
from ..operators import synth as J
from ..operators.projection import nullify_geo
from ..sources import fixtures as X
from ..sources.fixtures import oracle_with
from .catalog import query, rnd, sig, sig_sql
from .enrich import enrich_listings, reenrich
from .oracle_sql import with_cleaned
from .q_clean import clustered_clean
from .q_spatial import GEO_COLS, geo_ctes, geo_dims
from .q_stats import CLEAN_NUM

CL = "geo_generation_cluster"
TRAIN_COLS = ["listing_id", "source_group", "price", "area_total", "rooms", "floor",
              "floors_total", "latitude", "longitude", "build_year", "ceiling_height",
              "kitchen_area", "walls", "renovation", "parking", "elevator", "price_raw", "link",
              "price_per_m2", "floor_ratio", "house_age", CL]
JIT = 35 / 111_000


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, clustered listings with kitchen area imputed by rooms."""
    return S.group_median_impute(clustered_clean(spark, sf_dir), "rooms", "kitchen_area")


def split(spark, sf_dir) -> DataFrame:
    return J.train_test_split(prepared(spark, sf_dir), "listing_id")


def train(spark, sf_dir) -> DataFrame:
    return split(spark, sf_dir).where("split = 'train'").drop("split")


def augmented(spark, sf_dir) -> DataFrame:
    return train_and_augmented(spark, sf_dir)[1]


def train_and_augmented(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The training set written once to the checkpoint folder, and the augmented set built
    on it - before/after comparisons read both without recomputing the cleaning."""
    from ..session import stored
    tr = stored(train(spark, sf_dir))
    return tr, J.mark_original(tr).unionByName(J.synth_interpolate(tr, cheap=True))


def numbers_compared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The numbers of both sets, cheap to read again: only the columns that the synthesis of ``CLEAN_NUM`` needs
    are carried through it, and of the augmented set only the synthetic rows are stored."""
    from ..session import stored
    tr = stored(train(spark, sf_dir).select("listing_id", CL, *CLEAN_NUM))
    numbers = [F.col(c).cast("double").alias(c) for c in CLEAN_NUM]
    synthetic = stored(J.synth_interpolate(tr, cheap=True).select(*numbers))
    return tr.select(*numbers), J.mark_original(tr).select(*numbers).unionByName(synthetic)


# ------------------------------------------------------------------ oracle CTEs
_PREP = with_cleaned() + """
, gm AS (SELECT rooms, quantile_cont(kitchen_area, 0.5) AS gm FROM clustered_clean
         WHERE rooms IS NOT NULL GROUP BY rooms),
s1 AS (SELECT c.* REPLACE (CASE WHEN c.rooms IS NULL THEN NULL
                          ELSE coalesce(c.kitchen_area, gm.gm) END AS kitchen_area)
       FROM clustered_clean c LEFT JOIN gm ON c.rooms = gm.rooms),
g9 AS (SELECT quantile_cont(kitchen_area, 0.5) AS g FROM s1),
prepared AS (SELECT s1.* REPLACE (coalesce(kitchen_area, g9.g) AS kitchen_area) FROM s1, g9),
ranked AS (SELECT *, row_number() OVER (ORDER BY """ + hash_u64_sql(
    "listing_id", "'split'", "'42'") + """, listing_id) AS _rk, count(*) OVER () AS _cnt
           FROM prepared),
splitted AS (SELECT * EXCLUDE (_rk, _cnt),
             CASE WHEN _rk <= ceil(0.2 * _cnt) THEN 'test' ELSE 'train' END AS split FROM ranked),
train AS (SELECT * EXCLUDE (split) FROM splitted WHERE split = 'train')"""


def _k(*salt: str) -> list[str]:
    return ["CAST(cl AS VARCHAR)", "CAST(slot AS VARCHAR)", "'42'", *[f"'{s}'" for s in salt]]


def _noise(std: str, salt: str) -> str:
    return (f"(CASE WHEN {std} IS NOT NULL AND {std} > 0 THEN "
            f"{hash_normal_sql(*_k(salt))} * {std} * 0.03 ELSE 0.0 END)")


def _mix(c: str) -> str:
    return f"(lam * a.{c} + (1 - lam) * b.{c})"


def _clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"(CASE WHEN {x} < {lo} THEN {lo} ELSE {out} END)"
    if hi is not None:
        out = f"(CASE WHEN {x} > {hi} THEN {hi} ELSE {out} END)"
    return out


def _synth_sql() -> str:
    coin = f"({hash_uniform_sql(*_k('coin'))} < lam)"
    area = f"({_mix('area_total')} + {_noise('s_area', 'n_area_total')})"
    kitchen = f"({_mix('kitchen_area')} + {_noise('s_kitchen', 'n_kitchen_area')})"
    ceiling = f"({_mix('ceiling_height')} + {_noise('s_ceiling', 'n_ceiling_height')})"
    ppm2 = (f"least(greatest({_mix('price_per_m2')} + {_noise('s_ppm2', 'n_ppm2')}, q01), q99)")
    lat = (f"least(greatest({_mix('latitude')} + {hash_normal_sql(*_k('jlat'))} * {JIT!r}, "
           f"lat_min - 2 * {JIT!r}), lat_max + 2 * {JIT!r})")
    lon = (f"least(greatest({_mix('longitude')} + {hash_normal_sql(*_k('jlon'))} * {JIT!r}, "
           f"lon_min - 2 * {JIT!r}), lon_max + 2 * {JIT!r})")
    cats = ", ".join(f"CASE WHEN {coin} THEN a.{c} ELSE b.{c} END AS {c}"
                     for c in ["source_group", "renovation", "walls", "elevator", "parking"])
    return _PREP + f"""
, idx AS (SELECT *, row_number() OVER (PARTITION BY {CL} ORDER BY listing_id) - 1 AS _i FROM train),
st AS (SELECT {CL} AS cl, count(*) AS _n, min(latitude) AS lat_min, max(latitude) AS lat_max,
              min(longitude) AS lon_min, max(longitude) AS lon_max,
              stddev_samp(area_total) AS s_area, stddev_samp(kitchen_area) AS s_kitchen,
              stddev_samp(ceiling_height) AS s_ceiling, stddev_samp(price_per_m2) AS s_ppm2,
              quantile_cont(price_per_m2, 0.01) AS q01, quantile_cont(price_per_m2, 0.99) AS q99
       FROM train GROUP BY {CL} HAVING count(*) >= 5),
slots AS (SELECT st.*, unnest(range(i._i * 2, i._i * 2 + 2)) AS slot
          FROM idx i JOIN st ON i.{CL} = st.cl),
sp AS (SELECT *, CAST(floor({hash_uniform52_sql(*_k('pa'))} * _n) AS BIGINT) AS ia,
              CAST(floor({hash_uniform52_sql(*_k('pb'))} * _n) AS BIGINT) AS ib,
              {hash_beta22_sql(*_k('lam'))} AS lam FROM slots),
raw AS (
  SELECT 'syn-' || CAST(sp.cl AS VARCHAR) || '-' || CAST(sp.slot AS VARCHAR) AS listing_id,
         {cats}, a.price_raw, sp.cl AS {CL},
         {lat} AS latitude, {lon} AS longitude,
         {area} AS area_m, {kitchen} AS kitchen_m, {ceiling} AS ceiling_m,
         round_even({_mix('rooms')}, 0) AS rooms_m, round_even({_mix('floor')}, 0) AS floor_m,
         round_even({_mix('floors_total')}, 0) AS floors_m,
         round_even({_mix('build_year')}, 0) AS year_m, {ppm2} AS ppm2_m
  FROM sp JOIN idx a ON a.{CL} = sp.cl AND a._i = sp.ia
          JOIN idx b ON b.{CL} = sp.cl AND b._i = sp.ib),
c1 AS (
  SELECT *, ppm2_m * area_m AS price_m, {_clip('area_m', 10, 300)} AS area_c,
         {_clip('floors_m', 1, 100)} AS floors_c, {_clip('year_m', 1800, 2026)} AS year_c
  FROM raw),
synthetic AS (
  SELECT listing_id, source_group, price_m AS price, area_c AS area_total,
         {_clip('rooms_m', 1, 10)} AS rooms,
         CASE WHEN {_clip('floor_m', 1, 100)} IS NULL OR floors_c IS NULL THEN NULL
              ELSE least({_clip('floor_m', 1, 100)}, floors_c) END AS floor,
         floors_c AS floors_total, latitude, longitude, year_c AS build_year,
         {_clip('ceiling_m', 2.3, 6.0)} AS ceiling_height,
         CASE WHEN {_clip('kitchen_m', 3)} IS NULL OR area_c IS NULL THEN NULL
              ELSE least({_clip('kitchen_m', 3)}, area_c * 0.6) END AS kitchen_area,
         walls, renovation, parking, elevator, price_raw, 'synthetic' AS link,
         price_m / nullif(area_c, 0) AS price_per_m2,
         CASE WHEN {_clip('floor_m', 1, 100)} IS NULL OR floors_c IS NULL THEN NULL
              ELSE least({_clip('floor_m', 1, 100)}, floors_c) END / nullif(floors_c, 0) AS floor_ratio,
         2026 - year_c AS house_age, {CL}, 1 AS is_synthetic,
         'geo_cluster_interpolation' AS generation_method, {CL} AS parent_geo_cluster
  FROM c1),
originals AS (SELECT *, 0 AS is_synthetic, 'original' AS generation_method,
                     {CL} AS parent_geo_cluster FROM train),
train_augmented AS (
  SELECT * REPLACE (CAST(rooms AS DOUBLE) AS rooms, CAST(floor AS DOUBLE) AS floor,
                    CAST(floors_total AS DOUBLE) AS floors_total) FROM originals
  UNION ALL BY NAME SELECT * FROM synthetic)"""


SYNTH_SQL = _synth_sql()
_SYN_OUT = ["listing_id", "price", "area_total", "rooms", "floor", "floors_total", "latitude",
            "longitude", "build_year", "ceiling_height", "kitchen_area", "price_per_m2",
            "floor_ratio", "house_age", "walls", "renovation", "source_group", "link", CL,
            "is_synthetic", "generation_method", "parent_geo_cluster"]
_SYN_FLOAT = ["price", "area_total", "latitude", "longitude", "ceiling_height", "kitchen_area",
              "price_per_m2", "floor_ratio"]


def _syn_select_sql() -> str:
    return ", ".join(f"{sig_sql(c, 10)} AS {c}" if c in _SYN_FLOAT else c for c in _SYN_OUT)


# ------------------------------------------------------------------ queries
@query("train_test_split", sql=_PREP + " SELECT listing_id, split FROM splitted")
def q_train_test_split(spark, sf_dir):
    """Exact 80/20 split by seeded hash rank."""
    return split(spark, sf_dir).select("listing_id", "split")


@query("synth_interpolate", sql=SYNTH_SQL + f" SELECT {_syn_select_sql()} FROM synthetic")
def q_synth_interpolate(spark, sf_dir):
    """Interpolated synthetic rows (coordinates, continuous, integer, category,
    price via price per m2, constraints, geo columns blanked)."""
    syn = J.synth_interpolate(train(spark, sf_dir))
    return syn.select(*[sig(c, 10).alias(c) if c in _SYN_FLOAT else F.col(c) for c in _SYN_OUT])


@query("parent_pairs", sql=SYNTH_SQL + f"""
SELECT sp.cl AS {CL}, sp.slot, a.listing_id AS parent_a, b.listing_id AS parent_b
FROM sp JOIN idx a ON a.{CL} = sp.cl AND a._i = sp.ia JOIN idx b ON b.{CL} = sp.cl AND b._i = sp.ib""")
def q_parent_pairs(spark, sf_dir):
    """Two random parents (with replacement) of the same cluster per synthetic slot."""
    from ..functions.rand import hash_uniform52
    tr = train(spark, sf_dir)
    n = tr.groupBy(CL).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 5")
    idx = S.row_index(tr.select(CL, "listing_id"), [CL], "listing_id", "_i")
    slots = idx.join(n, CL).select(CL, "_n", F.explode(F.sequence(
        F.col("_i") * 2, F.col("_i") * 2 + 1)).alias("slot"))
    key = [F.col(CL), F.col("slot"), F.lit(42)]
    slots = slots.select(CL, "slot",
                         F.floor(hash_uniform52(*key, "pa") * F.col("_n")).cast("long").alias("ia"),
                         F.floor(hash_uniform52(*key, "pb") * F.col("_n")).cast("long").alias("ib"))
    a = idx.select(CL, F.col("_i").alias("ia"), F.col("listing_id").alias("parent_a"))
    b = idx.select(CL, F.col("_i").alias("ib"), F.col("listing_id").alias("parent_b"))
    return slots.join(a, [CL, "ia"]).join(b, [CL, "ib"]).select(CL, "slot", "parent_a", "parent_b")


@query("real_estate_constraints", sql=oracle_with("listings") + """
, c AS (SELECT listing_id,
          CASE WHEN area_total > 300 THEN 300 WHEN area_total < 10 THEN 10 ELSE area_total END AS area_c,
          CASE WHEN round_even(floors_total, 0) > 100 THEN 100 WHEN round_even(floors_total, 0) < 1 THEN 1
               ELSE round_even(floors_total, 0) END AS floors_c,
          CASE WHEN round_even(floor, 0) > 100 THEN 100 WHEN round_even(floor, 0) < 1 THEN 1
               ELSE round_even(floor, 0) END AS floor_c,
          CASE WHEN round_even(build_year, 0) > 2026 THEN 2026 WHEN round_even(build_year, 0) < 1800 THEN 1800
               ELSE round_even(build_year, 0) END AS year_c,
          CASE WHEN kitchen_area < 3 THEN 3 ELSE kitchen_area END AS kitchen_c,
          CASE WHEN round_even(rooms, 0) > 10 THEN 10 WHEN round_even(rooms, 0) < 1 THEN 1
               ELSE round_even(rooms, 0) END AS rooms_c,
          CASE WHEN ceiling_height > 6.0 THEN 6.0 WHEN ceiling_height < 2.3 THEN 2.3 ELSE ceiling_height END AS ceil_c
        FROM listings)
SELECT listing_id, area_c AS area_total,
       CASE WHEN kitchen_c IS NULL OR area_c IS NULL THEN NULL ELSE least(kitchen_c, area_c * 0.6) END AS kitchen_area,
       CAST(rooms_c AS DOUBLE) AS rooms,
       CAST(CASE WHEN floor_c IS NULL OR floors_c IS NULL THEN NULL ELSE least(floor_c, floors_c) END AS DOUBLE) AS floor,
       CAST(floors_c AS DOUBLE) AS floors_total, CAST(ceil_c AS DOUBLE) AS ceiling_height,
       CAST(year_c AS DOUBLE) AS build_year,
       CAST(CASE WHEN floor_c IS NULL OR floors_c IS NULL THEN NULL ELSE least(floor_c, floors_c) END AS DOUBLE)
         / nullif(floors_c, 0) AS floor_ratio,
       CAST(2026 - year_c AS DOUBLE) AS house_age
FROM c""")
def q_real_estate_constraints(spark, sf_dir):
    """J7 / C21 / C22 applied to the raw listings."""
    l = X.listings(spark, sf_dir).select(
        "listing_id", "area_total", "kitchen_area",
        *[F.col(c).cast("double").alias(c) for c in ["rooms", "floor", "floors_total",
                                                     "build_year"]], "ceiling_height")
    return J.real_estate_constraints(l)


@query("nullify_geo", sql=oracle_with("listings") + """
SELECT listing_id, price, CAST(NULL AS DOUBLE) AS distance_to_center_km,
       CAST(NULL AS INTEGER) AS metro_walk_min, CAST(NULL AS VARCHAR) AS metro,
       'synthetic' AS link FROM listings""")
def q_nullify_geo(spark, sf_dir):
    """Geo-dependent columns set to NULL with their types kept, link='synthetic'."""
    from ..functions.geo import center_distance_km
    l = X.listings(spark, sf_dir).select(
        "listing_id", "price", center_distance_km("latitude", "longitude").alias("distance_to_center_km"),
        F.lit(5).alias("metro_walk_min"), F.lit("st_1").alias("metro"), "link")
    return nullify_geo(l)


@query("train_augmented", sql=SYNTH_SQL + f"""
SELECT listing_id, {CL}, is_synthetic, generation_method, parent_geo_cluster,
       {sig_sql('price', 10)} AS price FROM train_augmented""")
def q_train_augmented(spark, sf_dir):
    """J8 + I1: originals marked and stacked with the synthetic rows."""
    return augmented(spark, sf_dir).select("listing_id", CL, "is_synthetic", "generation_method",
                                           "parent_geo_cluster", sig("price", 10).alias("price"))


@query("cluster_report", sql=_PREP + f"""
, n AS (SELECT {CL}, count(*) AS n FROM train GROUP BY {CL})
SELECT {CL}, CASE WHEN n >= 5 THEN 3 * n ELSE n END AS total_rows,
       CASE WHEN n >= 5 THEN 2 * n ELSE 0 END AS synthetic_rows, n AS original_rows FROM n""")
def q_cluster_report(spark, sf_dir):
    """per cluster total / synthetic / original rows (synthetic = 2 x original for
    clusters of at least 5 rows - checked against counts, not against a replay)."""
    return J.cluster_report(augmented(spark, sf_dir))


@query("augment_noisy_copies", sql=_PREP + f"""
, st AS (SELECT {CL} AS cl, count(*) AS n, stddev_samp(area_total) AS s_area,
                stddev_samp(ceiling_height) AS s_ceil, stddev_samp(kitchen_area) AS s_kitchen
         FROM train GROUP BY {CL} HAVING count(*) >= 5),
cp AS (SELECT t.*, st.*, unnest(range(1, 3)) AS copy FROM train t JOIN st ON t.{CL} = st.cl)
SELECT listing_id, 0 AS augmentation_copy, {sig_sql('latitude', 10)} AS latitude,
       {sig_sql('area_total', 10)} AS area_total FROM train
UNION ALL
SELECT listing_id, CAST(copy AS INTEGER) AS augmentation_copy,
       {sig_sql("latitude + " + hash_normal_sql("listing_id", "CAST(copy AS VARCHAR)", "'42'", "'lat'") + " * " + repr(80 / 111000), 10)},
       {sig_sql("CASE WHEN s_area IS NOT NULL AND s_area > 0 THEN area_total + " + hash_normal_sql("listing_id", "CAST(copy AS VARCHAR)", "'42'", "'c_area_total'") + " * s_area * 0.01 ELSE area_total END", 10)}
FROM cp""")
def q_augment_noisy_copies(spark, sf_dir):
    """Originals plus two noisy copies per row of every cluster with >= 5 rows."""
    aug = J.augment_noisy_copies(train(spark, sf_dir), CL)
    return aug.select("listing_id", "augmentation_copy", sig("latitude", 10).alias("latitude"),
                      sig("area_total", 10).alias("area_total"))


_GEO_DIMS_SQL = oracle_with("stations", "poi", "ring").strip().removeprefix("WITH ")
_NEAR_SQL = "CAST(metro_walk_min <= 15 AS INTEGER) AS has_metro_near"
_STACK = ["listing_id", "price", "area_total", CL, "is_synthetic", "generation_method"]


@query("reenrich_synthetic", sql=SYNTH_SQL + ", " + _GEO_DIMS_SQL + ", " + geo_ctes("synthetic").strip() + f"""
SELECT listing_id, {", ".join(GEO_COLS)}, {_NEAR_SQL} FROM geo""")
def q_reenrich_synthetic(spark, sf_dir):
    """Synthetic rows without coordinates dropped, then station, centre, ring and POI distances
    and the address computed again, and the flag of a near station."""
    dims, kw = geo_dims(spark, sf_dir)
    out = reenrich(J.synth_interpolate(train(spark, sf_dir)), *dims, **kw)
    return out.select("listing_id", *GEO_COLS, "has_metro_near")


@query("final_augmented", sql=SYNTH_SQL + f""", stacked AS (
  SELECT listing_id, price, area_total, {CL}, is_synthetic, generation_method, latitude, longitude FROM originals
  UNION ALL SELECT listing_id, price, area_total, {CL}, is_synthetic, generation_method, latitude, longitude FROM synthetic), """
       + _GEO_DIMS_SQL + ", " + geo_ctes("stacked").strip() + f"""
SELECT listing_id, {sig_sql("price", 10)} AS price, {sig_sql("area_total", 10)} AS area_total, {CL}, is_synthetic,
       generation_method, {", ".join(f"geo.{c}" for c in GEO_COLS)}, {_NEAR_SQL}
FROM stacked JOIN geo USING (listing_id)""")
def q_final_augmented(spark, sf_dir):
    """The enriched training rows stacked with the re-enriched synthetic rows of J10."""
    from ..session import stored
    dims, kw = geo_dims(spark, sf_dir)
    tr = stored(train(spark, sf_dir))
    orig = enrich_listings(J.mark_original(tr), *dims, **kw).withColumn("has_metro_near", metro_near_flag("metro_walk_min"))
    out = orig.unionByName(reenrich(J.synth_interpolate(tr, cheap=True), *dims, **kw), allowMissingColumns=True)
    return out.select(*[sig(c, 10).alias(c) if c in ("price", "area_total") else F.col(c) for c in _STACK],
                      *GEO_COLS, "has_metro_near")


# ------------------------------------------------------------------ before / after checks
def _long_sql(src: str, tag: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, '{tag}' AS s FROM {src}"
        for c in CLEAN_NUM)


def _ks_pvalue_sql(d: str, na: str, nb: str, terms: int = 100) -> str:
    en = f"sqrt({na} * {nb} / CAST({na} + {nb} AS DOUBLE))"
    lam = f"(({en} + 0.12 + 0.11 / {en}) * {d})"
    s = " + ".join(f"{2.0 * (-1) ** (j - 1)!r} * exp({-2.0 * j * j!r} * {lam} * {lam})"
                   for j in range(1, terms + 1))
    return f"(CASE WHEN {lam} < 1e-3 THEN 1.0 ELSE least(greatest({s}, 0.0), 1.0) END)"


_DIST_SQL = SYNTH_SQL + f"""
, lo AS ({_long_sql('train', 'a')}), la AS ({_long_sql('train_augmented', 'b')}),
both_ AS (SELECT * FROM lo UNION ALL SELECT * FROM la),
mo AS (SELECT feature, avg(value) AS orig_mean, stddev_samp(value) AS orig_std, min(value) AS orig_min,
              max(value) AS orig_max, count(value) AS na FROM lo GROUP BY feature),
ma AS (SELECT feature, avg(value) AS aug_mean, stddev_samp(value) AS aug_std, min(value) AS aug_min,
              max(value) AS aug_max, count(value) AS nb FROM la GROUP BY feature),
v AS (SELECT feature, value, count(*) FILTER (WHERE s = 'a') AS ca, count(*) FILTER (WHERE s = 'b') AS cb
      FROM both_ WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (SELECT feature, sum(ca) OVER w AS cum_a, sum(cb) OVER w AS cum_b FROM v
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT c.feature, max(abs(c.cum_a / mo.na - c.cum_b / ma.nb)) AS ks_statistic, any_value(mo.na) AS na,
              any_value(ma.nb) AS nb
       FROM cum c JOIN mo USING (feature) JOIN ma USING (feature) GROUP BY c.feature)
"""


@query("distribution_compare", sql=_DIST_SQL + f"""
SELECT feature, {sig_sql('orig_mean')} AS orig_mean, {sig_sql('aug_mean')} AS aug_mean,
       round((aug_mean - orig_mean) * 100 / abs(orig_mean), 9) AS mean_diff_pct,
       {sig_sql('orig_std')} AS orig_std, {sig_sql('aug_std')} AS aug_std,
       round((aug_std - orig_std) * 100 / abs(orig_std), 9) AS std_diff_pct,
       {sig_sql('orig_min')} AS orig_min, {sig_sql('aug_min')} AS aug_min,
       {sig_sql('orig_max')} AS orig_max, {sig_sql('aug_max')} AS aug_max,
       {sig_sql('ks_statistic')} AS ks_statistic,
       round({_ks_pvalue_sql('ks_statistic', 'ks.na', 'ks.nb')}, 12) AS ks_pvalue
FROM mo JOIN ma USING (feature) JOIN ks USING (feature)""")
def q_distribution_compare(spark, sf_dir):
    """F14 + F15: original train vs augmented set per feature (means, stds, ranges,
    relative differences, two-sample KS statistic and asymptotic p-value)."""
    d = S.distribution_compare(*numbers_compared(spark, sf_dir), CLEAN_NUM, cheap=True)
    fixed = {"mean_diff_pct": 9, "std_diff_pct": 9, "ks_pvalue": 12}
    return d.select("feature", *[(rnd(c, fixed[c]) if c in fixed else sig(c, 9)).alias(c)
                                 for c in d.columns if c != "feature"])


@query("ks_two_sample", sql=_DIST_SQL + f"""
SELECT feature, {sig_sql('ks_statistic')} AS ks_statistic, na AS n_a, nb AS n_b FROM ks""")
def q_ks_two_sample(spark, sf_dir):
    """F15 + G5: KS statistic per feature via distributed ECDFs."""
    from ..operators.ranks import ks_columns
    ks = ks_columns(*numbers_compared(spark, sf_dir), CLEAN_NUM)
    return ks.select("feature", sig("ks_statistic").alias("ks_statistic"), "n_a", "n_b")


@query("corr_matrix_join", sql=SYNTH_SQL + " , ca AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, corr({a}, {b}) AS c FROM train"
    for i, a in enumerate(CLEAN_NUM) for b in CLEAN_NUM[i + 1:]) + "), cb AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, corr({a}, {b}) AS c FROM train_augmented"
    for i, a in enumerate(CLEAN_NUM) for b in CLEAN_NUM[i + 1:]) + f""")
SELECT feature_x, feature_y, {sig_sql('ca.c', 6)} AS corr_a, {sig_sql('cb.c', 6)} AS corr_b,
       round(cb.c - ca.c, 6) AS corr_diff
FROM ca JOIN cb USING (feature_x, feature_y)""")
def q_corr_matrix_join(spark, sf_dir):
    """Correlation matrix difference augmented - original (upper triangle)."""
    tr, aug = train_and_augmented(spark, sf_dir)
    a = S.corr_matrix(tr, CLEAN_NUM)
    b = S.corr_matrix(aug, CLEAN_NUM)
    d = S.corr_diff(a, b)
    pos = {c: i for i, c in enumerate(CLEAN_NUM)}
    keep = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    d = d.where(keep[F.col("feature_x")] < keep[F.col("feature_y")])
    return d.select("feature_x", "feature_y", sig("corr_a", 6).alias("corr_a"),
                    sig("corr_b", 6).alias("corr_b"), rnd("corr_diff", 6).alias("corr_diff"))


@query("only_synthetic", sql=SYNTH_SQL + f"""
SELECT {CL}, count(*) AS n FROM train_augmented WHERE is_synthetic = 1 GROUP BY {CL}""")
def q_only_synthetic(spark, sf_dir):
    """Synthetic rows only (per-cluster counts)."""
    from ..operators.filters import only_synthetic
    return only_synthetic(augmented(spark, sf_dir)).groupBy(CL).agg(F.count(F.lit(1)).alias("n"))


# Lattice paths as a recursion over i + j, one list of shares per cluster.
_PATHS_SQL = """
, sizes AS (SELECT cl, ks, least(n_a, n_b) AS m, greatest(n_a, n_b) AS n,
                   CAST(round(ks * n_a * n_b) AS BIGINT) AS h FROM d WHERE greatest(n_a, n_b) <= 10000 AND least(n_a, n_b) > 0),
paths AS (
  SELECT cl, m, n, h, 0 AS k, list_transform(range(0, m + 1), lambda i: 0.0::DOUBLE) AS out FROM sizes
  UNION ALL
  SELECT cl, m, n, h, k + 1, list_transform(range(0, m + 1), lambda i:
           CASE WHEN k + 1 - i < 0 OR k + 1 - i > n THEN 0.0
                WHEN abs(i * n - (k + 1 - i) * m) >= h THEN 1.0
                ELSE (out[i + 1] * (k + 1 - i) + CASE WHEN i > 0 THEN out[i] * i ELSE 0.0 END) / (k + 1) END)
  FROM paths WHERE k < m + n),
exact AS (SELECT cl, least(1.0, out[m + 1]) AS p FROM paths WHERE k = m + n)"""


@query("ks_split_by_cluster", sql=_PREP.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, v AS (SELECT {CL} AS cl, price_per_m2 AS x, split = 'train' AS a FROM splitted),
e AS (SELECT cl, x, sum(CAST(a AS INTEGER)) AS na, sum(CAST(NOT a AS INTEGER)) AS nb FROM v GROUP BY ALL),
c AS (SELECT cl, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY cl) AS ta, sum(nb) OVER (PARTITION BY cl) AS tb
      FROM e WINDOW w AS (PARTITION BY cl ORDER BY x)),
d AS (SELECT cl, max(abs(ca / ta - cb / tb)) AS ks, CAST(any_value(ta) AS BIGINT) AS n_a, CAST(any_value(tb) AS BIGINT) AS n_b
      FROM c WHERE ta > 0 AND tb > 0 GROUP BY cl)""" + _PATHS_SQL + f"""
SELECT d.cl AS {CL}, n_a, n_b, {sig_sql("ks", 9)} AS ks_statistic,
       {sig_sql("coalesce(exact.p, " + _ks_pvalue_sql("ks", "n_a", "n_b") + ")", 6)} AS ks_pvalue
FROM d LEFT JOIN exact ON exact.cl = d.cl""")
def q_ks_split_by_cluster(spark, sf_dir):
    """prices per square metre of the training and test rows compared in each
    cluster: D with the exact p-value of small samples, the asymptotic one of large samples."""
    from ..operators.ranks import ks_pvalue_of, ks_statistic
    from ..session import cut_lineage, ship_package
    ship_package(spark)
    s = cut_lineage(split(spark, sf_dir).select(CL, "price_per_m2", "split"))
    found = ks_statistic(s.where("split = 'train'"), s.where("split = 'test'"), [CL], "price_per_m2").where("n_a > 0 and n_b > 0")
    p = ks_pvalue_of(F.col("ks_statistic"), F.col("n_a"), F.col("n_b"))
    return found.select(CL, "n_a", "n_b", sig("ks_statistic", 9).alias("ks_statistic"), p.alias("p")).select(
        CL, "n_a", "n_b", "ks_statistic", sig("p", 6).alias("ks_pvalue"))
