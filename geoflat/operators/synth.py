"""Split, synthesis and augmentation.

All randomness is a pure function of row keys (``functions.rand``), so results do not
depend on partitioning, retries or the number of executors, and the DuckDB oracle can
replay them. The per-cluster loops of the reference become keyed joins:

* slots are generated *by the rows* (row i of a cluster emits slots 2i and 2i+1), so a
  hot cluster's slots are spread exactly like its rows - never exploded from one row;
* parents are found by an equi-join on (cluster, row index); the index comes from the
  distributed cumulative count, not from a per-cluster window;
* cluster statistics (bbox, sample std, exact q01/q99) are one aggregate per cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import meters_to_degrees
from ..functions.numeric import clip, min_strict
from ..functions.rand import hash_beta22, hash_normal, hash_u64, hash_uniform, hash_uniform52
from ..session import bounded_row_count, cut_lineage, stored
from .projection import columns_by_keyword, nullify_geo, present
from .ranks import exact_quantiles, value_at_rank
from .stats import row_index

# Synthesis parameters of the reference pipeline.
SEED = 42
TEST_SIZE = 0.2
SYNTHETIC_MULTIPLIER = 2
COORD_JITTER_METERS = 35
MIN_CLUSTER_SIZE = 5
NOISE_SHARE = 0.03
CONTINUOUS_COLS = ["area_total", "kitchen_area", "ceiling_height"]
INTEGER_COLS = ["rooms", "floor", "floors_total", "build_year"]
CATEGORICAL_COLS = ["source_group", "renovation", "walls", "floor_position", "elevator", "yard",
                    "parking", "playground"]
AS_OF_YEAR = 2026


def split_key(id_col: str, seed: int = SEED) -> Column:
    return hash_u64(F.col(id_col), "split", seed)


def train_test_split(df: DataFrame, id_col: str, test_size: float = TEST_SIZE,
                     seed: int = SEED) -> DataFrame:
    """Exact split - the ceil(test_size * n) rows with the smallest (hash, id) are the
    test set. The threshold is found by distributed rank selection (no global sort in one
    task); adds ``split`` = 'train' | 'test'."""
    keyed = df.withColumn("_sk", F.struct(split_key(id_col, seed).alias("h"),
                                          F.col(id_col).alias("id")))
    th = value_at_rank(keyed, F.col("_sk"), F.col("_sk")["h"], lambda n: max(0, math.ceil(n * test_size) - 1))
    out = keyed.crossJoin(F.broadcast(th.select(F.col("value").alias("_th"))))
    return out.withColumn("split", F.when(F.col("_sk") <= F.col("_th"), "test")
                          .otherwise("train")).drop("_sk", "_th")


def real_estate_constraints(df: DataFrame, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """J7 (C21 + C22): clamp to plausible ranges, round the integer-like columns,
    floor <= floors_total, recompute floor_ratio and house_age."""
    c = F.col
    out = {}
    cols = set(df.columns)
    if "area_total" in cols:
        out["area_total"] = clip(c("area_total"), 10, 300)
    if "kitchen_area" in cols:
        k = clip(c("kitchen_area"), 3, None)
        out["kitchen_area"] = min_strict(k, out.get("area_total", c("area_total")) * 0.6) \
            if "area_total" in cols else k
    for name, lo, hi in [("rooms", 1, 10), ("floor", 1, 100), ("floors_total", 1, 100)]:
        if name in cols:
            out[name] = clip(F.rint(c(name)), lo, hi)
    if {"floor", "floors_total"} <= cols:
        out["floor"] = min_strict(out["floor"], out["floors_total"])
    if "ceiling_height" in cols:
        out["ceiling_height"] = clip(c("ceiling_height"), 2.3, 6.0)
    if "build_year" in cols:
        out["build_year"] = clip(F.rint(c("build_year")), 1800, as_of_year)
    df = df.withColumns(out)
    extra = {}
    if {"floor", "floors_total"} <= cols:
        extra["floor_ratio"] = F.try_divide(c("floor"), c("floors_total"))
    if "build_year" in cols:
        extra["house_age"] = F.lit(as_of_year) - c("build_year")
    return df.withColumns(extra) if extra else df


def synth_interpolate(train: DataFrame, cluster: str = "geo_generation_cluster",
                      id_col: str = "listing_id", seed: int = SEED,
                      multiplier: int = SYNTHETIC_MULTIPLIER,
                      jitter_m: float = COORD_JITTER_METERS,
                      min_size: int = MIN_CLUSTER_SIZE, cheap: bool = False) -> DataFrame:
    """J2-J6 + J7 + B11 + B8: ``multiplier`` synthetic rows per training row of every
    cluster with at least ``min_size`` rows, interpolated between two random parents of
    the same cluster. ``train`` is stored first, as it is read several times, unless it is ``cheap``
    to read again."""
    jit = float(jitter_m) / 111_000
    tr = train.where(F.col(cluster).isNotNull())
    cont = present(tr, CONTINUOUS_COLS)
    ints = present(tr, INTEGER_COLS)
    cats = present(tr, CATEGORICAL_COLS)
    has_price = {"price_per_m2", "price", "area_total"} <= set(tr.columns)

    # cluster statistics: one aggregate + exact quantiles of price per m2
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("latitude").alias("_lat_min"),
            F.max("latitude").alias("_lat_max"), F.min("longitude").alias("_lon_min"),
            F.max("longitude").alias("_lon_max")]
    aggs += [F.stddev_samp(c).alias(f"_std_{c}") for c in cont]
    if has_price:
        aggs.append(F.stddev_samp("price_per_m2").alias("_std_price_per_m2"))
    tr = tr if cheap else stored(tr)
    stats = tr.groupBy(cluster).agg(*aggs).where(F.col("_n") >= min_size)
    if has_price:
        q = exact_quantiles(tr, [cluster], "price_per_m2", {"_q01": 0.01, "_q99": 0.99}, cheap=True)
        stats = stats.join(q, cluster, "left")
    stats = cut_lineage(stats)
    if bounded_row_count(stats) is not None:
        stats = F.broadcast(stats)

    # row index inside the cluster, built once, then every row emits `multiplier` slots
    idx = row_index(tr, [cluster], id_col, "_i")
    slots = (idx.join(stats.select(cluster, "_n"), cluster)
             .select(cluster, "_n",
                     F.explode(F.sequence(F.col("_i") * multiplier,
                                          F.col("_i") * multiplier + multiplier - 1)).alias("slot")))
    whole = F.concat_ws("|", F.col(cluster).cast("string"), F.col("slot").cast("string"), F.lit(str(seed)))
    key = [F.col("_key")]  # the start of every hashed text, written once a slot
    slots = slots.withColumn("_key", whole).select(
        cluster, "slot",
        F.floor(hash_uniform52(*key, "pa") * F.col("_n")).cast("long").alias("_ia"),
        F.floor(hash_uniform52(*key, "pb") * F.col("_n")).cast("long").alias("_ib"))
    pa = idx.select(*[F.col(c).alias(f"a_{c}") for c in idx.columns])
    pb = idx.select(*[F.col(c).alias(f"b_{c}") for c in idx.columns])
    j = (slots.join(pa, (F.col(cluster) == F.col(f"a_{cluster}")) & (F.col("_ia") == F.col("a__i")))
         .join(pb, (F.col(cluster) == F.col(f"b_{cluster}")) & (F.col("_ib") == F.col("b__i")))
         .join(stats, cluster))

    lam = hash_beta22(*key, "lam")
    j = j.withColumn("_key", whole).withColumn("_lam", lam)
    L = F.col("_lam")
    mix = lambda c: L * F.col(f"a_{c}") + (1 - L) * F.col(f"b_{c}")

    def noise(std_col: str, salt: str) -> Column:
        s = F.col(std_col)
        return F.when(s.isNotNull() & (s > 0), hash_normal(*key, salt) * s * NOISE_SHARE) \
            .otherwise(F.lit(0.0))

    out = {}
    for c in train.columns:
        out[c] = F.col(c) if c == cluster else F.col(f"a_{c}")
    lat = mix("latitude") + hash_normal(*key, "jlat") * jit
    lon = mix("longitude") + hash_normal(*key, "jlon") * jit
    out["latitude"] = F.least(F.greatest(lat, F.col("_lat_min") - 2 * jit), F.col("_lat_max") + 2 * jit)
    out["longitude"] = F.least(F.greatest(lon, F.col("_lon_min") - 2 * jit), F.col("_lon_max") + 2 * jit)
    for c in cont:
        out[c] = mix(c) + noise(f"_std_{c}", f"n_{c}")
    for c in ints:
        out[c] = F.rint(mix(c))
    coin = hash_uniform(*key, "coin") < L
    for c in cats:
        out[c] = F.when(coin, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    if has_price:
        ppm2 = mix("price_per_m2") + noise("_std_price_per_m2", "n_ppm2")
        ppm2 = F.least(F.greatest(ppm2, F.col("_q01")), F.col("_q99"))
        out["price_per_m2"] = ppm2
    out[id_col] = F.concat(F.lit("syn-"), F.col(cluster).cast("string"), F.lit("-"),
                           F.col("slot").cast("string"))
    synth = j.select(*[out[c].alias(c) for c in train.columns])
    if has_price:
        synth = synth.withColumn("price", F.col("price_per_m2") * F.col("area_total"))
    synth = real_estate_constraints(synth)
    if has_price:
        synth = synth.withColumn("price_per_m2", F.try_divide(F.col("price"), F.col("area_total")))
    synth = nullify_geo(synth)
    return synth.withColumns({
        "is_synthetic": F.lit(1),
        "generation_method": F.lit("geo_cluster_interpolation"),
        "parent_geo_cluster": F.col(cluster),
    })


def mark_original(train: DataFrame, cluster: str = "geo_generation_cluster") -> DataFrame:
    """Originals tagged is_synthetic=0, method 'original', parent = own cluster."""
    return train.withColumns({"is_synthetic": F.lit(0), "generation_method": F.lit("original"),
                              "parent_geo_cluster": F.col(cluster)})


def cluster_report(augmented: DataFrame, cluster: str = "geo_generation_cluster") -> DataFrame:
    """per cluster total rows, synthetic rows, original rows."""
    return augmented.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum("is_synthetic").cast("long").alias("synthetic_rows")).withColumn(
        "original_rows", F.col("total_rows") - F.col("synthetic_rows"))


# Noisy-copy augmentation parameters.
COPIES_PER_CLUSTER = 2
COORD_NOISE_METERS = 80
DISTANCE_NOISE = 0.03
CONTINUOUS_NOISE = 0.01


def augment_noisy_copies(train: DataFrame, cluster: str, id_col: str = "listing_id",
                         copies: int = COPIES_PER_CLUSTER, seed: int = SEED,
                         target: str = "price") -> DataFrame:
    """Originals + ``copies`` noisy copies of every row of clusters with >= 5 rows:
    coordinates + N(0, 80 m), distance-like x N(1, 3 %) clipped at 0, continuous
    + N(0, 1 % of the cluster std); target, integer-like and text untouched."""
    groups = columns_by_keyword(train, exclude=["latitude", "longitude", cluster, target])
    dist, contc = groups["distance"], groups["continuous"]
    stats = train.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"),
                                       *[F.stddev_samp(c).alias(f"_std_{c}") for c in contc])
    stats = cut_lineage(stats.where(F.col("_n") >= 5))
    # a broadcast leaves the rows of a hot cluster where they are
    base = train.join(stats if bounded_row_count(stats) is None else F.broadcast(stats), cluster)
    cp = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("augmentation_copy"))
    key = [F.col(id_col), F.col("augmentation_copy"), F.lit(seed)]
    deg = COORD_NOISE_METERS / 111_000
    out = {"latitude": F.col("latitude") + hash_normal(*key, "lat") * deg,
           "longitude": F.col("longitude") + hash_normal(*key, "lon") * deg}
    for c in dist:
        v = F.col(c) * (1 + hash_normal(*key, f"d_{c}") * DISTANCE_NOISE)
        out[c] = F.when(v < 0, F.lit(0.0)).otherwise(v)
    for c in contc:
        s = F.col(f"_std_{c}")
        out[c] = F.when(s.isNotNull() & (s > 0),
                        F.col(c) + hash_normal(*key, f"c_{c}") * s * CONTINUOUS_NOISE).otherwise(F.col(c))
    syn = cp.withColumns(out).select(*train.columns, "augmentation_copy").withColumn(
        "is_synthetic", F.lit(1))
    orig = train.withColumns({"is_synthetic": F.lit(0), "augmentation_copy": F.lit(0)})
    return orig.unionByName(syn, allowMissingColumns=True)


_ = meters_to_degrees
