"""Aggregations and distribution checks.

Many-column statistics are always ONE aggregate with many expressions followed by an
unpivot - never a loop of actions over columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import bounded_row_count, cut_lineage, ship_package, stored
from .ranks import column_quantiles, cumulative_counts, exact_quantiles, ks_columns, ks_pvalue


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL group is still a group)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                       for c in right.columns])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, col: str, dropna: bool = True, top: int | None = None,
                 by_key: bool = False) -> DataFrame:
    """Frequency per value, descending (key as tie-break) or by key."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    out = d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if by_key:
        return out.orderBy(F.col(col).asc_nulls_first())
    out = out.orderBy(F.col("count").desc(), F.col(col).asc_nulls_first())
    return out.limit(top) if top else out


def group_median(df: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """exact median of ``value`` per non-NULL ``key``."""
    return exact_quantiles(df.where(F.col(key).isNotNull()), [key], value, {name: 0.5})


def missing_report(df: DataFrame, top: int | None = None) -> DataFrame:
    """NULL count and percentage per column (one aggregate + unpivot), sorted desc
    with the column name as tie-break."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "column", "missing")
    out = long.select("column", "missing",
                      (F.col("missing") * 100.0 / F.col("_n")).alias("missing_pct"))
    out = out.orderBy(F.col("missing").desc(), F.col("column"))
    return out.limit(top) if top else out


def fill_rate(df: DataFrame) -> DataFrame:
    """non-NULL count per column."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "non_null")


def group_median_impute(df: DataFrame, key: str, col: str, null_key: str = "global") -> DataFrame:
    """NULL -> median of the key group, then the global median of the result.
    ``null_key='global'`` reproduces the reference quirk: rows whose key is NULL get NULL
    from the group step, so even their known values are replaced by the global median."""
    med = cut_lineage(exact_quantiles(df.where(F.col(key).isNotNull()), [key], col, {"_gm": 0.5}))
    j = df.join(med if bounded_row_count(med) is None else F.broadcast(med), key, "left")
    if null_key == "global":
        step = F.when(F.col(key).isNull(), F.lit(None).cast("double")).otherwise(
            F.coalesce(F.col(col).cast("double"), F.col("_gm")))
    else:
        step = F.coalesce(F.col(col).cast("double"), F.col("_gm"))
    j = j.withColumn(col, step).drop("_gm")
    glob = exact_quantiles(j, [], col, {"_glob": 0.5})
    return (j.crossJoin(F.broadcast(glob))
            .withColumn(col, F.coalesce(F.col(col), F.col("_glob"))).drop("_glob"))


# The describe rows, in pandas order.
DESCRIBE_PCTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
DESCRIBE_PCTS_WIDE = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75,
                      "p95": 0.95, "p99": 0.99}


def _moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature count, mean, std (sample), min and max, from one row of aggregates."""
    v = {c: F.col(c).cast("double") for c in cols}
    wide = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(f"_{i}")
                    for i, (c, x) in enumerate(v.items())])
    return wide.select(F.explode(F.array(*[f"_{i}" for i in range(len(cols))])).alias("_m")).select("_m.*")


def describe(df: DataFrame, cols: list[str], pcts: dict[str, float] = DESCRIBE_PCTS) -> DataFrame:
    """per feature count, mean, std (sample), min, exact percentiles, max."""
    moments = _moments(df, cols)
    q = column_quantiles(df, [], cols, pcts).withColumnRenamed("_feature", "feature")
    return moments.join(q, "feature", "left").select(
        "feature", "count", "mean", "std", "min", *pcts, "max")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """pairwise-complete Pearson for every ordered pair (long form), the p(p-1)/2 distinct pairs
    mirrored; the diagonal is 1 where defined. Each task sums the products of its rows by matrix
    products, and the few sums of the tasks are merged pair by pair."""
    spark = df.sparkSession
    ship_package(spark)
    sums = "n double, x double, y double, xx double, yy double, xy double"
    d = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    size = len(cols)

    def part(batches):
        yield pair_sums(batches, size)

    merged = d.mapInArrow(part, "i int, j int, " + sums).groupBy("i", "j").applyInArrow(
        merged_corr, "i int, j int, corr double")
    pairs = spark.createDataFrame([(i, j, cols[i], cols[j]) for i in range(size) for j in range(i, size)],
                                  "i int, j int, feature_x string, feature_y string")
    upper = F.broadcast(pairs).join(merged, ["i", "j"], "left").select("feature_x", "feature_y", "corr")
    sides = F.when(F.col("feature_x") == F.col("feature_y"), F.array(F.struct("feature_x", "feature_y"))).otherwise(
        F.array(F.struct("feature_x", "feature_y"), F.struct(F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"))))
    return upper.select(F.explode(sides).alias("_s"), "corr").select("_s.*", "corr")


def pair_sums(batches, size: int) -> pa.RecordBatch:
    """For each two of ``size`` columns, over the rows where both are known: their number, the two means and
    the centred sums of squares and products. Values are taken from the first known one of each column,
    so large means cost no digits."""
    start = np.full(size, np.nan)
    s = np.zeros((5, size, size))
    for b in batches:
        known = np.stack([np.asarray(c.is_valid()) for c in b.columns], axis=1).astype(np.float64)
        x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
        for k in np.flatnonzero(np.isnan(start)):
            if known[:, k].any():
                start[k] = x[known[:, k].argmax(), k]
        x = (x - np.nan_to_num(start)) * known
        s += np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, x.T @ x])
    up = np.triu_indices(size)
    n, x, y, xx, xy = (m[up] for m in s)
    yy = s[3].T[up]
    at = np.maximum(n, 1.0)
    base = np.nan_to_num(start)
    out = [n, base[up[0]] + x / at, base[up[1]] + y / at, xx - x * x / at, yy - y * y / at, xy - x * y / at]
    return pa.RecordBatch.from_arrays([pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), *map(pa.array, out)],
                                      ["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def merged_corr(rows: pa.Table) -> pa.Table:
    """The correlation of one pair of columns from the sums of all tasks; null unless both vary."""
    n, x, y, xx, yy, xy = (rows.column(c).to_numpy() for c in ("n", "x", "y", "xx", "yy", "xy"))
    corr = None
    if n.sum() > 1:
        dx, dy = x - n @ x / n.sum(), y - n @ y / n.sum()
        xx, yy, xy = xx.sum() + n @ (dx * dx), yy.sum() + n @ (dy * dy), xy.sum() + n @ (dx * dy)
        if xx > 0 and yy > 0:
            corr = 1.0 if rows.column("i")[0] == rows.column("j")[0] else float(xy / np.sqrt(xx * yy))
    return pa.table({"i": rows.column("i").slice(0, 1), "j": rows.column("j").slice(0, 1), "corr": pa.array([corr], pa.float64())})


def corr_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise difference of two long-form correlation matrices."""
    return (a.withColumnRenamed("corr", "corr_a")
            .join(b.withColumnRenamed("corr", "corr_b"), ["feature_x", "feature_y"], "full")
            .select("feature_x", "feature_y", "corr_a", "corr_b",
                    (F.col("corr_b") - F.col("corr_a")).alias("corr_diff")))


def distribution_compare(orig: DataFrame, aug: DataFrame, cols: list[str], cheap: bool = False) -> DataFrame:
    """F14 + F15: per feature mean/std/min/max in both sets, relative differences (%),
    and the two-sample KS statistic with its asymptotic p-value. Both sets are stored first, as they are
    read several times, unless they are ``cheap`` to read again."""
    if not cheap:
        orig, aug = (stored(d.select(*[F.col(c).cast("double").alias(c) for c in cols])) for d in (orig, aug))

    def moments(df, p):
        return _moments(df, cols).select("feature", *[F.col(c).alias(f"{p}_{c}") for c in ("mean", "std", "min", "max")])
    mo, ma = moments(orig, "orig"), moments(aug, "aug")
    ks = ks_columns(orig, aug, cols)
    out = mo.join(ma, "feature", "full").join(ks, "feature", "left")
    pct = lambda a, b: F.try_divide((F.col(b) - F.col(a)) * 100.0, F.abs(F.col(a)))
    return out.select(
        "feature", "orig_mean", "aug_mean", pct("orig_mean", "aug_mean").alias("mean_diff_pct"),
        "orig_std", "aug_std", pct("orig_std", "aug_std").alias("std_diff_pct"),
        "orig_min", "aug_min", "orig_max", "aug_max", "ks_statistic",
        ks_pvalue(F.col("ks_statistic"), F.col("n_a"), F.col("n_b")).alias("ks_pvalue"))


def negative_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """F16: numeric columns with at least one negative value and their count."""
    wide = df.agg(*[F.sum((F.col(c) < 0).cast("long")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "negatives")
    return long.where(F.col("negatives") > 0)


def histogram(df: DataFrame, cols: list[str], bins: int = 40) -> DataFrame:
    """equal-width bins on each column's own min..max, the last bin closed; all bins
    listed (empty -> 0) with count and density n / (N * width)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value").where(F.col("value").isNotNull())
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                      F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = (F.when(F.col("hi") == F.col("lo"), F.lit(1))
         .otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width) + 1, F.lit(bins))))
    counted = (long.join(F.broadcast(rng), "feature")
               .select("feature", b.cast("int").alias("bin"))
               .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("feature", "lo", "hi", "n",
                      F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    w = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(width)
    return (grid.join(counted, ["feature", "bin"], "left")
            .select("feature", "bin",
                    (F.col("lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * w).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    (F.coalesce(F.col("count"), F.lit(0)) / (F.col("n") * w)).alias("density")))


def box_stats(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """q1, median, q3, whiskers at the most extreme points within 1.5 IQR, outliers."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    base = df.where(F.col(value).isNotNull())
    j = null_safe_join(base, q, keys) if keys else base.crossJoin(F.broadcast(q))
    v = F.col(value)
    inside = (v >= lo_f) & (v <= hi_f)
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("outliers"))


def cluster_stats(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """E10 (stats part): per cluster min/max/sample std of the listed columns."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(cluster).agg(*aggs)


def row_index(df: DataFrame, keys: list[str], order_col: str, name: str = "row_idx") -> DataFrame:
    """0-based position inside the group by ``order_col``. Null keys are a group; rows that
    share a value take consecutive positions; a null value has no position. Rows are sorted in
    ranges and stored once; a range's place in its group comes from the counts of earlier ranges,
    so no task holds a group."""
    by = [*keys, order_col]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = stored(df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                   .withColumn("_at", F.monotonically_increasing_id()))  # partition, then row in it
    part = F.shiftright("_at", 33)
    chunks = lines.groupBy(part.alias("_o_part"), *[F.col(k).alias(f"_o_{k}") for k in keys]).agg(
        F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"), F.count(order_col).alias("_known"))
    group = W.partitionBy(*[f"_o_{k}" for k in keys])
    before = F.sum("_known").over(group.orderBy("_o_part").rowsBetween(W.unboundedPreceding, -1))
    starts = cut_lineage(chunks.select(
        "_o_part", *[f"_o_{k}" for k in keys], F.sum("_known").over(group).alias(f"{name}_n"),
        # null values come first in a chunk
        (F.coalesce(before, F.lit(0)) - F.col("_low") - (F.col("_rows") - F.col("_known"))).alias("_shift")))
    on = part == F.col("_o_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    placed = lines.join(starts if bounded_row_count(starts) is None else F.broadcast(starts), on)
    known = F.col(order_col).isNotNull()
    return placed.select(*df.columns, F.when(known, F.col("_at") + F.col("_shift")).alias(name),
                         F.when(known, F.col(f"{name}_n")).alias(f"{name}_n"))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Empirical CDF per group: value, count, cumulative count, F(value)."""
    cum = cumulative_counts(df, keys, value)
    return cum.select(*keys, value, "n", "cum_n",
                      (F.col("cum_n") / F.col("tot_n")).alias("ecdf"))


def dataset_shape(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """rows surviving each cumulative step, in one pass."""
    acc = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("input")]
    for name, pred in steps.items():
        acc = acc & F.coalesce(pred, F.lit(False))
        aggs.append(F.sum(acc.cast("long")).alias(name))
    wide = df.agg(*aggs)
    names = ["input", *steps]
    return wide.unpivot([], names, "step", "rows")
