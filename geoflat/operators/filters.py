"""Filters, predicates and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_row_count, cut_lineage
from .projection import present
from .ranks import column_quantiles


def drop_critical(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with NULL in any present listed column are dropped."""
    cols = present(df, cols)
    return df.na.drop(subset=cols) if cols else df


# Strict ranges of the cleaning stage (inclusive, NULL fails).
STRICT_RANGES = {
    "price": (3_000_000, 300_000_000),
    "area_total": (10, 300),
    "floor": (1, 100),
    "floors_total": (1, 100),
}
# Older null-tolerant ranges.
SOFT_RANGES = {
    "rooms": (0, 10),
    "kitchen_area": (2, 100),
    "floor": (1, 100),
    "floors_total": (1, 100),
    "metro_walk_min": (1, 180),
}


def range_strict(df: DataFrame, ranges: dict[str, tuple] = STRICT_RANGES) -> DataFrame:
    """Keep lo <= c <= hi; NULL fails."""
    cond = F.lit(True)
    for c in present(df, list(ranges)):
        lo, hi = ranges[c]
        cond = cond & F.col(c).between(lo, hi)
    return df.where(cond)


def range_null_ok(df: DataFrame, ranges: dict[str, tuple] = SOFT_RANGES) -> DataFrame:
    """D3: keep NULL or lo <= c <= hi."""
    cond = F.lit(True)
    for c in present(df, list(ranges)):
        lo, hi = ranges[c]
        cond = cond & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.where(cond)


def floor_le_total(df: DataFrame, null_ok: bool = False) -> DataFrame:
    """Floor <= floors_total (strict: NULL fails; null_ok: NULL passes)."""
    if not {"floor", "floors_total"}.issubset(df.columns):
        return df
    cond = F.col("floor") <= F.col("floors_total")
    if null_ok:
        cond = F.col("floor").isNull() | F.col("floors_total").isNull() | cond
    return df.where(cond)


def ppm2_band(df: DataFrame, lo: float = 30_000, hi: float = 3_000_000,
              inclusive: bool = True) -> DataFrame:
    """Price per m2 band."""
    c = F.col("price_per_m2")
    return df.where(c.between(lo, hi) if inclusive else (c > lo) & (c < hi))


# Hashes of repeated keys, 8 bytes each, that are broadcast at most.
REPEATED_HASHES = 500_000


def dedup_keep_first(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per key (NULLs equal), the survivor is the smallest ``order_col``.

    Aggregation with ``min_by`` instead of a ranking window: partial aggregation
    collapses a hot key map-side, so no task ever holds a whole duplicate group. That aggregation
    sorts whole rows, so hashes of the keys are counted first: rows whose hash occurs once stay as
    they are, if the other hashes are at most ``REPEATED_HASHES``. ``df`` is read again for it."""
    keys = present(df, keys)
    hashed = F.xxhash64(*[F.col(c) for c in keys])
    many = cut_lineage(df.groupBy(hashed.alias("_many")).agg(
        F.count(F.lit(1)).alias("n"), F.count(order_col).alias("ordered")).where("n > 1 or ordered < n").select("_many"))
    n = bounded_row_count(many, REPEATED_HASHES)
    if n is None:
        return _dedup_all(df, keys, order_col)
    alone = df.join(F.broadcast(many), hashed == F.col("_many"), "left_anti")
    if not n:
        return alone
    return alone.unionByName(_dedup_all(df.join(F.broadcast(many), hashed == F.col("_many"), "left_semi"), keys, order_col))


def _dedup_all(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    agg = (df.groupBy(*keys)
           .agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_s")))
    return agg.select(*keys, *[F.col("_s")[c].alias(c) for c in others]).select(*df.columns)


def dup_counts(df: DataFrame, key: str = "link") -> DataFrame:
    """Fully duplicated rows, duplicates by key, distinct keys (NULL counted as a
    value, like ``nunique(dropna=False)``)."""
    full = df.groupBy(*df.columns).count()
    by_key = df.groupBy(key).count()
    a = full.agg((F.sum("count") - F.count(F.lit(1))).alias("full_duplicates"))
    b = by_key.agg((F.sum("count") - F.count(F.lit(1))).alias("key_duplicates"),
                   F.count(F.lit(1)).alias("distinct_keys"))
    return a.crossJoin(b)


def quantile_trim(df: DataFrame, cols: list[str], q: float = 0.99) -> DataFrame:
    """Keep rows whose value is <= the exact q-quantile of each column (NULL fails,
    as the pandas comparison does). The thresholds are one row -> broadcast join."""
    found = column_quantiles(df, [], cols, {"_q": q})
    th = found.agg(*[F.max(F.when(F.col("_feature") == c, F.col("_q"))).alias(f"_q_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(th))
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) <= F.col(f"_q_{c}"))
    return out.where(cond).drop(*[f"_q_{c}" for c in cols])


def junk_audit(df: DataFrame, col: str, pattern: str, extra: list[str] = ()) -> DataFrame:
    """Rows whose text still matches a junk pattern (case-insensitive, Unicode)."""
    return df.where(F.col(col).rlike("(?iu)" + pattern)).select(*extra, col)


def deal_filter(df: DataFrame) -> DataFrame:
    """Price > 5M and 100k < price_per_m2 < 1M."""
    return df.where((F.col("price") > 5_000_000) & (F.col("price_per_m2") > 100_000)
                    & (F.col("price_per_m2") < 1_000_000))


# Named outlier rules of the quality EDA.
def outlier_rules() -> dict[str, Column]:
    return {
        "floor_gt_total": F.col("floor") > F.col("floors_total"),
        "price_gt_200m": F.col("price") > 200_000_000,
        "area_out_10_250": (F.col("area_total") < 10) | (F.col("area_total") > 250),
        "ceiling_out_2_5": (F.col("ceiling_height") < 2) | (F.col("ceiling_height") > 5),
        "walk_gt_90": F.col("metro_walk_min") > 90,
    }


def outlier_checks(df: DataFrame) -> DataFrame:
    """(rule, count) in one aggregate + unpivot."""
    rules = {k: v for k, v in outlier_rules().items()
             if all(c in df.columns for c in _cols_of(k))}
    wide = df.agg(*[F.sum(F.coalesce(cond.cast("long"), F.lit(0))).alias(k)
                    for k, cond in rules.items()])
    return wide.unpivot([], list(rules), "rule", "count")


_RULE_COLS = {
    "floor_gt_total": ["floor", "floors_total"],
    "price_gt_200m": ["price"],
    "area_out_10_250": ["area_total"],
    "ceiling_out_2_5": ["ceiling_height"],
    "walk_gt_90": ["metro_walk_min"],
}


def _cols_of(rule: str) -> list[str]:
    return _RULE_COLS[rule]


def only_synthetic(df: DataFrame) -> DataFrame:
    """D13."""
    return df.where(F.col("is_synthetic") == 1)
