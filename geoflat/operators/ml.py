"""Model tables, linear models and error reports."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (PRICE_BIN_LABELS, bin_cut, error_cols, inf_to_null, missing_flag,
                                 ratio)
from ..functions.text import walls_ru
from ..session import ship_package, stored
from .ranks import column_quantiles

def one_hot(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per observed value (sorted), NULL -> all 0, source dropped. The values
    come from a distinct aggregate, never from the rows; there is a column for each of them."""
    values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
    p = prefix or col
    return df.withColumns({f"{p}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0))
                           for v in values}).drop(col)


def standardize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """K1: (x - mean) / population std (scikit-learn's scaler), one aggregate."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(st))
    return out.withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols
    }).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


@dataclass
class LinearModel:
    """An intercept and one weight per feature."""

    features: list[str]
    intercept: float
    weights: list[float]

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights, strict=True):
            out = out + F.lit(w) * F.col(f"`{c}`")
        return out


# Products are summed as whole numbers of 1 / GRAM_SCALE, so sums do not depend on the row order.
GRAM_SCALE = 1_000_000


def gram_sums(df: DataFrame, features: list[str], label: str) -> dict[tuple[int, int], Fraction]:
    """Sums of the products of each two of (1, features..., label), skipping nulls, in one scan: at
    most (features + 2) squared numbers reach the driver, whatever the rows."""
    ship_package(df.sparkSession)
    cols = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate([*features, label])]
    pairs = [(i, j) for i in range(len(cols) + 1) for j in range(i, len(cols) + 1)]

    def part(batches):
        sums = [0] * len(pairs)
        for b in batches:
            for at in range(0, b.num_rows, GRAM_ROWS):
                for k, s in enumerate(product_sums(b.slice(at, GRAM_ROWS), pairs)):
                    sums[k] += s
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array([str(s) for s in sums])], ["k", "s"])

    rows = df.select(*cols).mapInArrow(part, "k int, s string").groupBy("k").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["k"]: r["s"] for r in rows}
    return {p: Fraction(int(found.get(k) or 0), GRAM_SCALE) for k, p in enumerate(pairs)}


# Rows whose products are summed at once: 2^13 numbers below 2^49 stay below 2^63.
GRAM_ROWS = 8192
_HALF = 2.0 ** 40


def product_sums(batch: pa.RecordBatch, pairs: list[tuple[int, int]]) -> list[int]:
    """Exact sums of ``rint(x * y * GRAM_SCALE)`` over the rows where both are known, for pairs of
    columns counted from 1; 0 is the constant 1. Each product is split in two parts of whole numbers."""
    known = [np.ones(batch.num_rows, bool)] + [np.asarray(c.is_valid()) for c in batch.columns]
    x = [np.ones(batch.num_rows)] + [pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns]
    out = []
    for i, j in pairs:
        v = np.where(known[i] & known[j], np.rint(x[i] * x[j] * float(GRAM_SCALE)), 0.0)
        high = np.floor(v / _HALF)
        if not (np.abs(high) < 2.0 ** 49).all():
            raise OverflowError("products of the normal equations are too large or not numbers")
        out.append((int(high.astype(np.int64).sum()) << 40) + int((v - high * _HALF).astype(np.int64).sum()))
    return out


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the symmetric positive definite system a x = b."""
    low = np.linalg.cholesky(a)
    n = len(b)
    z, x = np.zeros(n), np.zeros(n)
    for i in range(n):
        z[i] = (b[i] - low[i, :i] @ z[:i]) / low[i, i]
    for i in reversed(range(n)):
        x[i] = (z[i] - low[i + 1:, i] @ x[i + 1:]) / low[i, i]
    return x


def ridge_fit(train: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> LinearModel:
    """K3: least squares with the penalty ``alpha`` on the squared weights, the intercept free: the
    normal equations of the centred columns, from one aggregate. Sums are exact until they are
    centred, so large means cost no digits. No rows give zero weights."""
    s = gram_sums(train, features, label)
    n, p = s[0, 0], len(features)
    if not n:
        return LinearModel(features, 0.0, [0.0] * p)

    def centred(i, j):
        return float(s[min(i, j), max(i, j)] - s[0, i] * s[0, j] / n)

    a = np.array([[centred(i, j) for j in range(1, p + 1)] for i in range(1, p + 1)]).reshape(p, p)
    b = np.array([centred(i, p + 1) for i in range(1, p + 1)])
    w = cholesky_solve(a + alpha * np.eye(p), b)
    intercept = float(s[0, p + 1] / n) - sum(float(s[0, i + 1] / n) * w[i] for i in range(p))
    return LinearModel(features, float(intercept), [float(v) for v in w])


def ridge_predict(model: LinearModel, df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", model.column())


def model_table(df: DataFrame, walls: str = "walls", leak: bool = False) -> DataFrame:
    """K7: the model's rows and features. Missing walking minutes are flagged and, like the kitchen
    area, filled with the median; rows without one of the main numbers, with an infinite one or
    without a wall class go; then plausible ranges, the floor's share and one column per wall class.
    The price per square metre would leak the label, so it is added only on request."""
    df = df.withColumns({"metro_missing": missing_flag("metro_walk_min"), "walls_clean": walls_ru(walls)})
    df = median_fill(df, ["metro_walk_min", "kitchen_area"])
    df = df.withColumns({c: inf_to_null(c) for c in MODEL_NUMBERS})
    df = df.na.drop(subset=[*MODEL_NUMBERS, "walls_clean"])
    for c, (low, high) in MODEL_RANGES.items():
        df = df.where(F.col(c).between(low, high))
    df = df.where(F.col("floor") <= F.col("floors_total")).withColumn("floor_ratio", ratio("floor", "floors_total"))
    if leak:
        df = df.withColumn("price_per_m2", ratio("price", "area_total"))
    return one_hot(stored(df), "walls_clean")  # read for the classes and as the table


def median_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become the column's exact median over the whole table (one row, broadcast)."""
    found = column_quantiles(df, [], cols, {"_m": 0.5})
    df = df.crossJoin(F.broadcast(found.agg(
        *[F.max(F.when(F.col("_feature") == c, F.col("_m"))).alias(f"_m_{c}") for c in cols])))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in cols}).drop(
        *[f"_m_{c}" for c in cols])


# Numbers and ranges of the model table.
MODEL_NUMBERS = ["price", "area_total", "rooms", "floor", "floors_total", "kitchen_area", "metro_walk_min"]
MODEL_RANGES = {"price": (2_000_000, 200_000_000), "area_total": (15, 250), "kitchen_area": (3, 60),
                "floor": (1, 100), "floors_total": (1, 100), "metro_walk_min": (1, 90)}


def predict_table(pred: DataFrame, label: str = "price", area: str = "area_total") -> DataFrame:
    """K6: predictions with truth and the error columns."""
    cols = error_cols(label, "prediction", area)
    return pred.withColumns({"price_real": F.col(label), "price_pred": F.col("prediction"),
                             **{k: c for k, c in cols.items()}})


def regression_metrics(pred: DataFrame) -> DataFrame:
    """MAE and MAPE (%) in one aggregate."""
    return pred.agg(F.avg("abs_error").alias("mae"), (F.avg("ape")).alias("mape"))


def mae_per_m2(pred: DataFrame) -> DataFrame:
    """mean absolute error per square metre."""
    return pred.agg(F.avg("error_per_m2").alias("mae_per_m2"))


def segment_errors(pred: DataFrame, label: str = "price_real") -> DataFrame:
    """F21 + C26 + E13: per price bin count, mean abs error, mean APE; empty bins listed."""
    b = pred.select(bin_cut(label).alias("price_bin"), "abs_error", "ape")
    agg = b.groupBy("price_bin").agg(F.count(F.lit(1)).alias("n"),
                                     F.avg("abs_error").alias("mae"), F.avg("ape").alias("mape"))
    bins = pred.sparkSession.createDataFrame([(x,) for x in PRICE_BIN_LABELS], "price_bin string")
    return bins.join(agg, "price_bin", "left").select(
        "price_bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"), "mae", "mape")


def top_deals(pred: DataFrame, n: int = 20, key: str = "listing_id") -> DataFrame:
    """H1: largest (prediction - truth) first, key as tie-break, top n."""
    return pred.orderBy(F.col("delta").desc(), F.col(key)).limit(n)
