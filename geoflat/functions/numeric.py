"""Numeric casts and arithmetic as Column expressions.

All of them stay inside whole-stage codegen: no Python UDF anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal literal as pandas.to_numeric accepts it. Spark's cast would also take
# 'nan', 'inf' and '1d'; the guard keeps those out (SQL NULL only, never NaN).
NUMERIC_RE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_double(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC_RE), text.try_cast("double"))


def coerce_numeric_locale(c) -> Column:
    """C1: ',' -> '.', ASCII spaces removed, then number or NULL."""
    t = F.replace(F.replace(_c(c).cast("string"), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    return guarded_double(t)


def coerce_numeric(c) -> Column:
    """Text -> number or NULL (surrounding whitespace allowed)."""
    return guarded_double(F.trim(_c(c).cast("string")))


def to_int_digits(c) -> Column:
    """Keep only ASCII digits; '' -> NULL ('12 500 000 ₽' -> 12500000)."""
    digits = F.regexp_replace(_c(c), r"[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def to_float_first(c) -> Column:
    """C4: ',' -> '.', first ``\\d+(\\.\\d+)?`` as double, else NULL."""
    t = F.replace(_c(c), F.lit(","), F.lit("."))
    m = F.regexp_extract(t, r"(\d+(\.\d+)?)", 1)
    return F.when(m != "", m.cast("double"))


def ratio(num, den) -> Column:
    """Division with NULL (not an error, not inf) on a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def house_age(year, as_of_year: int = 2026) -> Column:
    """C19."""
    return F.lit(as_of_year) - _c(year)


def metro_near_flag(walk_min, limit: int = 15) -> Column:
    """C20: 1 if walk minutes <= limit, 0 otherwise (NULL -> 0)."""
    return F.coalesce((_c(walk_min) <= limit).cast("int"), F.lit(0))


def clip(c, lo=None, hi=None) -> Column:
    """Clamp keeping NULL (``least``/``greatest`` would skip NULL)."""
    x = _c(c)
    out = x
    if lo is not None:
        out = F.when(x < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(x > hi, F.lit(hi)).otherwise(out)
    return out


def min_strict(a, b) -> Column:
    """Element-wise minimum that propagates NULL like numpy."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.least(a, b))


def null_out_of_range(c, lo, hi) -> Column:
    """Value outside [lo, hi] -> NULL, the row stays."""
    x = _c(c)
    return F.when(x.isNull() | ~((x < lo) | (x > hi)), x)


def missing_flag(c) -> Column:
    """C24."""
    return _c(c).isNull().cast("int")


def inf_to_null(c) -> Column:
    """+-inf and NaN -> NULL."""
    x = _c(c)
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


# Price bins of the error report, right-closed, with their labels.
PRICE_BINS = [0, 10_000_000, 20_000_000, 40_000_000, 100_000_000, 500_000_000]
PRICE_BIN_LABELS = ["0-10M", "10-20M", "20-40M", "40-100M", "100M+"]


def bin_cut(c, edges=PRICE_BINS, labels=PRICE_BIN_LABELS) -> Column:
    """Right-closed bins (lo, hi]; outside -> NULL (pd.cut semantics)."""
    x = _c(c)
    out = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), F.lit(lab)).otherwise(out)
    return out


def rint_dp(c, dp: int = 2) -> Column:
    """Round half-even to ``dp`` decimals (numpy ``round``), not Spark's half-up."""
    scale = float(10 ** dp)
    return F.rint(_c(c) * scale) / scale


def error_cols(real, pred, area=None) -> dict[str, Column]:
    """Delta, abs_error, ape %, error_per_m2, price_per_m2_real."""
    real, pred = _c(real), _c(pred)
    out = {
        "delta": pred - real,
        "abs_error": F.abs(pred - real),
        "ape": F.try_divide(F.abs(pred - real), F.abs(real)) * 100.0,
    }
    if area is not None:
        out["error_per_m2"] = F.try_divide(F.abs(pred - real), _c(area))
        out["price_per_m2_real"] = F.try_divide(real, _c(area))
    return out
