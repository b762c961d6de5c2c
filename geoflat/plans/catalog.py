"""Registry of runnable queries: each Spark query is paired with its DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and reads the driver tables (or views derived from
them), so its work grows with the data. ``sql=None`` marks an operator that SQL cannot
express (models, RNG-dependent output); the driver then checks rows only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = ["q_io", "q_clean", "q_scalar", "q_spatial", "q_stats", "q_text", "q_synth", "q_ml", "q_alias"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"geoflat.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"geoflat.plans.{m}":
                raise


def rnd(c, dp: int = 6) -> Column:
    """Presentation rounding used identically by query and oracle (``round(x, dp)``)."""
    return F.round(F.col(c) if isinstance(c, str) else c, dp)


def round_doubles(df: DataFrame, dp: int = 6, skip: tuple = ()) -> DataFrame:
    return df.select(*[rnd(f.name, dp).alias(f.name)
                       if f.dataType.simpleString() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema.fields])


def sig(c, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (same arithmetic as ``sig_sql``), for
    statistics whose summation order differs between engines. Only exact powers of ten
    (10^0..10^22) are used: scale up by multiplying for small values, down by dividing
    for large ones, so both engines round the same double."""
    x = F.col(c) if isinstance(c, str) else c
    k = F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), -k)
    down = F.pow(F.lit(10.0), k)
    small = F.round(x * up, digits - 1) / up
    large = F.round(x / down, digits - 1) * down
    return (F.when(x == 0, F.lit(0.0)).when(F.abs(k) > 22, x)
            .when(k < 0, small).otherwise(large))


def sig_sql(x: str, digits: int = 9) -> str:
    k = f"floor(log10(abs({x})))"
    return (f"(CASE WHEN ({x}) = 0 THEN 0.0 WHEN abs({k}) > 22 THEN ({x}) "
            f"WHEN {k} < 0 THEN round(({x}) * pow(10.0, -{k}), {digits - 1}) / pow(10.0, -{k}) "
            f"ELSE round(({x}) / pow(10.0, {k}), {digits - 1}) * pow(10.0, {k}) END)")


def exact_avg(c: str, scale: float) -> Column:
    """Mean of values that carry a fixed number of decimals (``scale`` = 10^decimals):
    the sum runs over exact integers, so it does not depend on summation order, and
    ``exact_avg_sql`` gives the same double."""
    return (F.sum(F.rint(F.col(c) * scale).cast("bigint")) / F.count(c)) / scale


def exact_avg_sql(c: str, scale: float) -> str:
    return f"((CAST(sum(round_even({c} * {scale!r}, 0)) AS BIGINT) / count({c})) / {scale!r})"
