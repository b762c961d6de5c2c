"""Deterministic, partition-independent randomness from hashes of row keys.

``F.rand(seed)`` depends on how rows fall into partitions, so a retried task or a
different partition count changes the draw. Here every draw is a function of
(row key, salt, seed) only: u = first 32 bits of md5 / 2^32. DuckDB computes the same
double with ``('0x'||substr(md5(..),1,8))::UBIGINT / 4294967296.0``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_uniform(*parts) -> Column:
    """u in [0, 1) from md5 of the '|'-joined parts."""
    h = F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("double")
    return h / F.lit(TWO32)


def hash_uniform_sql(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(('0x'||substr(md5({joined}),1,8))::UBIGINT/4294967296.0)"


TWO52 = 4503599627370496.0


def hash_uniform52(*parts) -> Column:
    """As ``hash_uniform`` from 52 bits, for draws of one row among very many."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 13), 16, 10).cast("double") / F.lit(TWO52)


def hash_uniform52_sql(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(('0x'||substr(md5({joined}),1,13))::UBIGINT/{TWO52!r})"


def hash_u64(*parts) -> Column:
    """60-bit rank key (15 hex digits) for exact ordered splits."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 15), 16, 10).cast("bigint")


def hash_u64_sql(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(('0x'||substr(md5({joined}),1,15))::UBIGINT)::BIGINT"


def hash_normal(*parts) -> Column:
    """Standard normal by Box-Muller on two hashed uniforms (open interval)."""
    u1 = (hash_uniform(*parts, "bm1") * TWO32 + 0.5) / TWO32
    u2 = hash_uniform(*parts, "bm2")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def hash_normal_sql(*parts: str) -> str:
    u1 = f"((({hash_uniform_sql(*parts, repr('bm1'))})*4294967296.0+0.5)/4294967296.0)"
    u2 = hash_uniform_sql(*parts, repr("bm2"))
    return f"(sqrt(-2.0*ln({u1}))*cos({2 * math.pi!r}*{u2}))"


def hash_beta22(*parts) -> Column:
    """Beta(2, 2) as the median of three uniforms (order statistic 2 of 3)."""
    a, b, c = (hash_uniform(*parts, s) for s in ("b1", "b2", "b3"))
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def hash_beta22_sql(*parts: str) -> str:
    a, b, c = (hash_uniform_sql(*parts, repr(s)) for s in ("b1", "b2", "b3"))
    return f"greatest(least({a},{b}), least(greatest({a},{b}),{c}))"
