"""Shared column expressions and join helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import BROADCAST_ROW_LIMIT, bounded_row_count, ensure_checkpoint_dir

# The white space of all contracts, space and the bytes 0x09 to 0x0D.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
WORD = NOT_WS + "+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """The whole input row as one struct ``row``, so that working columns never clash
    with columns of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_of(c: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a non-null text: each word with the white space around it
    becomes one character, and those are counted."""
    one = F.regexp_replace(text, f"{WS}*+{NOT_WS}++{WS}*+", "x")
    return F.when(text.rlike(NOT_WS), F.length(one)).otherwise(0).cast("bigint")


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left",
               limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join with a table that is usually small: broadcast when at most ``limit`` rows
    were counted, otherwise a shuffled join whose skewed keys AQE splits."""
    if bounded_row_count(small, limit) is not None:
        small = F.broadcast(small)
    return df.join(small, on, how)


def byte_chunks(column: pa.Array, limit: int):
    """Slices of a text column of at most ``limit`` bytes each, or of one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    low = 0
    while low < len(column):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield column.slice(low, high - low)
        low = high


def texts_of(column: pa.Array, limit: int = 2_000_000):
    """The texts of a column as Python strings, never more than ``limit`` bytes of them at once."""
    for chunk in byte_chunks(column, limit):
        yield from chunk.to_pylist()


def free_memory() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers live on and run
    the tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no GNU C library
        pass


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet into the shared checkpoint folder and read again: cuts the lineage
    like a checkpoint, in a compressed form."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform53(*parts: Column) -> Column:
    """Uniform double strictly inside (0, 1) from a 64-bit hash of the columns; the same
    for every run, task and partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 53))


def ship_package(spark: SparkSession) -> None:
    """The package for the Python workers, and Arrow batches bounded for long texts."""
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":  # Spark's default
        spark.conf.set(BATCH_BYTES, "8m")
    session.ship_package(spark)
