"""Exact dedup by content sort (DataFrame functions only).

Texts are equal when they are identical after all white space is deleted. Rows are dealt
by ``repartitionByRange`` (sampled splitters) on the first normalised bytes, then the
digest; each partition is sorted externally on the whole normalised text, which puts
equal texts next to each other, and the window compares neighbours in full. Only the
rows move, once: every window below is partitioned by a superset of the range keys.

Hot groups: a first narrow pass counts rows per digest. A digest with more than
``max(64, rows / 10000)`` rows is cut into slices by a hash of its id, so its rows spread
over several range partitions; at most 10,000 digests can be that frequent, so the list
is broadcast with a proven bound. The keeper of such a group comes from that same pass.

Defined cases: null text counts as empty, so all empty, blank and null texts are one
group. The row with the most code points in the original text stays, then the smallest
id, null ids last. Of repeated rows with the same id and text exactly one is kept. Very
long texts are compared whole (only the splitter uses a short prefix). An empty table
gives an empty result. Other columns, whatever their names, travel inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS, packed, text_of

SPLITTER_CHARS = 32
HOT_DIGESTS = 10_000
MIN_SLICE_ROWS = 64


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row`` (the input row), ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` of the normalised text."""
    slice_rows = max(MIN_SLICE_ROWS, -(-docs.count() // HOT_DIGESTS))
    text = text_of(F.col("row")[text_col])
    norm = F.regexp_replace(text, WS + "+", "")
    keyed = packed(docs).select(
        "row", F.col("row")[id_col].alias("id"), F.length(text).alias("n"),
        F.sha2(norm, 256).alias("sha"), F.substring(norm, 1, SPLITTER_CHARS).alias("head"))

    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id")
    hot = (keyed.groupBy("sha")
           .agg(F.count(F.lit(1)).alias("hot_rows"), F.min(best).alias("hot_best"))
           .where(F.col("hot_rows") > slice_rows))
    slices = F.ceil(F.col("hot_rows") / F.lit(slice_rows))
    dealt = (keyed.join(F.broadcast(hot), "sha", "left")
             .withColumn("slice", F.when(F.col("hot_rows").isNotNull(),
                                         F.pmod(F.xxhash64("id"), slices)).otherwise(0))
             .repartitionByRange("head", "sha", "slice")
             .withColumn("norm", norm))

    equal = W.partitionBy("head", "sha", "slice", "norm")
    order = equal.orderBy(F.desc("n"), F.col("id").isNull(), "id")
    ranked = dealt.select(
        "row", "id", "sha", "hot_rows", "hot_best",
        F.row_number().over(order).alias("rn"),
        F.first("id").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("first_id"),
        F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        .alias("run_rows"))
    is_hot = F.col("hot_rows").isNotNull()
    keep = F.when(is_hot, F.col("hot_best.id")).otherwise(F.col("first_id"))
    return ranked.select(
        "row", keep.alias("keep_id"),
        F.when(is_hot, F.col("hot_rows")).otherwise(F.col("run_rows")).alias("group_size"),
        ((F.col("rn") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with exactly the input's columns."""
    return content_sort(docs, id_col, text_col).where("kept").select("row.*")
