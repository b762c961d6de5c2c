"""Licence scans by diagonal voting.

1. Every word of a text starts a rolling gram of ``K`` words. All grams of all texts are joined,
   on a 64-bit hash, with the grams of the templates (a table bounded by the template texts, so
   it is broadcast); equal hashes count only if the words are equal too.
2. A hit at text word p and template word t votes for the diagonal p - t. Votes are counted per
   text, template and diagonal.
3. Words put in or left out move a match to a near diagonal: diagonals at most ``GAP`` words
   apart are merged into one span. Diagonals of a phrase stay apart.
4. A span is verified by the template words that its hits cover: all of them for a phrase; for a
   notice at least ``MIN_SHARE`` of the template, and half of the span's own words. Where the
   spans of several notices overlap, the one with the largest share stays, then the longer one.

Texts are read once and never shuffled: only hits, and one narrow row a text, move to the task
of their text. Texts are told apart by their place in the input, not by an id.

Defined cases: null, empty and wordless texts have no words and no spans. Repeated rows and rows
with equal or null ids are scanned one by one. A text of fewer than ``K`` words holds no gram of a
template. A template of fewer than ``K`` words is refused. Ties between overlapping notices go to
the earlier label. Columns of the input travel in one struct, so none can clash. An empty table
gives an empty result. A very long text costs memory in proportion to its words, in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .license_templates import NOTICES, PHRASES

K = 3
GAP = 4
MIN_SHARE = 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(phrases: dict[str, str], notices: list[tuple[str, str]], k: int = K) -> list[tuple]:
    """``(template, label, exact, n_words, place, gram)`` of every gram of every template."""
    rows = []
    for t, (label, wording, exact) in enumerate([(v, p, True) for p, v in phrases.items()]
                                                + [(v, p, False) for v, p in notices]):
        words = [w for w in re.split(BREAK, wording.lower()) if w]
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {wording!r}")
        rows += [(t, label, exact, len(words), i, " ".join(words[i:i + k]))
                 for i in range(len(words) - k + 1)]
    return rows


def _template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(
        rows, "template int, label string, exact boolean, t_words int, place int, t_gram string")
    return F.broadcast(table.withColumn("t_hash", F.xxhash64("t_gram")))


def rolling_grams(words: str, k: int = K) -> Column:
    """One gram per word of the array column; the last ones are shorter."""
    return F.transform(F.col(words), lambda _, i: F.array_join(F.slice(F.col(words), i + 1, k), " "))


def hits(docs: DataFrame, text_col: str, templates: DataFrame, k: int = K) -> DataFrame:
    """Joined grams of all texts, and for each text one row without a template (``head``), which
    carries the other columns as ``row`` and the number of words."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("_")])
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("at"), row.alias("row"),
                        F.array_remove(F.split(text, BREAK), "").alias("words"))
    grams = words.select("at", "row", rolling_grams("words", k).alias("grams"))
    dealt = grams.select("at", "row", F.size("grams").cast("bigint").alias("n_words"),
                         F.posexplode_outer("grams").alias("pos", "gram"))
    head = F.col("pos").isNull() | (F.col("pos") == 0)
    joined = dealt.withColumn("hash", F.xxhash64("gram")).join(
        templates, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    return joined.where(head | F.col("template").isNotNull()).select(
        "at", F.when(head, F.col("row")).alias("row"), F.when(head, F.col("n_words")).alias("n_words"),
        "template", "label", "exact", "t_words", F.col("pos").cast("bigint").alias("pos"),
        (F.col("pos") - F.col("place")).cast("bigint").alias("diagonal"), "place").repartition("at")


def diagonal_spans(found: DataFrame, k: int = K, gap: int = GAP, min_share: float = MIN_SHARE) -> DataFrame:
    """``hits`` -> per text and span ``at, template, label, exact, first_word, end_word, covered,
    share, verified``; texts without hits keep one row with a null template. ``row`` and
    ``n_words`` are on at least one row of each text."""
    diagonals = found.groupBy("at", "template", "label", "exact", "t_words", "diagonal").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_list("place").alias("places"))
    along = W.partitionBy("at", "template").orderBy("diagonal")
    apart = (F.col("exact") | F.lag("diagonal").over(along).isNull()
             | (F.col("diagonal") - F.lag("diagonal").over(along) > gap))
    numbered = diagonals.withColumn("apart", apart.cast("int")).withColumn(
        "span", F.sum("apart").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = numbered.groupBy("at", "template", "label", "exact", "t_words", "span").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
        F.min("low").alias("first_word"), (F.max("high") + k).alias("end_word"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    words_of = F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))
    spans = spans.withColumn("covered", F.size(F.array_distinct(words_of)).cast("bigint"))
    spans = spans.withColumn("share", F.col("covered") / F.col("t_words"))
    good = F.when(F.col("exact"), F.col("covered") == F.col("t_words")).otherwise(
        (F.col("share") >= min_share) & (2 * F.col("covered") >= F.col("end_word") - F.col("first_word")))
    spans = spans.withColumn("good", F.coalesce(good, F.lit(False)))
    rival = (F.col("good") & ~F.col("exact")).alias("rival")
    order = W.partitionBy("at", rival).orderBy("first_word", "end_word", "template")
    before = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    chained = spans.withColumn("open", (before.isNull() | (F.col("first_word") >= before)).cast("int")).withColumn(
        "chain", F.sum("open").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    best = W.partitionBy("at", rival, "chain").orderBy(
        F.desc("share"), F.desc("covered"), "label", "first_word", "template")
    return chained.withColumn(
        "verified", F.col("good") & (F.col("exact") | (F.row_number().over(best) == 1))).select(
        "at", "row", "n_words", "template", "label", "exact", "first_word", "end_word", "covered", "share", "verified")


def license_spans(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None,
                  notices: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """Spans of all texts, see ``diagonal_spans``."""
    rows = template_grams(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    return diagonal_spans(hits(docs, text_col, _template_table(docs.sparkSession, rows), k), k)


def license_scan(docs: DataFrame, text_col: str = "text", **templates) -> DataFrame:
    """One row per text: ``row`` (its other columns), ``n_words``, ``n_base, first_word,
    last_word, base_labels`` (places of phrases), ``labels`` (verified notices too), ``score``
    (the largest share of a template found; 0 without a hit), and ``spans``, the verified spans
    as (label, first_word, end_word, share) in text order."""
    base = F.col("verified") & F.col("exact")
    span = F.struct("first_word", "end_word", "label", "share")
    return license_spans(docs, text_col, **templates).groupBy("at").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("verified"), span))).alias("spans")).drop("at")
