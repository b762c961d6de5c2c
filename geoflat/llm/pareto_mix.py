"""Mixing sources to target weights by Pareto order sampling.

1. Word totals per source; sources in code-point order (null last) get the cyclic weights
   and share all words by weight. No target exceeds ``max_copies`` times its source; the
   excess is reshared by weight until none is above (a fixed point on aggregates).
2. Expected copies of a document: ``min(max_copies, c * 2^(tilt * size class))``, where the
   size class is the binary logarithm of the word count and ``c`` solves the source's
   target exactly over its (at most 64) classes. The whole part of the expectation is
   allocated as certain copies.
3. The fractional part is the inclusion probability p. Documents are ranked by random odds
   over inclusion odds, ``(u / (1-u)) / (p / (1-p))``, u hashed from seed, id and text, and
   the lowest ranked are taken until their words fill what the source still lacks. The
   size that is fixed is the number of words.

The few documents above a thousandth of their source's words (fewer than 1,000 a source)
are ranked first and taken while they fit; the rest then fills the remainder, so a source
misses its target by less than one small document. The cut in that rest is found by two
rounds of histogram refinement on the rank key and one ordering of the last, tiny bin:
nothing is sorted or windowed per source.

Defined cases: null text has size 0; documents without words are never taken; null sources
form one source. Repeated rows (same id and text) share a key and are treated alike; rows
without an id are told apart by their place in the input, so equal ones are drawn one by
one. With no words at all every target is 0. An empty table gives an empty result. Other columns,
whatever their names, travel inside ``row``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranks import cumulative_counts
from ..session import cut_lineage
from .common import join_small, packed, text_of, uniform53, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
TILT = 0.25
SEED = 20240229
LARGE_SHARE = 1000          # a document above 1/1000 of its source's words is large
KEY_BITS = 52
LEVEL_BITS = 13


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``src, source_size, target`` from rows ``src, size``."""
    totals = cut_lineage(sizes.groupBy("src").agg(F.sum("size").alias("source_size")))
    places = cumulative_counts(totals.select("src"), [], "src")
    known = join_small(totals, places.select(F.col("src").alias("at"), "cum_n"),
                       F.col("src") == F.col("at"))
    n_named = totals.where(F.col("src").isNotNull()).count()
    place = F.coalesce(F.col("cum_n"), F.lit(n_named + 1)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    src = cut_lineage(known.select("src", "source_size", weight.alias("weight")))
    cap = F.lit(float(max_copies)) * F.col("source_size")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:  # every pass caps at least one more source, or ends
        above = F.lit(rate) * F.col("weight") > cap if capped >= 0 else F.lit(False)
        s = src.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("full"),
                    F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"),
                    F.sum(above.cast("int")).alias("n")).first()
        if not s["w"] or s["n"] == capped:
            break
        capped, rate = s["n"], max(0.0, total - s["full"]) / s["w"]
    return src.select("src", "source_size",
                      F.least(F.lit(rate) * F.col("weight"), cap).alias("target"))


def class_copies(sizes: DataFrame, targets: DataFrame, max_copies: int, tilt: float) -> DataFrame:
    """``src, class, whole, p``: certain copies and inclusion probability per size class."""
    words = (sizes.where("size > 0").groupBy("src", "class").agg(F.sum("size").alias("x")))
    t = targets.select(F.col("src").alias("t_src"), "target")
    c = join_small(words, t, F.col("src").eqNullSafe(F.col("t_src")), "inner").withColumn(
        "z", F.pow(F.lit(2.0), F.lit(tilt) * F.col("class")))
    down = W.partitionBy("src").orderBy(F.desc("class"))
    full = F.coalesce(F.sum("x").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("x") * F.col("z")).over(down.rowsBetween(0, W.unboundedFollowing))
    c = c.withColumn("scale", (F.col("target") - F.lit(float(max_copies)) * full) / rest)
    fits = F.col("scale") * F.col("z") <= F.lit(float(max_copies))
    scale = F.max_by("scale", F.when(fits, F.col("class"))).over(W.partitionBy("src"))
    e = F.least(F.lit(float(max_copies)),
                F.greatest(F.lit(0.0), F.coalesce(scale * F.col("z"), F.lit(float(max_copies)))))
    whole = F.floor(e + F.lit(1e-9))
    return c.select("src", "class", whole.cast("int").alias("whole"),
                    F.greatest(F.lit(0.0), e - whole).alias("p"))


def _rank_key(u: Column, p: Column) -> Column:
    """Pareto rank q = odds(u) / odds(p), folded into (0, 1) and scaled to a long."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.least((q / (1 + q) * F.lit(float(2 ** KEY_BITS))).cast("bigint"),
                   F.lit(2 ** KEY_BITS - 1))


def _take_large(pdf: pd.DataFrame) -> pd.DataFrame:
    """Large documents of one source (fewer than 1,000) in rank order, each taken while it
    fits into the words that the inclusion probabilities give to this part."""
    pdf = pdf.sort_values(["key", "size"], kind="stable")
    room = float((pdf["p"] * pdf["size"] * pdf["rows"]).sum())
    taken = []
    for size in pdf["size"] * pdf["rows"]:
        taken.append(size <= room)
        room -= size if taken[-1] else 0
    return pdf.assign(taken=taken)[["src", "key", "size", "rows", "taken"]]


def sampling_cuts(keyed: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(large documents taken: ``src, key``; highest key taken: ``src, cut``)."""
    live = keyed.where("size > 0")
    certain = live.groupBy("src").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    drawn = live.where("p > 0").groupBy("src", "key", "size", "p", "large").agg(
        F.count(F.lit(1)).alias("rows"))
    src_type = keyed.schema["src"].dataType.simpleString()
    large = cut_lineage(drawn.where("large").groupBy("src").applyInPandas(
        _take_large, f"src {src_type}, key bigint, size bigint, rows bigint, taken boolean")
        .where("taken"))
    small = drawn.where("not large").select("src", "key", (F.col("size") * F.col("rows")).alias("size"))
    by_large = large.groupBy("src").agg(F.sum(F.col("size") * F.col("rows")).alias("got"))
    want = join_small(targets.select("src", "target"), certain.withColumnRenamed("src", "c_src"),
                      F.col("src").eqNullSafe(F.col("c_src")))
    want = join_small(want, by_large.withColumnRenamed("src", "l_src"),
                      F.col("src").eqNullSafe(F.col("l_src")))
    lack = F.col("target") - F.coalesce("certain", F.lit(0)) - F.coalesce("got", F.lit(0))
    want = cut_lineage(want.select(F.col("src").alias("w_src"), lack.alias("lack"),
                                   F.lit(0).cast("bigint").alias("low")))
    rows, low_bits = small, KEY_BITS
    for _ in range(2):
        low_bits -= LEVEL_BITS
        at = F.shiftright(F.col("key"), low_bits)
        bins = rows.groupBy("src", at.alias("bin")).agg(F.sum("size").alias("x"))
        up = W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        bins = bins.withColumn("cum", F.sum("x").over(up))
        bins = join_small(bins, want, F.col("src").eqNullSafe(F.col("w_src")), "inner")
        cut = (bins.where(F.col("cum") >= F.col("lack")).groupBy("src")
               .agg(F.min_by(F.struct("bin", (F.col("lack") - F.col("cum") + F.col("x"))
                                      .alias("lack")), "bin").alias("b")))
        want = cut_lineage(cut.select(
            F.col("src").alias("w_src"), F.col("b.lack").alias("lack"),
            F.col("b.bin").alias("low")))
        rows = join_small(rows, want.select(F.col("w_src").alias("r_src"), "low"),
                          F.col("src").eqNullSafe(F.col("r_src")) & (at == F.col("low")), "inner"
                          ).drop("r_src", "low")
    up = W.partitionBy("src").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = join_small(rows.withColumn("cum", F.sum("size").over(up)),
                      want, F.col("src").eqNullSafe(F.col("w_src")), "inner")
    inside = last.where(F.col("cum") - F.col("size") / 2 <= F.col("lack")).groupBy("src").agg(
        F.max("key").alias("cut"))
    below = F.shiftleft(F.col("low"), low_bits) - 1
    cuts = join_small(want, inside.withColumnRenamed("src", "i_src"),
                      F.col("w_src").eqNullSafe(F.col("i_src")))
    return (large.select("src", "key").distinct(),
            cuts.select(F.col("w_src").alias("src"), F.coalesce("cut", below).alias("cut")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, max_copies: int = MAX_COPIES,
        tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """One row per input row: ``row``, ``size`` (words), ``source_size``, ``target`` (words of
    its source in the mix) and ``copies`` (times that the mix takes it, 0 to max_copies)."""
    text, key = text_of(F.col("row")[text_col]), F.col("row")[id_col]
    place = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    rows = packed(docs).select(
        "row", F.col("row")[source_col].alias("src"), word_count(text).alias("size"),
        F.when(key.isNull(), uniform53(F.lit(seed), place, text))
        .otherwise(uniform53(F.lit(seed), key, text)).alias("u"))
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).cast("int"))
    sizes = cut_lineage(rows.drop("row"))
    targets = cut_lineage(source_targets(sizes, weights, max_copies))
    classes = cut_lineage(class_copies(sizes, targets, max_copies, tilt))

    def keyed(df: DataFrame) -> DataFrame:
        t = targets.select(F.col("src").alias("t_src"), "source_size", "target")
        c = classes.select(F.col("src").alias("c_src"), F.col("class").alias("c_class"), "whole", "p")
        df = join_small(df, t, F.col("src").eqNullSafe(F.col("t_src")))
        df = join_small(df, c, F.col("src").eqNullSafe(F.col("c_src"))
                        & (F.col("class") == F.col("c_class"))).drop("t_src", "c_src", "c_class")
        return df.withColumns({
            "key": F.when(F.col("p") > 0, _rank_key(F.col("u"), F.col("p"))),
            "large": F.col("size") * LARGE_SHARE > F.col("source_size")})

    large, cuts = sampling_cuts(keyed(sizes), targets)
    large = large.select(F.col("src").alias("l_src"), F.col("key").alias("l_key"))
    cuts = cut_lineage(cuts).select(F.col("src").alias("k_src"), "cut")
    out = join_small(keyed(rows), large, F.col("src").eqNullSafe(F.col("l_src"))
                     & (F.col("key") == F.col("l_key")) & F.col("large"))
    out = join_small(out, cuts, F.col("src").eqNullSafe(F.col("k_src")))
    # without a cut bin the small documents do not reach what is lacking: all are taken
    drawn = F.when(F.col("p") <= 0, False).when(F.col("large"), F.col("l_key").isNotNull()) \
        .otherwise(F.coalesce(F.col("key") <= F.col("cut"), F.lit(True)))
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn.cast("int")).otherwise(0)
    return out.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: every taken row as often as it is taken, input columns only."""
    return (mix(docs, **kw).where("copies > 0")
            .select(F.explode(F.expr("array_repeat(row, copies)")).alias("row")).select("row.*"))
