"""Quality rules with distribution divergence (DataFrame functions only).

Base counts per document, then two histograms: character classes, and the common words of
the document's language. Both are compared with language references by the Jensen-Shannon
distance (base 2, so 0 to 1). A reference is the mean over the distinct texts of a language that
pass the base rules: each text (white space aside) has one vote, the mean of its copies, so neither
copies nor junk nor a few very long texts set it. Near copies vote one by one. Languages outside
the fixed word lists are compared with the pooled list and with the texts of all languages; a
language without any vote has null distances. A document fails when a distance is above its limit;
short texts are exempt (character classes below ``MIN_CHARS``, common words below ``MIN_WORDS``),
as their histograms are mostly noise.

Everything a document needs is computed inside its row, once: the counts are checkpointed without
the text, and references and verdicts are made from them. The shuffles are the votes per digest and
the reference sums (languages x classes).

Defined cases: null or empty text has all counts 0 and fails the base rule (fewer than 10
words). A null or unknown language uses the pooled reference. Repeated rows are judged
alike. An empty table gives an empty result. Other columns travel inside ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WS, packed, text_of

# Common words per language, and some of all for other languages.
COMMON_WORDS = {
    "en": "the of and to in is that it for are".split(),
    "de": "der die und in den von zu das mit nicht".split(),
    "es": "de la que el en los del las por con".split(),
    "fr": "de la le et les des en un une que".split(),
    "*": "the of and to der die und de la que".split(),
}
# Character classes as the characters that each one counts. White space is a
# class too, and what no class counts (lower-case letters above all) is the last.
CHAR_CLASSES = {
    "upper": r"A-Z\u00C0-\u00D6\u00D8-\u00DE", "digit": r"0-9", "stop": r".,;:!?'\"()\-",
    "symbol": r"#*$%&|<>\[\]{}\\/=+~^_@`",
}
MIN_CHARS, MIN_WORDS = 400, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.21, 0.245
MIN_TEXT_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = r"#*$%&|<>"


def count_of(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def covered_words(places: Column) -> Column:
    """Words covered by windows whose key occurs at least twice. ``places`` holds (key,
    position) sorted, so equal keys are neighbours; the words follow from the gaps between
    the repeated positions."""
    twice = F.filter(places, lambda x, j: (x["k"] == F.get(places, j - 1)["k"])
                     | (x["k"] == F.get(places, j + 1)["k"]))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    first = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, first, lambda s, i: F.struct(
        (s["covered"] + F.least(i - s["last"], F.lit(WINDOW))).alias("covered"), i.alias("last")),
        lambda s: s["covered"]).cast("bigint")


def base_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``row`` and the counts of each text, with both histograms, the histogram of the pooled words
    and the digest of the text without white space."""
    text = text_of(F.col("row")[text_col])
    lang = F.col("row")[lang_col]
    df = packed(docs).withColumn("text", text)
    known = F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("*"))
    lists = {k: v + [w for w in COMMON_WORDS["*"] if w not in v] for k, v in COMMON_WORDS.items()}
    word_list = reduce(lambda c, kv: c.when(F.col("known") == kv[0], F.array(*map(F.lit, kv[1]))),
                       lists.items(), F)
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\n\t\r\x0b\x0c", F.col("text"))
    marked = "".join([*CHAR_CLASSES.values(), SYMBOLS])
    df = df.withColumns({
        "known": known, "words": F.array_remove(F.split(spaced, " "), ""),
        "marks": F.regexp_replace("text", f"[^{marked}]+", ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # every word with a space of its own on both sides, so that each is found by its own match
    df = df.withColumns({
        "word_list": word_list, "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "joined": F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))})
    keys = F.transform("hashes", lambda h, i: F.xxhash64(
        h, *[F.get("hashes", i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("windows", F.slice(keys, 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("places", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    n_words, n_chars = F.size("words").cast("bigint"), F.length("text").cast("bigint")
    word_chars = F.greatest(F.length("joined") - 2 * n_words, F.lit(0))
    word_hist = []
    for i in range(max(map(len, lists.values()))):
        w = F.get("word_list", F.lit(i))
        left = F.replace("joined", F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))
        word_hist.append(F.floor((F.octet_length("joined") - F.octet_length(left)) / (F.octet_length(w) + 2)))
    places = reduce(lambda c, kv: c.when(F.col("known") == kv[0], F.array(
        *[F.lit(kv[1].index(w)) for w in COMMON_WORDS["*"]])), lists.items(), F)
    entries = len(COMMON_WORDS["*"])
    return df.select(
        "row", "known", n_words.alias("n_words"),
        F.when(n_words > 0, word_chars).otherwise(0).cast("bigint").alias("word_chars"),
        count_of(F.col("marks"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("places").isNotNull(), covered_words(F.col("places"))).otherwise(0)
        .cast("bigint").alias("n_repeat_words"),
        n_chars.alias("n_chars"),
        F.array(n_chars - F.when(n_words > 0, word_chars).otherwise(0),
                *[count_of(F.col("marks"), c) for c in CHAR_CLASSES.values()]).alias("char_hist"),
        F.array(*word_hist[:entries]).alias("word_hist"), F.array(*word_hist).alias("all_words"),
        places.alias("pooled_at"), F.sha2(F.array_join("words", ""), 256).alias("digest"))


def _shares(counts: Column, total: Column, with_rest: bool) -> Column:
    """Relative histogram; what no entry counts is a last entry."""
    if with_rest:
        inside = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
        counts = F.concat(counts, F.array(F.greatest(total - inside, F.lit(0).cast("bigint"))))
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence with binary logarithms."""
    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _as_maps(rows: list, hists: dict[str, tuple[dict[str, int], Column]]) -> list[Column | None]:
    out = []
    for hist, (groups, _) in hists.items():
        found = {r["known"]: [r[f"{hist}_{i}"] / 1e9 / r[f"{hist}_n"] for i in range(groups[r["known"]])]
                 for r in rows if r[f"{hist}_n"]}
        out.append(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
                   if found else None)
    return out


def _text_references(counts: DataFrame, hists: dict[str, tuple[dict[str, int], Column]],
                     pooled_shares: Column) -> list[Column | None]:
    """Per histogram (entries per language, usable rows): map of language -> mean relative
    histogram, one vote per distinct text, as a literal (at most four languages and the pooled one,
    with fixed numbers of entries). The pooled language has the votes of all texts. The votes are grouped by digest before the sums, so copies meet in the map side."""
    own = F.struct(F.col("known").alias("known"), F.col("word_shares").alias("word_shares"))
    all_ = F.struct(F.lit("*").alias("known"), pooled_shares.alias("word_shares"))
    votes = counts.withColumns({f"{h}_usable": usable for h, (_, usable) in hists.items()}).select(
        "digest", "chars", *[f"{h}_usable" for h in hists],
        F.explode(F.when(F.col("known") == "*", F.array(all_)).otherwise(F.array(own, all_))).alias("v"))
    votes = votes.select("digest", "chars", "v.*", *[f"{h}_usable" for h in hists])
    sums, means = [], []
    for h, (groups, _) in hists.items():
        n, usable = f"{h}_n", F.col(f"{h}_usable")
        sums.append(F.sum(usable.cast("bigint")).alias(n))
        means.append(F.sum((F.col(n) > 0).cast("bigint")).alias(n))
        for i in range(max(groups.values())):
            share = F.coalesce(F.get(h, F.lit(i)), F.lit(0.0))
            sums.append(F.sum(F.when(usable, F.round(share * 1e9)).cast("bigint")).alias(f"{h}_{i}"))
            means.append(F.sum(F.round(F.when(F.col(n) > 0, F.col(f"{h}_{i}") / F.col(n))).cast("bigint"))
                         .alias(f"{h}_{i}"))
    texts = votes.groupBy("known", "digest").agg(*sums)
    return _as_maps(texts.groupBy("known").agg(*means).orderBy("known").collect(), hists)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                  max_char_distance: float = MAX_CHAR_DISTANCE,
                  max_word_distance: float = MAX_WORD_DISTANCE, keep_text: bool = True) -> DataFrame:
    """One row per input row: ``row``, the counts, ``char_distance``, ``word_distance`` (null
    where the text is too short to judge), ``base_failed`` and ``kept``. The counts are
    checkpointed, so they are made once and not twice; without ``keep_text`` the rows lose their
    text, which the checkpoint then does not hold."""
    counts = base_counts(docs, text_col, lang_col)
    if not keep_text:
        counts = counts.withColumn("row", F.col("row").dropFields(f"`{text_col}`"))
    return _judged(cut_lineage(counts), max_char_distance, max_word_distance)


def _judged(counts: DataFrame, max_char_distance: float, max_word_distance: float) -> DataFrame:
    chars = F.when(F.col("n_chars") > 0, _shares(F.col("char_hist"), F.col("n_chars"), True))
    words = F.when(F.col("n_words") > 0, _shares(F.col("word_hist"), F.col("n_words"), True))
    counts = counts.withColumns({"chars": chars, "word_shares": words})
    n_lists = {k: len(v) + 1 for k, v in COMMON_WORDS.items()}
    long_chars, long_words = F.col("n_chars") >= MIN_CHARS, F.col("n_words") >= MIN_WORDS
    hists = {"chars": (dict.fromkeys(n_lists, len(CHAR_CLASSES) + 2), long_chars),
             "word_shares": (n_lists, long_words)}
    base_failed = ((F.col("n_words") < MIN_TEXT_WORDS)
                   | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    pooled = F.transform("pooled_at", lambda i: F.get("all_words", i))
    char_refs, word_refs = _text_references(
        counts.where(~base_failed), hists, _shares(pooled, F.col("n_words"), True))
    none = F.lit(None).cast("double")

    def distance(hist: str, refs: Column | None, usable: Column) -> Column:
        return none if refs is None else F.when(
            usable, js_distance(F.col(hist), F.element_at(refs, F.col("known"))))

    judged = counts.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        distance("chars", char_refs, long_chars).alias("char_distance"),
        distance("word_shares", word_refs, long_words).alias("word_distance"),
        base_failed.alias("base_failed"))
    fails = (F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False))
             | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~fails)
