"""Registered queries of the dealt operators: each applies its operator, with production
parameters, to its whole table. ``ORACLES`` holds DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bfd_pack, content_sort, crf_extract, license_scan, minhash_oph, pareto_mix,
               pattern_pack, quality_ftrl, quality_rules, sql, toxicity_cf, turn_repair,
               warc_merkle, whitening)
from ..session import cut_lineage
from .common import ship_package, table
from .labelled import fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_merkle_audit", sql.OP1)
def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica of them that has lost the records of some
    ids, holds changed bytes of the same length in others, and stale extra records. The moduli
    only say which records are damaged; every record is hashed on both sides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    rotten = F.coalesce((n % 97 == 11) & (n % 131 != 7), F.lit(False))
    lost, stale = (F.coalesce(n % m == k, F.lit(False)) for m, k in ((131, 7), (173, 3)))
    pages = pages.withColumn("copy", F.when(rotten, F.concat(F.lit("#"), F.expr("substr(html, 2)")))
                             .otherwise(html))
    index = cut_lineage(warc_merkle.records_of_pages(pages, "copy"))
    keep = ["file", "offset", "length", "copies", "digest", "page_id", "url"]
    held = index.where(~lost).withColumn("digest", F.col("copy_digest")).select(keep)
    extra = index.where(stale).withColumn("offset", F.col("offset") + 1).select(keep)
    found = warc_merkle.fixity_audit(index.select(keep), held.union(extra))
    return found.select("file", "offset", F.coalesce("primary.page_id", "replica.page_id").alias("page_id"),
                        "status", "primary_digest", "replica_digest")


@query("op2_pareto_mix")
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the cyclic source weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix.mix(docs).select(
        "row.doc_id", "row.source", "size", "source_size", "target",
        F.col("copies").cast("bigint").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_crf_main_text")
def op3_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = crf_extract.extracted(pages, crf_extract.fit(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))


@query("op4_pattern_packing")
def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pattern_pack.packed_pieces(docs).withColumnRenamed("id", "doc_id")


@query("op5_content_sort", sql.OP5)
def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays for each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.content_sort(docs).select(
        "row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_minhash_oph", sql.OP6)
def op6_minhash_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near copies that each belongs to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_oph.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classified(spark: SparkSession, sf_dir: str, method) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = method.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold(F.col("doc_id"), method.FOLDS) == method.HELD_OUT).alias("held_out"),
                       method.scored(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= method.THRESHOLD).cast("int"))


@query("op7_counterfactual_toxicity")
def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    return _classified(spark, sf_dir, toxicity_cf)


@query("op8_ftrl_quality")
def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality."""
    return _classified(spark, sf_dir, quality_ftrl)


@query("op9_packed_matrix")
def op9_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rows of packed id matrices, each row digested: its segments, cumulative
    lengths and the check sums of its ids and positions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bfd_pack.packed_matrix(docs).select(
        "shard", "row_in_shard", F.crc32("ids").alias("ids_crc32"), "cu_seqlens",
        F.crc32("position_ids").alias("position_ids_crc32"), "seg_doc", "seg_piece", "seg_start")


@query("op10_js_quality_rules", sql.op10())
def op10_js_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by base counts and by distribution divergence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return _rules(quality_rules.quality_rules(docs, keep_text=False))


def _rules(judged: DataFrame) -> DataFrame:
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"))


@query("op11_license_diagonals", sql.op11())
def op11_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licence phrases and notices found in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.license_scan(docs).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op12_turn_repair", sql.op12())
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as their hashes say, with their faults and cheapest repair."""
    hurt = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    _, summary = turn_repair.repair(hurt, lost=F.col("lost"))
    return summary.withColumnRenamed("conv", "conv_id")


@query("op13_whitened_embeddings")
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along their first four components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows).select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
