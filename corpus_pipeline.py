"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but
the last return the columns of ``documents``. ``run`` writes each result as Parquet into the
shared checkpoint folder and rereads it, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflat.llm import content_sort, minhash_oph, pareto_mix, pattern_pack, quality_ftrl
from geoflat.llm.common import ship_package, table
from geoflat.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the
    raw documents; rows with null or blank texts are judged like any other."""
    ship_package(spark)
    raw = table(spark, sf_dir, "documents")
    model = quality_ftrl.fit(raw, table(spark, sf_dir, "labels"))
    score = quality_ftrl.scored(docs, model)
    return docs.where(score >= quality_ftrl.THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that stays."""
    ship_package(spark)
    return content_sort.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one of the smallest id, ids before
    nulls. Rows are told apart by id and text; rows equal in both are exact copies, which the
    stage before has merged."""
    ship_package(spark)
    gone = minhash_oph.near_duplicates(docs).where("not stays").select(
        F.col("id").alias("g_id"), F.col("text_key").alias("g_key")).distinct()
    text_key = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["g_id"]) & (text_key == gone["g_key"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return pareto_mix.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens."""
    ship_package(spark)
    return pattern_pack.packed_pieces(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup),
          ("MinHash near-dedup", near_dedup), ("mixing sources", mix), ("best-fit packing", pack)]

#: The classifier, the hashed draws of the mix and the tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
