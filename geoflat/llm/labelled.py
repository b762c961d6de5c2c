"""Labelled training samples and token counting shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from .common import free_memory, texts_of

#: At most so many labelled documents train a classifier: a bounded, documented sample, the
#: lowest hashes of the ids, so it is the same in every run.
TRAIN_ROWS = 12_000


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def training_ids(labels: DataFrame, label: str, parts: int, held_out: int,
                 rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """``t_id, y`` of the sample. Labels other than 0 and 1, null labels, null ids and rows of
    the held-out part are never read into it; ids with several labels give the largest."""
    pool = labels.select(F.col(f"`{id_col}`").alias("t_id"), F.col(f"`{label}`").alias("y")).where(
        F.col("t_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("t_id"), parts) != held_out))
    pool = pool.groupBy("t_id").agg(F.max("y").cast("int").alias("y"))
    return pool.orderBy(F.xxhash64("t_id"), "t_id").limit(rows)


@dataclass
class Sample:
    """Labels and sparse features of the sample in flat arrays: row k has the entries from
    ``offsets[k]`` to ``offsets[k + 1]``."""

    y: np.ndarray
    offsets: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.y)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.offsets[k], self.offsets[k + 1])
        return self.idx[at], self.val[at]

    @classmethod
    def of(cls, y, rows: list[tuple[np.ndarray, np.ndarray]]) -> "Sample":
        return cls(np.asarray(y, dtype=np.float64), np.cumsum([0, *(len(i) for i, _ in rows)]),
                   np.concatenate([np.zeros(0, np.int32), *(i for i, _ in rows)]),
                   np.concatenate([np.zeros(0, np.float32), *(v for _, v in rows)]))


def features_of_sample(docs: DataFrame, ids: DataFrame, featurize, id_col: str = "doc_id",
                       text_col: str = "text") -> Sample:
    """The sample's documents, whole texts, in order of the id; ``featurize`` maps a text to
    (indices, values). The sample's ids are broadcast (at most ``TRAIN_ROWS``), so no text
    is shuffled."""
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .join(F.broadcast(ids), F.col("id") == F.col("t_id")).select("id", "y", "text"))
    out = StructType([rows.schema["id"], rows.schema["y"],
                      StructField("idx", ArrayType(IntegerType())),
                      StructField("val", ArrayType(FloatType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            got = [featurize(t) for t in texts_of(b.column(2))]
            offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in got)]), pa.int32())
            idx = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in got)]).astype(np.int32)
            val = np.concatenate([np.zeros(0, np.float32), *(v for _, v in got)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(idx)),
                 pa.ListArray.from_arrays(offsets, pa.array(val))], schema=arrow)
        free_memory()

    got = rows.mapInArrow(run, out).toArrow()
    got = got.take(pc.sort_indices(got.column("id"))).combine_chunks()
    lists, values = got.column("idx").combine_chunks(), got.column("val").combine_chunks()
    return Sample(got.column("y").to_numpy().astype(np.float64), lists.offsets.to_numpy(),
                  lists.values.to_numpy(), values.values.to_numpy())


def arrow_scores(texts: Column, of_text, done) -> Column:
    """Scores from the logits that ``of_text`` gives, batch by batch; ``done`` runs after the last
    one and frees what the worker no longer needs."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            z = np.fromiter(map(of_text, texts_of(batch)), dtype=np.float64, count=len(batch))
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        done()
        free_memory()

    return score(texts.cast("string"))


def shift_to_threshold(z: np.ndarray, y: np.ndarray, threshold: float = 0.7) -> float:
    """Offset of the logit so that ``threshold`` on the probability is where the training
    sample's balanced error is least (the middle of that gap)."""
    if not len(z) or y.min() == y.max():
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    miss = np.concatenate([[0], np.cumsum(y)]) / y.sum()          # label 1 below the cut
    false = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()   # label 0 above it
    err = miss + false
    err[1:-1][z[1:] <= z[:-1] + 1e-9] = np.inf      # a cut never parts equal scores
    best = np.flatnonzero(err <= err.min() + 1e-12)
    k = int(best[len(best) // 2])
    low = z[k - 1] if k else z[0] - 2.0
    high = z[k] if k < len(z) else z[-1] + 2.0
    return float(np.log(threshold / (1 - threshold)) - (low + high) / 2)
