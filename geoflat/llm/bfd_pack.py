"""Packed token matrices: best-fit-decreasing with a segment tree over free capacity.

Documents are dealt by a hash of id and text into shards of about ``SHARD_CHARS`` characters
(their number follows the corpus, so a shard always fits one task). In a shard the pieces
are taken longest first; a segment tree over capacities 0 to ``capacity`` finds the fullest
row that still has room, or a new row is opened. A row of the result is one row of the id
matrix: ids padded to the capacity, cumulative segment lengths, and positions that start
again at 0 with every segment, plus the document, piece and start of each segment, so the
documents can be put together again without loss.

Defined cases: null and empty texts are one piece with the end id. Overlong documents are
cut into pieces of the capacity. Repeated rows are packed as often as they occur. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory
from .tokens import END_ID, MAX_LEN, VOCABULARY, encoded_texts

SHARD_CHARS = 12_000_000
PAD_ID = 0


class CapacityTree:
    """Free capacities that occur among the open rows, with the smallest one of at least a
    given size found in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = free + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a fullest row with at least ``need`` free, removed; None if none."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; each row's lengths sum to at most ``capacity``."""
    tree, rows = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable"):
        x = int(lengths[i])
        found = tree.take(x)
        if found is None:
            free, row = capacity, len(rows)
            rows.append([])
        else:
            free, row = found
        rows[row].append(int(i))
        if free > x:
            tree.add(free - x, row)
    return rows


def _pack_shard(table: pa.Table, capacity: int, vocabulary: str, end_id: int, pad_id: int,
                schema: pa.Schema):
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    doc, piece, data = [], [], []
    texts = table.column("text").combine_chunks()
    for k, ids in enumerate(encoded_texts(texts, vocabulary, end_id)):
        for p in range(-(-len(ids) // (4 * capacity))):
            doc.append(k), piece.append(p), data.append(ids[4 * p * capacity:4 * (p + 1) * capacity])
    lengths = np.array([len(x) // 4 for x in data], dtype=np.int64)
    rows = best_fit_decreasing(lengths, capacity)
    ids_of = table.column("id").combine_chunks()
    shard = table.column("shard")[0].as_py() if table.num_rows else 0
    pad = np.array([pad_id], dtype="<u4").tobytes()
    count, zeros = np.arange(capacity, dtype="<u4").tobytes(), bytes(4 * capacity)
    for low in range(0, len(rows), 256):
        part = rows[low:low + 256]
        ends = [np.cumsum([0, *lengths[r]]) for r in part]
        matrix = [b"".join([data[i] for i in r]) + pad * (capacity - int(e[-1]))
                  for r, e in zip(part, ends, strict=True)]
        position = [b"".join([count[:len(data[i])] for i in r]) + zeros[:4 * (capacity - int(e[-1]))]
                    for r, e in zip(part, ends, strict=True)]
        offsets = pa.array(np.cumsum([0, *map(len, part)]), pa.int32())
        flat = [i for r in part for i in r]
        docs = ids_of.take(pa.array([doc[i] for i in flat], pa.int32()))
        yield pa.RecordBatch.from_arrays([
            pa.array([shard] * len(part), pa.int64()),
            pa.array(range(low, low + len(part)), pa.int64()),
            pa.array(matrix, pa.binary()),
            pa.array([e.tolist() for e in ends], pa.list_(pa.int32())),
            pa.array(position, pa.binary()),
            pa.ListArray.from_arrays(offsets, docs),
            pa.ListArray.from_arrays(offsets, pa.array([piece[i] for i in flat], pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array([piece[i] * capacity for i in flat], pa.int64())),
        ], schema=schema)


def packed_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = MAX_LEN, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                  pad_id: int = PAD_ID, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per matrix row: ``shard, row_in_shard, ids`` (capacity little-endian unsigned
    32-bit ids), ``cu_seqlens, position_ids`` (as ids), ``seg_doc, seg_piece, seg_start``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField,
                                   StructType)

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    chars = narrow.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    id_type = narrow.schema["id"].dataType
    out = StructType([
        StructField("shard", LongType()), StructField("row_in_shard", LongType()),
        StructField("ids", BinaryType()), StructField("cu_seqlens", ArrayType(IntegerType())),
        StructField("position_ids", BinaryType()), StructField("seg_doc", ArrayType(id_type)),
        StructField("seg_piece", ArrayType(IntegerType())),
        StructField("seg_start", ArrayType(LongType()))])
    arrow = to_arrow_schema(out)

    def pack_shard(table: pa.Table) -> pa.Table:
        batches = list(_pack_shard(table, capacity, vocabulary, end_id, pad_id, arrow))
        free_memory()
        return pa.Table.from_batches(batches, schema=arrow)

    return dealt.groupBy("shard").applyInArrow(pack_shard, out)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Writes the matrix rows as Parquet, in shard and row order inside each file."""
    packed.sortWithinPartitions("shard", "row_in_shard").write.mode("errorifexists").parquet(path)
