"""WARC fixity audit with Merkle trees.

Every record is hashed (SHA-256 of its bytes). A leaf node covers a fixed range of byte offsets
of one file and hashes its records in offset order; a node of the next level hashes ``FANOUT``
neighbouring nodes, up to one root per file. Two replicas are compared by their roots; only
below unequal nodes are children looked at, level by level, down to the records. Nodes are
keyed by offset ranges, not by record numbers, so a lost record changes one path and not all
that follow.

All steps are aggregates and joins on (file, node). A leaf holds at most the records that start
in ``RANGE_BYTES`` bytes and an inner node at most ``FANOUT`` children, whatever the size of a
file, so a file with a third of all records spreads like any other.

Defined cases: records are collapsed by (file, offset, length, digest) with a count of copies
first, so repeated rows change a hash only through that count. Null offsets and null digests are
kept and compare like any other value (range -1, empty digest); a null file is a file of its own.
An empty replica makes every record of the other missing or extra; two empty ones give an
empty result. Very long records are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import cumulative_counts
from ..session import cut_lineage

RANGE_BYTES = 64 * 1024
FANOUT = 16
PAGES_PER_FILE = 1024


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.1 response record as text."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records_of_pages(pages: DataFrame, copy_html: str = "html",
                     per_file: int = PAGES_PER_FILE) -> DataFrame:
    """The pages as records of WARC files: ``file, offset, length, copies, digest, page_id, url``,
    and ``copy_digest``, the digest of the record that a replica holds there with the payload
    ``copy_html``. A file holds ``per_file`` consecutive page ids, its records in order of id, url
    and digest; offsets are running sums, found by the chunked prefix sums of
    ``operators.ranks``."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    copy = warc_record(F.col("page_id"), F.col("url"), F.col(copy_html))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("bigint").alias("file"),
        F.struct("page_id", "url", F.sha2(record, 256).alias("digest"),
                 F.octet_length(record).cast("bigint").alias("length"),
                 F.sha2(copy, 256).alias("copy_digest")).alias("record"))
    placed = cumulative_counts(rows, ["file"], "record", {
        "copies": F.lit(1), "bytes": F.col("record.length")})
    return placed.select("file", (F.col("cum_bytes") - F.col("bytes")).alias("offset"),
                         F.col("record.length").alias("length"), "copies",
                         F.col("record.digest").alias("digest"),
                         F.col("record.copy_digest").alias("copy_digest"),
                         F.col("record.page_id").alias("page_id"), F.col("record.url").alias("url"))


def leaf_nodes(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, node, hash`` of the leaf level."""
    entry = F.struct("offset", "length", "copies", "digest")
    line = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.concat_ws(
        ":", x["offset"].cast("string"), x["length"].cast("string"), x["copies"].cast("string"), x["digest"]))
    return records.groupBy("file", node_of(F.col("offset"), range_bytes).alias("node")).agg(
        F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def node_of(offset: Column, range_bytes: int) -> Column:
    return F.coalesce(F.floor(offset / range_bytes), F.lit(-1)).cast("bigint")


def parent_nodes(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    line = F.transform(children, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))
    return nodes.groupBy("file", F.floor(F.col("node") / fanout).cast("bigint").alias("node")).agg(
        F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def merkle_levels(records: DataFrame, n_levels: int, range_bytes: int, fanout: int) -> list[DataFrame]:
    levels = [cut_lineage(leaf_nodes(records, range_bytes))]
    for _ in range(n_levels - 1):
        levels.append(cut_lineage(parent_nodes(levels[-1], fanout)))
    return levels


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that differ or that only one tree has."""
    left = a.select(F.col("file").alias("fa"), F.col("node").alias("na"), F.col("hash").alias("ha"))
    right = b.select(F.col("file").alias("fb"), F.col("node").alias("nb"), F.col("hash").alias("hb"))
    both = left.join(right, F.col("fa").eqNullSafe(F.col("fb")) & (F.col("na") == F.col("nb")), "full")
    # every real node has a hash, so a null one means that this tree lacks the node
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(
        F.when(F.col("ha").isNull(), F.col("fb")).otherwise(F.col("fa")).alias("file"),
        F.coalesce("na", "nb").alias("node"))


def _below(nodes: DataFrame, parents: DataFrame, parent: Column) -> DataFrame:
    p = parents.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
    return nodes.join(p, F.col("file").eqNullSafe(F.col("p_file")) & (parent == F.col("p_node")), "left_semi")


def fixity_audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES,
                 fanout: int = FANOUT) -> DataFrame:
    """Records that differ: ``file, offset, status`` (changed, missing or extra in the replica),
    ``primary_length, replica_length, primary_digest, replica_digest`` and, per side, every other
    column of the records as a struct ``primary`` or ``replica``. Several records at one offset
    are compared as a set."""
    key = ["file", "offset", "length", "copies", "digest"]

    def prepared(df: DataFrame) -> DataFrame:
        df = df.withColumn("digest", F.coalesce(F.col("digest").cast("string"), F.lit("")))
        if "copies" not in df.columns:
            df = df.withColumn("copies", F.lit(1))
        other = [c for c in df.columns if c not in key]
        info = F.struct(*other) if other else F.struct(F.lit(None).cast("string").alias("none"))
        return cut_lineage(df.groupBy("file", "offset", "length", "digest").agg(
            F.sum("copies").cast("bigint").alias("copies"), F.min(info).alias("info")))

    a, b = prepared(primary), prepared(replica)
    top = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    n_levels, nodes = 1, top // range_bytes + 1
    while nodes > 1:
        n_levels, nodes = n_levels + 1, -(-nodes // fanout)
    trees = [merkle_levels(x, n_levels + 1, range_bytes, fanout) for x in (a, b)]
    found = cut_lineage(_unequal(trees[0][-1], trees[1][-1]))
    for left, right in zip(reversed(trees[0][:-1]), reversed(trees[1][:-1]), strict=True):
        parent = F.floor(F.col("node") / fanout)
        found = cut_lineage(_unequal(_below(left, found, parent), _below(right, found, parent)))
    at = node_of(F.col("offset"), range_bytes)

    def side(df: DataFrame, name: str) -> DataFrame:
        return _below(df, found, at).select(
            F.col("file").alias(f"{name}_file"), F.col("offset").alias(f"{name}_offset"),
            F.col("length").alias(f"{name}_length"), F.col("digest").alias(f"{name}_digest"),
            F.col("copies").alias(f"{name}_copies"), F.col("info").alias(name))

    left, right = side(a, "primary"), side(b, "replica")
    same = [F.col(f"primary_{c}").eqNullSafe(F.col(f"replica_{c}")) for c in ("file", "offset", "length", "digest", "copies")]
    only_a = left.join(right, same[0] & same[1] & same[2] & same[3] & same[4], "left_anti")
    only_b = right.join(left, same[0] & same[1] & same[2] & same[3] & same[4], "left_anti")
    pairs = only_a.join(only_b, same[0] & same[1], "full")
    has_a, has_b = F.col("primary_digest").isNotNull(), F.col("replica_digest").isNotNull()
    return pairs.select(
        F.when(has_a, F.col("primary_file")).otherwise(F.col("replica_file")).alias("file"),
        F.when(has_a, F.col("primary_offset")).otherwise(F.col("replica_offset")).alias("offset"),
        F.when(has_a & has_b, "changed").when(has_a, "missing").otherwise("extra").alias("status"),
        "primary_length", "replica_length", "primary_digest", "replica_digest", "primary", "replica")
