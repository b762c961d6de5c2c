"""Near-duplicate detection: one-permutation hashing with optimal densification, banded
buckets and star-shaped candidate edges, confirmed on full shingle sets.

1. Each text becomes the set of its distinct ``k``-word shingles (64-bit hashes). One hash
   of each shingle gives its bin and its rank there; a bin keeps its minimum. An empty bin
   takes the value of the bin that its own hash sequence meets first among the filled ones
   (optimal densification), so short texts have full signatures too.
2. Rows with equal sets are one class from here on. ``BANDS`` bands of ``BAND_ROWS`` bins
   are hashed into buckets; a pair at similarity 0.8 misses all of them with probability
   (1 - 0.8^5)^32, about 3 in a million.
3. In every bucket the member with the largest total bucket size is the hub, and each other
   member gets one candidate edge to it, so edges grow with rows, not with pairs.
4. Candidate edges are confirmed on the full sets; links join classes into components.
5. A star may hide a link between two members that are both unlike its hub. Buckets that then
   still hold several components are joined into clusters of candidates, and every cluster is
   finished exactly: its rows are dealt into blocks of bounded size, each pair of blocks is one
   unit of work that counts all common shingles by a matrix product and returns a spanning
   forest of the links between different components. Rows of the cluster's main component
   are compared with the others only. So nothing is capped, no pairs are emitted, and
   groups of thousands of copies, which become one component with the first star, cost one
   edge a row.

Sets are built again only for the members of shared buckets, and no fingerprint, link or
component leaves the executors. Components are found by alternating large-star and
small-star steps on checkpointed links.

Defined cases: null, empty and blank texts have the empty set, link with nothing and form
components of their own (``component_id`` is their own id). A text with fewer words than a
shingle has its whole word sequence as the only shingle. Rows are told apart by their place, so
rows with equal or null ids are compared like all others; ids may be of any type that has an
order. A null id is never the smallest: ``component_id`` is null only where all ids are. Other
columns are not read, so none can clash. Very long texts cost memory in proportion to their
words, one at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StructField, StructType)

from ..session import cut_lineage
from .common import free_memory, texts_of

SHINGLE_WORDS = 4
BANDS, BAND_ROWS = 32, 5
BINS = BANDS * BAND_ROWS
PERCENT = 80
SEED = 0x9E3779B97F4A7C15
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 300, 120_000, 4096
WORD_TABLE = 150_000
ATTEMPTS = 256
TASK_LINKS = 50_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hash per word, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes. ``bytes.lower`` changes A-Z only, and ``bytes.split``
    splits on space and 0x09 to 0x0D only, as the contract has it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=n)
    m = max(1, n - k + 1)
    acc = np.zeros(m, dtype=_U)
    for j in range(min(k, n)):
        acc = _mix(acc * _U(0xD6E8FEB86659FD93) + h[j:j + m] + _U(j + 1))
    if n < k:
        acc = _mix(acc + _U(SEED) * _U(n))
    return np.unique(acc)


def _attempts(bins: int, n: int) -> np.ndarray:
    i = np.arange(bins, dtype=_U)[None, :] + _U(1)
    t = np.arange(n, dtype=_U)[:, None] + _U(1)
    return (_mix(_mix(i * _U(SEED)) ^ (t * _U(0xC2B2AE3D27D4EB4F))) % _U(bins)).astype(np.int64)


_STARTS = np.array([b * ((1 << 64) // BINS + 1) for b in range(BINS)], dtype=_U)
_CANDIDATES = _attempts(BINS, ATTEMPTS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` values of a non-empty set."""
    ranks = np.sort(_mix(shingles ^ _U(SEED)))
    first = np.searchsorted(ranks, _STARTS)
    last = np.append(first[1:], len(ranks))
    filled = first < last
    values = np.where(filled, ranks[np.minimum(first, len(ranks) - 1)], _U(0))
    if filled.all():
        return values
    empty = np.flatnonzero(~filled)
    donor = np.full(len(empty), -1, dtype=np.int64)
    tried = 0
    table = _CANDIDATES
    while True:
        open_ = np.flatnonzero(donor < 0)
        hit = filled[table[:, empty[open_]]]
        found = hit.any(axis=0)
        at = hit.argmax(axis=0)
        donor[open_[found]] = table[at[found], empty[open_[found]]]
        if (donor >= 0).all():
            break
        tried += 1
        table = _attempts(BINS, ATTEMPTS * (1 << tried))  # the same sequences, continued
    values[empty] = values[donor]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = values.reshape(BANDS, BAND_ROWS)
    acc = np.arange(BANDS, dtype=_U) * _U(SEED)
    for j in range(BAND_ROWS):
        acc = _mix(acc ^ rows[:, j]) + _U(j + 1)
    return _mix(acc).view(np.int64)


def _sign(batches, k: int, schema: pa.Schema):
    for batch in batches:
        n, digest, keys, lengths = [], [], [], []
        for text in texts_of(batch.column(2)):
            s = shingle_set(text, k)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, dtype=np.int64))
            lengths.append(len(keys[-1]))
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
        offsets = pa.array(np.cumsum([0, *lengths]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], schema=schema)
    _WORDS.clear()
    free_memory()


def _sets(batches, k: int, schema: pa.Schema):
    for batch in batches:
        sets = [shingle_set(t, k).view(np.int64) for t in texts_of(batch.column(1))]
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))],
            schema=schema)
    _WORDS.clear()
    free_memory()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """``id, text_key, n_shingles, digest`` (of the set, null if empty) and ``bands`` from ``id,
    text_key, text``."""
    out = StructType([docs.schema["id"], docs.schema["text_key"], StructField("n_shingles", LongType()),
                      StructField("digest", BinaryType()),
                      StructField("bands", ArrayType(LongType()))])
    arrow = to_arrow_schema(out)
    return docs.mapInArrow(lambda it: _sign(it, k, arrow), out)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    out = StructType([docs.schema["id"], StructField("shingles", ArrayType(LongType()))])
    arrow = to_arrow_schema(out)
    return docs.mapInArrow(lambda it: _sets(it, k, arrow), out)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of all nodes but the smallest ones, from
    ``a, b``, by large-star and small-star steps: aggregates and joins that AQE may split. The
    links are checkpointed after each pass, and the loop ends when one changes nothing. A pass runs
    in as many tasks as its links need, not in as many as the session has shuffle partitions."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    least = 2 * links.sparkSession.sparkContext.defaultParallelism

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    now, before = state(edges), None
    while now != before and now["n"]:
        n = max(least, -(-now["n"] // TASK_LINKS))
        edges = edges.coalesce(n)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(n)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("merge")
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n).distinct().coalesce(n))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .union(low.select("u", F.col("m").alias("v")))
                            .where("u <> v").coalesce(n).distinct().coalesce(n))
        before, now = now, state(edges)
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs ``a, b`` that are links. Sizes alone rule many out, before any
    set is moved."""
    s = sizes.select(F.col("id").alias("s_id"), F.col("n_shingles").alias("s_n"))
    sized = (pairs.join(s, F.col("a") == F.col("s_id")).withColumnRenamed("s_n", "n_a").drop("s_id")
             .join(s, F.col("b") == F.col("s_id")).withColumnRenamed("s_n", "n_b").drop("s_id")
             .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = sized.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (both.withColumn("common", common)
            .where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
            .select("a", "b"))


def _star(members: DataFrame) -> DataFrame:
    """Distinct pairs of each bucket's hub (its member with the largest total bucket size) and
    another member."""
    best = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("m"))).alias("h"))
    hubs = best.select("bucket", (-F.col("h.m")).alias("hub"))
    pairs = members.join(hubs, "bucket").where(F.col("id") != F.col("hub"))
    return cut_lineage(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).withColumnRenamed("node", "id")
    return members.drop("component").join(comp, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets (of more than two rows) that hold several components."""
    open_ = members.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.max("members").alias("n")).where((F.col("lo") != F.col("hi")) & (F.col("n") > 2))
    return members.join(open_.select("bucket"), "bucket", "left_semi")


def _block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between rows of part 0 and of part 1 (or among part 0,
    if that is all) with different components."""
    def side(part: int):
        rows = pdf[pdf["part"] == part].sort_values("id")
        sets = [np.asarray(x, dtype=np.int64) for x in rows["shingles"]]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        return rows["id"].to_numpy(), rows["component"].to_numpy(), n, np.concatenate(
            [np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), n)

    left = side(0)
    right = side(1) if (pdf["part"] == 1).any() else left
    shared = np.intersect1d(left[3], right[3])
    common = np.zeros((len(left[0]), len(right[0])), dtype=np.float32)
    placed = []
    for _, _, _, shingles, row in (left, right):
        at = np.searchsorted(shared, shingles)
        at[at == len(shared)] = 0
        hit = shared[at] == shingles if len(shared) else np.zeros(len(shingles), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], row[hit][order]))
    for low in range(0, len(shared), COLUMNS):
        dense = []
        for (at, row), (ids, *_) in zip(placed, (left, right), strict=True):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            x = np.zeros((len(ids), COLUMNS), dtype=np.float32)
            x[row[i:j], at[i:j] - low] = 1
            dense.append(x)
        common += dense[0] @ dense[1].T
    union = left[2][:, None] + right[2][None, :] - common
    linked = (100 * common >= percent * union) & (left[1][:, None] != right[1][None, :])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    out = []
    for i, j in np.argwhere(linked):
        x, y = root(int(left[1][i])), root(int(right[1][j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(left[0][i]), int(right[0][j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _cluster_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among candidates that share a bucket, directly or
    through others."""
    first = members.groupBy("bucket").agg(F.min("id").alias("a"))
    near = members.select("bucket", F.col("id").alias("b")).join(first, "bucket").select("a", "b")
    clusters = components(near.union(first.select("a", F.col("a").alias("b"))))
    rows = members.select("id", "component").distinct().join(
        clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id", "left")
    rows = rows.withColumn("cluster", F.coalesce("cluster", "id")).join(sets, "id").withColumn(
        "n", F.size("shingles"))
    rows = cut_lineage(rows)
    sums = rows.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    total = sums.groupBy("cluster").agg(
        F.max(F.struct("rows", "n", "component")).alias("main"),
        F.sum("n").alias("all_n"), F.sum("rows").alias("all_rows"))

    def blocks(n, rows):
        return F.greatest(F.ceil(n / BLOCK_SHINGLES), F.ceil(rows / BLOCK_ROWS), F.lit(1)).cast("int")

    total = total.select("cluster", F.col("main.component").alias("main"),
                         blocks(F.col("all_n") - F.col("main.n"), F.col("all_rows") - F.col("main.rows")).alias("p"),
                         blocks(F.col("main.n"), F.col("main.rows")).alias("q"))
    dealt = rows.join(total, "cluster")
    of = F.pmod(F.xxhash64("id"), F.when(F.col("component") == F.col("main"), F.col("q"))
                .otherwise(F.col("p"))).cast("int")
    dealt = dealt.withColumn("block", of)
    k = F.lit(1).cast("int")
    unit = lambda kind, x, y, part: F.struct(
        F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(part).alias("part"))
    me, p, q = F.col("block"), F.col("p"), F.col("q")
    side_units = F.concat(
        F.transform(F.sequence(F.lit(0), p - k), lambda o: F.when(o < me, unit("s", o, me, 1)).otherwise(
            unit("s", me, o, 0))),
        F.transform(F.sequence(F.lit(0), q - k), lambda o: unit("m", me, o, 0)))
    main_units = F.transform(F.sequence(F.lit(0), p - k), lambda o: unit("m", o, me, 1))
    units = dealt.select("cluster", "id", "component", "shingles", F.explode(
        F.when(F.col("component") == F.col("main"), main_units).otherwise(side_units)).alias("u"))
    # dealt by unit: the join has left all rows of a cluster in one task
    unit_key = ["cluster", "kind", "x", "y"]
    return units.select("cluster", "u.*", "id", "component", "shingles").repartition(*unit_key).groupBy(
        *unit_key).applyInPandas(
        lambda pdf: _block_links(pdf, percent), "a bigint, b bigint")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key`` (of the whole text) and ``text``: the first two say which row is meant."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"),
                       text.alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``, and ``text_key, stays``: of each
    component the row of least id stays (ids before nulls)."""
    narrow = keyed(docs, id_col, text_col)
    sign = cut_lineage(signed(narrow, k).withColumn("at", F.monotonically_increasing_id()))
    rows = sign.select("id", "text_key", "n_shingles", "digest", "at")
    # equal sets are one node from here on, named by the place of one of its rows
    classes = cut_lineage(rows.where("digest is not null").groupBy("digest").agg(
        F.min("at").alias("node"), F.max("n_shingles").alias("n_shingles"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("low")))
    reps = sign.join(classes.select("node"), F.col("at") == F.col("node"))
    banded = cut_lineage(reps.select(F.col("node").alias("id"), F.explode("bands").alias("bucket")))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    banded = cut_lineage(banded.join(shared, "bucket"))
    degree = banded.groupBy("id").agg(F.sum("members").alias("degree"))
    banded = cut_lineage(banded.join(degree, "id"))

    wanted = rows.join(banded.select(F.col("id").alias("node")).distinct(), F.col("at") == F.col("node")).select(
        "node", F.col("id").alias("w_id"), F.col("text_key").alias("w_key"))
    same = (F.col("text_key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id"))
    texts = narrow.join(wanted, same).select(F.col("node").alias("id"), "text")
    sets = cut_lineage(shingle_sets(texts, k).dropDuplicates(["id"]))  # repeated rows give one set
    members = banded.withColumn("component", F.col("id"))
    sizes = classes.select(F.col("node").alias("id"), "n_shingles")
    links = cut_lineage(_confirmed(_star(members), sets, sizes, percent))
    members = cut_lineage(_mixed(_with_components(members, links)))
    links = cut_lineage(links.union(_cluster_links(members, sets, percent)))
    final = components(links).withColumnRenamed("node", "f_node")
    placed = classes.join(final, F.col("node") == F.col("f_node"), "left").select(
        F.col("digest").alias("c_digest"), F.coalesce("component", "node").alias("component"), "low")
    lows = placed.groupBy(F.col("component").alias("l_component")).agg(F.min("low").alias("first"))
    class_of = placed.join(lows, F.col("component") == F.col("l_component")).select("c_digest", "first")
    out = rows.join(class_of, F.col("digest") == F.col("c_digest"), "left")
    return out.select(
        "id", "n_shingles", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        "text_key", (F.col("first").isNull() | (F.col("at") == F.col("first.at"))).alias("stays"))
