"""Best-fit packing by length patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` entries) reaches the driver. There

1. lengths are grouped into equal bins, and all multisets of up to ``max_docs`` bins that
   fill a sequence are enumerated as patterns;
2. an active-set non-negative least-squares fit gives repeat counts whose pattern sum is the
   histogram; the counts are rounded and held to what is there;
3. the residual lengths are packed best-fit-decreasing, on counts, first into the space that
   patterns leave and then into new sequences.

The plan is a list of ``(pattern, repeats)``, its size bounded by the capacity, whatever the
number of documents. Spark then gives each piece its place: a rank among the pieces of its
length, and the plan's interval that holds this rank. Ranks come from counts per (length,
bucket), so the pieces of a hot length spread over many tasks.

Defined cases: an empty table gives an empty result; repeated rows get a place each; ties
among equal lengths are broken by id, piece and digest, nulls first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

BINS = 256
MAX_DOCS = 3
BUCKET_ROWS = 2000


def fill_patterns(present: list[int], full: int, max_docs: int) -> np.ndarray:
    """All multisets of 1 to ``max_docs`` of the ``present`` bins with the sum ``full``, as
    rows of counts per bin (column b-1 for bin b)."""
    have = sorted(present)
    is_there = set(have)
    rows = []
    for k in range(1, max_docs + 1):
        for head in itertools.combinations_with_replacement(have, k - 1):
            last = full - sum(head)
            if last in is_there and (not head or last >= head[-1]):
                rows.append((*head, last))
    counts = np.zeros((len(rows), full), dtype=np.float64)
    for i, r in enumerate(rows):
        for b in r:
            counts[i, b - 1] += 1
    return counts


def nnls(a: np.ndarray, b: np.ndarray, max_iter: int = 1000) -> np.ndarray:
    """Active-set solution of min |a x - b| with x >= 0 (normal equations)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    g = a.T @ b
    tol = 1e-9 * max(1.0, np.abs(g).max(initial=0.0))
    for _ in range(max_iter):
        w = g - a.T @ (a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12]
            x[gone] = 0
            active[gone] = False
            if not len(gone):
                break
    return x


def fit_patterns(hist: dict[int, int], capacity: int, bins: int = BINS,
                 max_docs: int = MAX_DOCS) -> list[tuple[dict[int, int], int]]:
    """Sequences as ``({length: pieces of that length}, repeats)``."""
    left = {int(k): int(v) for k, v in hist.items() if v > 0}
    step = -(-capacity // bins)
    full = capacity // step
    of_bin: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        of_bin.setdefault(-(-length // step), []).append(length)
    count = {b: sum(left[x] for x in ls) for b, ls in of_bin.items()}
    plan: list[tuple[dict[int, int], int]] = []
    usable = [b for b in count if b <= full]
    patterns = fill_patterns(usable, full, max_docs)
    target = np.array([count.get(b, 0) for b in range(1, full + 1)], dtype=np.float64)
    repeats = nnls(patterns.T.copy(), target) if len(patterns) else np.zeros(0)
    for i in np.argsort(-repeats, kind="stable"):
        want = int(round(repeats[i]))
        if want <= 0:
            break
        need = {b + 1: int(c) for b, c in enumerate(patterns[i]) if c}
        want = min([want, *(count[b] // c for b, c in need.items())])
        slots = [b for b, c in need.items() for _ in range(c)]
        for b, c in need.items():
            count[b] -= c * want
        while want > 0:  # the longest lengths of each bin first; runs of equal lengths together
            lengths, runs = {}, [want]
            for b in slots:
                x = next(x for x in of_bin[b] if left[x] - lengths.get(x, 0) > 0)
                lengths[x] = lengths.get(x, 0) + 1
            runs += [left[x] // c for x, c in lengths.items()]
            r = max(1, min(runs))
            for x, c in lengths.items():
                left[x] -= c * r
            plan.append((lengths, r))
            want -= r
            for b in set(slots):
                of_bin[b] = [x for x in of_bin[b] if left[x]]
    return pack_residual(left, plan, capacity)


def pack_residual(left: dict[int, int], plan: list, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit-decreasing on counts: every length, longest first, goes where the least space
    would remain; sequences in the same state are handled together."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for lengths, r in plan:
        by_room.setdefault(capacity - sum(x * c for x, c in lengths.items()), []).append((lengths, r))
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = capacity // length
                r, rest = divmod(n, each)
                if r:
                    by_room.setdefault(capacity - each * length, []).append(({length: each}, r))
                if rest:
                    by_room.setdefault(capacity - rest * length, []).append(({length: rest}, 1))
                break
            lengths, r = by_room[room].pop()
            each = min(room // length, n)
            used = min(r, n // each)
            if used < r:
                by_room[room].append((lengths, r - used))
            elif not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - each * length, []).append(
                (lengths | {length: lengths.get(length, 0) + each}, used))
            n -= used * each
    return [x for room in sorted(by_room) for x in by_room[room]]


def _intervals(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Slots of the plan in order, per length: first rank, first sequence, offset, pieces of
    the length in a sequence. Sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, r in plan:
        offset = 0
        for x, c in sorted(lengths.items(), reverse=True):
            low = used.get(x, 0)
            rows.append((x, low, sequence, offset, c))
            used[x] = low + c * r
            offset += x * c
        sequence += r
    rows.sort()
    names = ("length", "low", "sequence", "offset", "each")
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(names, columns, strict=True))


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("id", "piece"),
         bins: int = BINS, max_docs: int = MAX_DOCS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``. The
    rows should be cheap to read again (a table or a checkpoint)."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in
            pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _intervals(fit_patterns(hist, capacity, bins, max_docs))
    total = sum(hist.values())
    bucket_rows = max(BUCKET_ROWS, int(total ** 0.5))
    parts = spark.createDataFrame(
        [(int(x), max(1, -(-n // bucket_rows))) for x, n in hist.items()] or [(0, 1)],
        "p_length bigint, parts bigint")  # at most ``capacity`` rows
    dealt = pieces.join(F.broadcast(parts), F.col("length") == F.col("p_length")).withColumn(
        "bucket", F.pmod(F.xxhash64(*pieces.columns), F.col("parts"))).drop("p_length", "parts")
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket",
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("length", "bucket").orderBy(*keys)
    ranked = (dealt.withColumn("rn", F.row_number().over(inside))
              .join(firsts, ["length", "bucket"])
              .withColumn("rank", F.col("first") + F.col("rn") - 1))
    span = np.int64(1) << np.int64(45)
    starts = slots["length"] * span + slots["low"]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        x, k = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(starts, x * span + k, side="right") - 1
        k = k - slots["low"][i]
        return pd.DataFrame({"sequence_id": slots["sequence"][i] + k // slots["each"][i],
                             "offset": slots["offset"][i] + k % slots["each"][i] * x})

    return (ranked.withColumn("at", place("length", "rank"))
            .select(*pieces.columns, "at.sequence_id", "at.offset"))


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = 4096, **tokens) -> DataFrame:
    """Pieces of all documents with their places; ``ids_crc32`` stands for the ids, which
    ``tokens.tokenized_pieces`` gives again for any piece."""
    from .tokens import tokenized_pieces

    pieces = tokenized_pieces(docs, id_col, text_col, max_len=capacity, **tokens).select(
        "id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut_lineage(pieces), capacity)
