"""Conversation structure repair: cheapest edits, then prefix-doubling path ranking.

A conversation should read as an optional system turn and then user and assistant turns in pairs:
role initials ``(s?(ua)+)?``. Edits of a turn: keep it (K, free), give it the role user or
assistant (R, 3), delete it (D, 4); and an empty turn can be inserted anywhere (I, 3). Blank turns
and repeated ones (same role and text earlier in the conversation) must be deleted; a truncated
turn that stays costs 3 more. Of the cheapest ways, the one whose initials come first in ASCII wins.

1. Turns are ordered by range partitioning on (conversation, turn, role, text, place in the
   input), so a conversation of any size is cut into blocks, each in one task, and is checkpointed.
2. A cost DP runs backwards over (turn, state) nodes; the states are: nothing yet, after system,
   after user, after assistant. Arcs that lie on a cheapest path are the optimal arcs.
3. Each optimal arc is a node of the ranking. Its first rank is its initial; its rank for the
   doubled length is the rank of the pair (own rank, least rank of the arcs that follow after that
   many edits), and its pointer doubles with it. When every pointer has run to the end, ranks are
   those of whole audits, and the least path is read off by doubling its list of arcs.
4. A conversation that lies in one task is finished there. For one that crosses tasks, each block
   gives the (min, +) matrix of costs between its first and last states; the matrices of a
   conversation are combined backwards, each block then ranks its arcs against the cost of what
   follows, and the state in which each block is entered is combined forwards. Block summaries are
   all that meets in one task, one row per input partition at most. Repetitions across blocks are
   found by an aggregate over (conversation, digest of role and text).

``repair`` gives the edits (one row each, with the repaired role and text) and a summary per
conversation. The summary hashes the repaired conversation; SHA-256 can only run in order, so one
task streams the edits of a conversation through it, holding the audit and one turn at a time.

Defined cases: null conversation ids are one conversation; null turns come first; null roles and
texts count as one space. Turns with equal numbers are taken by role, then text; equal rows are
interchangeable. Roles count by their first character, and a role without one (empty) is never
legal. Conversations marked as lost (``lost`` true on all rows) give zeros, an empty audit and the
hash of the empty string. Columns other than the four are not read, so none can clash. An empty
table gives an empty result. A turn is read whole, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BooleanType, ByteType, IntegerType, LongType, StringType,
                               StructField, StructType)

from ..session import cut_lineage
from .common import NOT_WS, WS, join_small

RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = np.int64(1) << np.int64(60)

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_AFTER_INSERT = (2, 2, 3, 2)
_AFTER_KEEP = {0: (1, None, None, None), 1: (2, 2, None, 2), 2: (None, None, 3, None), 3: (None,) * 4}
# At the end: nothing, "ua", "a" or nothing still to insert.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_LETTERS = "DIKR"  # in ASCII order
_D, _I, _K, _R = range(4)
KINDS = 16  # 4 initials (system, user, assistant, other) x 4 faults (none, blank, duplicate, truncated)


def _arc_table() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of the arcs D, K, R of each kind of turn in each state."""
    cost = np.full((KINDS, 4, 4), FAR, dtype=np.int64)
    to = np.zeros((KINDS, 4, 4), dtype=np.int64)
    for kind in range(KINDS):
        initial, fault = divmod(kind, 4)
        for s in range(4):
            cost[kind, s, _D], to[kind, s, _D] = DELETE, s
            if fault in (1, 2):
                continue
            more = TRUNCATED if fault == 3 else 0
            if _AFTER_KEEP[initial][s] is not None:
                cost[kind, s, _K], to[kind, s, _K] = more, _AFTER_KEEP[initial][s]
            cost[kind, s, _R], to[kind, s, _R] = RELABEL + more, _AFTER_INSERT[s]
    return cost, to


_COST, _TO = _arc_table()
_STEPS = [[[(int(_COST[k, s, a]), int(_TO[k, s, a])) for a in (_D, _K, _R) if _COST[k, s, a] < FAR]
           for s in range(4)] for k in range(KINDS)]


def _closed(v: list[int]) -> list[int]:
    """Costs with up to two inserts before the next turn."""
    a, b, c, d = v
    u, w = min(c, INSERT + d), min(d, INSERT + c)
    return [min(a, INSERT + u), min(b, INSERT + u), u, w]


def node_costs(kinds: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost to the end of the (boundary, state) nodes of many blocks one after the other. Block b
    has the turns ``kinds[first[b]:first[b + 1]]`` and one boundary more than turns; ``end[b]`` holds
    the costs at its last boundary."""
    out = np.empty((len(kinds) + len(first) - 1, 4), dtype=np.int64)
    for b in range(len(first) - 1):
        low, high = int(first[b]), int(first[b + 1])
        v = [int(x) for x in end[b]]
        out[high + b] = v
        rows = [v]
        for k in reversed(kinds[low:high].tolist()):
            steps = _STEPS[k]
            v = _closed([min([c + v[t] for c, t in steps[s]]) for s in range(4)])
            rows.append(v)
        rows.reverse()
        out[low + b:high + b + 1] = np.minimum(rows, FAR)
    return out


def block_matrix(kinds: np.ndarray) -> np.ndarray:
    """Least cost from each state before the block to each state after its last turn."""
    first = np.array([0, len(kinds)])
    out = np.empty((4, 4), dtype=np.int64)
    for e in range(4):
        end = np.full((1, 4), FAR, dtype=np.int64)
        end[0, e] = 0
        out[:, e] = node_costs(kinds, first, end)[0]
    return out


class LeastPaths:
    """Optimal arcs of many blocks, ranked by prefix doubling."""

    def __init__(self, kinds: np.ndarray, first: np.ndarray, end: np.ndarray, last_inserts: np.ndarray):
        """``last_inserts[b]``: the block ends its conversation, so turns may be inserted at its end."""
        blocks = len(first) - 1
        turns = np.diff(first)
        self.start = first[:-1] + np.arange(blocks)  # first boundary of each block
        last = self.start + turns
        value = node_costs(kinds, first, end)
        n = len(value)
        block = np.repeat(np.arange(blocks), turns + 1)
        is_last = np.zeros(n, dtype=bool)
        is_last[last] = True
        cost = np.full((n, 4, 4), FAR, dtype=np.int64)
        to = np.zeros((n, 4, 4), dtype=np.int64)
        inner = np.flatnonzero(~is_last)
        cost[inner], to[inner] = _COST[kinds], 4 * (inner + 1)[:, None, None] + _TO[kinds]
        may = ~is_last | last_inserts[block]
        cost[may, :, _I] = INSERT
        to[:, :, _I] = 4 * np.arange(n)[:, None] + np.array(_AFTER_INSERT)
        flat = value.reshape(-1)
        tight = (cost < FAR) & (value < FAR)[:, :, None] & (cost + flat[to] == value[:, :, None])
        node, letter = np.nonzero(tight.reshape(4 * n, 4))
        # one more arc at the end stands for "no edit follows"
        self.node, self.letter, self.to = node, letter, to.reshape(4 * n, 4)[node, letter]
        self.none = len(node)
        self.have = np.unique(node)  # nodes with arcs; those of a node lie together
        self.low = np.searchsorted(node, self.have)
        self.nodes = 4 * n
        self._rank()

    def _least(self, rank: np.ndarray) -> np.ndarray:
        """The arc of least rank out of each node; the arc "none" where there is no way on."""
        best = np.full(self.nodes, self.none, dtype=np.int64)
        if self.none:
            key = rank[:-1] * np.int64(self.none) + np.arange(self.none)
            best[self.have] = np.minimum.reduceat(key, self.low) % self.none
        return best

    def _rank(self) -> None:
        rank = np.concatenate([self.letter + 1, [0]])
        follow = np.concatenate([self.to, [0]])  # node where the arc's edits so far end
        stop = np.zeros(self.none + 1, dtype=bool)
        stop[-1] = True
        self.jumps = []
        while True:
            jump = np.where(stop, self.none, self._least(rank)[follow])
            self.jumps.append(jump)
            if (jump == self.none).all():
                break
            pair = rank * np.int64(self.none + 2) + rank[jump]
            follow, stop = follow[jump], stop | stop[jump] | (jump == self.none)
            rank = np.unique(pair, return_inverse=True)[1].reshape(-1)  # "none" stays 0
        self.rank = rank
        self.best = self._least(rank)

    def paths(self, block: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of the least paths from the given states at the given blocks' starts, as
        (path, arc), in order."""
        arc = self.best[4 * self.start[block] + state]
        path, at = np.arange(len(block)), np.zeros(len(block), dtype=np.int64)
        have = arc != self.none
        path, arc, at = path[have], arc[have], at[have]
        for k, jump in enumerate(self.jumps):
            ahead = jump[arc]
            on = ahead != self.none
            path = np.concatenate([path, path[on]])
            at = np.concatenate([at, at[on] + (1 << k)])
            arc = np.concatenate([arc, ahead[on]])
        order = np.lexsort((at, path))
        return path[order], arc[order]

    def exits(self) -> np.ndarray:
        """State after the last turn of block 0, from each state before it, on the least path."""
        out = np.arange(4)
        path, arc = self.paths(np.zeros(4, dtype=np.int64), np.arange(4))
        out[path] = self.to[arc] % 4  # the last edit of a path is written last
        return out


BLOCK_BITS = 15  # a block holds at most 2 ** 15 turns
CHUNK_ROWS, CHUNK_BYTES = 16_384, 16_000_000
ORDER = ("conv", "turn", "role", "text", "seen")


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str,
                  lost: Column | None = None) -> DataFrame:
    """All rows in order, checkpointed: ``conv, turn, role, text, lost``, the place ``at`` (its
    bits above 33 number the task) and the faults that a turn has on its own."""
    spark = rows.sparkSession
    turns = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))],
        (F.lit(False) if lost is None else lost).alias("lost"), F.monotonically_increasing_id().alias("seen"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sorted_ = turns.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).drop("seen")
    return cut_lineage(sorted_.select(
        "*", F.monotonically_increasing_id().alias("at"),
        (~F.col("text").rlike(NOT_WS)).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{WS}*+\z")).alias("truncated")))


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _changes(column) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal."""
    c = pa.compute
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        a, b = values[1:], values[:-1]
        differs = c.fill_null(c.not_equal(a, b), False)
        out[1:] = np.asarray(c.or_(differs, c.xor(c.is_null(a), c.is_null(b))), dtype=bool)
    return out


def _codes(initials) -> np.ndarray:
    found = pa.compute.index_in(initials, pa.array(["s", "u", "a"]))
    return np.asarray(pa.compute.fill_null(found, 3), dtype=np.int64)


EDIT_FIELDS = [StructField("block", LongType()), StructField("place", LongType()),
               StructField("action", StringType()), StructField("cost", IntegerType()),
               StructField("turn", LongType()), StructField("initial", StringType()),
               StructField("fault", ByteType()), StructField("role", StringType()),
               StructField("text", StringType())]


def _edit_arrays(paths: LeastPaths, kinds: np.ndarray, path: np.ndarray, arc: np.ndarray):
    """Per edit: its letter, the turn it takes (-1 for an insert), the role it gives and its cost."""
    letter = paths.letter[arc]
    boundary = paths.node[arc] // 4
    block = np.searchsorted(paths.start, boundary, side="right") - 1
    source = np.where(letter == _I, -1, boundary - block)
    kind = kinds[source] if len(kinds) else np.zeros(len(arc), dtype=np.int64)
    cost = np.where(letter == _I, INSERT, _COST[kind, paths.node[arc] % 4, letter])
    return letter, source, paths.to[arc] % 4, cost


def _finish(table: pa.Table, schema: pa.Schema):
    """Edits of whole conversations that lie in ``table`` in order."""
    lost = np.asarray(table.column("lost").combine_chunks(), dtype=bool)
    number = np.cumsum(_changes(table.column("conv"))) - 1
    heads = np.flatnonzero(np.diff(number, prepend=-1))
    live = np.flatnonzero(~lost)
    turns = table.take(live)
    of = number[live]
    roles, texts = (turns.column(c).combine_chunks() for c in ("role", "text"))
    initials = pa.compute.utf8_slice_codeunits(roles, 0, 1)
    seen, repeated = set(), np.zeros(len(live), dtype=bool)
    for i, (r, t, n) in enumerate(zip(roles, texts, of.tolist(), strict=True)):
        key = (n, r.as_py(), t.as_py())
        repeated[i] = key in seen
        seen.add(key)
    blank, cut = (np.asarray(turns.column(c).combine_chunks(), dtype=bool) for c in ("blank", "truncated"))
    fault = np.select([blank, repeated, cut], [1, 2, 3], 0)
    kinds = 4 * _codes(initials) + fault
    first = np.searchsorted(of, np.arange(len(heads) + 1))
    paths = LeastPaths(kinds, first, np.tile(_END, (len(heads), 1)), np.ones(len(heads), dtype=bool))
    path, arc = paths.paths(np.arange(len(heads)), np.zeros(len(heads), dtype=np.int64))
    letter, source, state, cost = _edit_arrays(paths, kinds, path, arc)
    silent = np.setdiff1d(np.arange(len(heads)), path)  # conversations without an edit
    order = np.argsort(np.concatenate([path, silent]), kind="stable")

    def column(values, none, kind):
        return pa.array(np.concatenate([values, np.full(len(silent), none)])[order], kind)

    conv = table.column("conv").combine_chunks().take(pa.array(heads[np.concatenate([path, silent])[order]]))
    block = np.asarray(table.column("at").combine_chunks(), dtype=np.int64)[heads] >> BLOCK_BITS
    at = np.concatenate([source, np.full(len(silent), -1)])[order]
    act = np.concatenate([letter, np.full(len(silent), -1)])[order]
    to = np.concatenate([state, np.full(len(silent), -1)])[order]
    take = pa.array(at, mask=at < 0)
    given = pa.array(np.array(["user", "assistant"])[(to == 3).astype(int)], mask=(act != _I) & (act != _R))
    kept = pa.array(at, mask=act != _K)
    held = pa.array(np.where(act == _I, len(live), at), mask=(act < 0) | (act == _D))
    yield pa.RecordBatch.from_arrays([
        conv, pa.array(block[np.concatenate([path, silent])[order]]),
        pa.array(np.arange(len(order))),
        pa.array(np.array([*_LETTERS, ""])[act], pa.string()), column(cost, 0, pa.int32()),
        turns.column("turn").combine_chunks().take(take), initials.take(take),
        pa.array(fault, pa.int8()).take(take), pa.compute.coalesce(given, roles.take(kept)),
        pa.concat_arrays([texts, pa.array([""], texts.type)]).take(held)], schema=schema)


def _whole(batches, schema: pa.Schema):
    held: list[pa.Table] = []

    def size():
        return sum(t.num_rows for t in held), sum(t.nbytes for t in held)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows, data = size()
        if rows < CHUNK_ROWS and data < CHUNK_BYTES:
            continue
        table = pa.concat_tables(held)
        ends = np.flatnonzero(_changes(table.column("conv")))
        if ends[-1]:
            yield from _finish(table.slice(0, ends[-1]), schema)
            table = table.slice(ends[-1])
        held = [table]
    if held:
        yield from _finish(pa.concat_tables(held), schema)


def _across(turns: DataFrame) -> DataFrame:
    """Edits of the conversations that cross blocks: ``conv, block, place, action, cost, at, fault,
    gives``, without texts."""
    narrow = turns.select(
        "conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", "lost", "blank", "truncated",
        F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), _initial(F.col("role"))), F.lit(0)).alias("known"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"))
    firsts = narrow.where(~F.col("lost")).groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(
        F.min("at").alias("earliest"))
    same = narrow["conv"].eqNullSafe(firsts["c"]) & (narrow["digest"] == firsts["d"])
    fault = (F.when(F.col("blank"), 1).when(F.col("at") > F.col("earliest"), 2)
             .when(F.col("truncated"), 3).otherwise(0))
    code = F.when(F.col("known") == 0, 3).otherwise(F.col("known") - 1)
    kinds = cut_lineage(narrow.join(firsts, same, "left").select(
        "conv", "block", "at", "lost", (4 * code + fault).cast("bigint").alias("kind")))
    id_type = turns.schema["conv"]
    key = [id_type, StructField("block", LongType())]

    def live(frame):
        frame = frame[~frame["lost"]].sort_values("at")
        return frame["at"].to_numpy(np.int64), frame["kind"].to_numpy(np.int64)

    def matrix(frame):
        import pandas as pd
        _, k = live(frame)
        flat = block_matrix(k).reshape(-1).tolist()
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "block": frame["block"].iloc[:1], "m": [flat]})

    matrices = cut_lineage(kinds.groupBy("conv", "block").applyInPandas(
        matrix, StructType([*key, StructField("m", ArrayType(LongType()))])))

    def ends(frame):
        frame = frame.sort_values("block")
        v, out = _END, []
        for m in reversed(frame["m"].tolist()):
            out.append(v.tolist())
            v = np.min(np.array(m, dtype=np.int64).reshape(4, 4) + v[None, :], axis=1)
        last = [False] * (len(out) - 1) + [True]
        return frame[["conv", "block"]].assign(ends=out[::-1], last=last)

    after = cut_lineage(matrices.groupBy("conv").applyInPandas(
        ends, StructType([*key, StructField("ends", ArrayType(LongType())), StructField("last", BooleanType())])))

    def ranked(frame, info):
        at, k = live(frame)
        return at, k, LeastPaths(k, np.array([0, len(k)]), np.array([info["ends"].iloc[0]], dtype=np.int64),
                                 np.array([bool(info["last"].iloc[0])]))

    def exits(frame, info):
        _, _, paths = ranked(frame, info)
        return info[["conv", "block"]].assign(exits=[paths.exits().tolist()])

    blocks = kinds.groupBy("conv", "block")
    out_of = blocks.cogroup(after.groupBy("conv", "block")).applyInPandas(
        exits, StructType([*key, StructField("exits", ArrayType(LongType()))]))

    def entries(frame):
        frame = frame.sort_values("block")
        state, out = 0, []
        for e in frame["exits"]:
            out.append(state)
            state = int(e[state])
        return frame[["conv", "block"]].assign(entry=out)

    into = out_of.groupBy("conv").applyInPandas(entries, StructType([*key, StructField("entry", LongType())]))
    onward = F.col("a.conv").eqNullSafe(F.col("e.conv")) & (F.col("a.block") == F.col("e.block"))
    info = cut_lineage(after.alias("a").join(into.alias("e"), onward).select("a.*", "e.entry"))

    def edits(frame, info):
        import pandas as pd
        at, k, paths = ranked(frame, info)
        path, arc = paths.paths(np.zeros(1, dtype=np.int64), info["entry"].to_numpy(np.int64))
        letter, source, state, cost = _edit_arrays(paths, k, path, arc)
        n = len(arc)
        rows = pd.DataFrame({
            "conv": frame["conv"].iloc[:1].repeat(n).to_numpy(), "block": int(frame["block"].iloc[0]),
            "place": np.arange(n), "action": np.array(list(_LETTERS))[letter], "cost": cost,
            "at": pd.array(at[source] if len(at) else np.zeros(n), dtype="Int64"),
            "fault": pd.array(k[source] % 4 if len(k) else np.zeros(n), dtype="Int64"),
            "gives": np.where((letter == _I) | (letter == _R), np.where(state == 3, "assistant", "user"), None)})
        rows.loc[rows["action"] == "I", ["at", "fault"]] = pd.NA
        return rows

    return blocks.cogroup(info.groupBy("conv", "block")).applyInPandas(edits, StructType([
        *key, StructField("place", LongType()), StructField("action", StringType()),
        StructField("cost", IntegerType()), StructField("at", LongType()),
        StructField("fault", LongType()), StructField("gives", StringType())]))


class _Summary:
    """Counts, audit and running hash of one conversation, fed edit by edit."""

    def __init__(self, conv):
        self.conv, self.hash, self.begun = conv, hashlib.sha256(), False
        self.low = self.high = self.last = self.before = None
        self.distinct = self.cost = self.illegal = 0
        self.faults, self.audit = [0, 0, 0, 0], []

    def add(self, action, cost, turn, initial, fault, role, text):
        self.cost += cost
        self.audit.append(action)
        if fault is not None:
            self.faults[fault] += 1
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            if turn is not None and turn != self.last:
                self.distinct += 1
                self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        if role is not None:
            self.hash.update(("\n" * self.begun + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self):
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY_FIELDS = [*[StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                  StructField("audit", StringType()), StructField("repaired_sha256", StringType())]


def _summaries(batches, schema: pa.Schema):
    now, out = None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        names = ("conv", "action", "cost", "turn", "initial", "fault", "role", "text")
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        for values in zip(*columns, strict=True):
            conv, *edit = [v.as_py() for v in values]
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Summary(conv)
            now.add(*edit)
        if len(out) >= 4096:
            yield flush()
            out = []
    if now is not None:
        out.append(now.row())
        yield flush()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", lost: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Edits, and a summary per conversation. Edits: ``conv, block, place`` (their order),
    ``action`` (K, D, I, R; empty on a row that only names a conversation that has no edits or
    crosses blocks), ``cost, turn, initial`` (of the
    role before the edit), ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated; null for inserts) and
    the repaired ``role`` and ``text`` (null where a turn is deleted). ``lost`` rows are not turns."""
    turns = ordered_turns(rows, conv, turn, role, text, lost)
    spans = turns.groupBy(F.col("conv").alias("c")).agg(
        *[f(F.shiftright("at", BLOCK_BITS)).alias(a) for f, a in ((F.min, "low"), (F.max, "high"))])
    split = cut_lineage(spans.where("low < high").select("c"))
    crosses = turns["conv"].eqNullSafe(split["c"])
    edit_type = StructType([turns.schema["conv"], *EDIT_FIELDS])
    edit_arrow = to_arrow_schema(edit_type)
    whole = join_small(turns, split, crosses, "left_anti").sortWithinPartitions("at").mapInArrow(
        lambda it: _whole(it, edit_arrow), edit_type)
    parts = join_small(turns, split, crosses, "left_semi")
    arcs = _across(parts)
    source = parts.select(F.col("at").alias("s_at"), "turn", F.col("role").alias("s_role"), F.col("text").alias("s_text"))
    kept = F.col("action").isin("K", "R")
    across = arcs.join(source, F.col("at") == F.col("s_at"), "left").select(
        "conv", "block", "place", "action", "cost", "turn", _initial(F.col("s_role")).alias("initial"),
        F.col("fault").cast("tinyint").alias("fault"),
        F.coalesce("gives", F.when(F.col("action") == "K", F.col("s_role"))).alias("role"),
        F.when(kept, F.col("s_text")).when(F.col("action") == "I", "").alias("text"))
    summary_type = StructType([turns.schema["conv"], *SUMMARY_FIELDS])
    summary_arrow = to_arrow_schema(summary_type)
    no_edit = {"block": F.lit(-1), "place": F.lit(-1), "action": F.lit(""), "cost": F.lit(0)}
    marks = split.select(F.col("c").alias("conv"), *[
        no_edit.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EDIT_FIELDS])
    across = across.unionByName(marks)
    whole_sums, across_sums = (
        e.mapInArrow(lambda it: _summaries(it, summary_arrow), summary_type)
        for e in (whole, across.repartition("conv").sortWithinPartitions("conv", "block", "place")))
    return whole.unionByName(across), whole_sums.unionByName(across_sums)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, lost`` after the damage that the hash of conversation and turn
    decides; dropped rows stay, marked as lost, so that no conversation is forgotten."""
    say = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    fate = F.crc32(F.concat(say[0], F.lit(":"), say[1])) % 20
    hurt = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                       say[2].alias("role"), say[3].alias("text"), fate.alias("fate"))
    return hurt.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("fate") == 0).alias("lost"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
