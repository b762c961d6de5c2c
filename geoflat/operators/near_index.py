"""Exact nearest items (points or segments) by packed box trees.

Items are cut by ranks of their coordinates, so boxes follow their density: one far item costs one
box, not a coarser index for all others.

* Up to ``TILE_ITEMS`` items (a checked count) are one tree, which is broadcast; rows are answered in
  Arrow batches where they lie, without a shuffle.
* More items are range-partitioned along a space-filling curve into tiles. Each row first asks the tile
  whose box is nearest, which gives an upper bound, and then only the tiles whose boxes come closer
  than that. Up to ``HELD_ITEMS`` items (a checked count) each tile is a broadcast tree of its own: rows
  stay where they are, and tasks load one tile at a time for ``ASKED_ROWS`` rows. Beyond, rows are sent to the
  tiles, and a tile that many rows ask for is dealt in parts of ``PART_ROWS`` rows.

In a tree, rows that lie together go down as one box: level by level the farthest reach of the boxes
met is an upper bound, and only boxes nearer than it are opened. Work is cut where many boxes stay open,
so memory is bounded by one such group of rows against one tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import bounded_row_count, cut_lineage, ship_package

TILE_ITEMS = 100_000
HELD_ITEMS = 20_000_000
PART_ROWS = 200_000
ASKED_ROWS = 500_000
# Items in a leaf, rows that go down a tree together, and box pairs and distances held at once.
LEAF = 2
TOGETHER = 16
PAIRS = 1 << 18
BLOCK = 1 << 14
# Items this much farther than the nearest one are still offered, so that ties are decided by the
# exact distance of the caller.
SLACK, LEAST = 1e-9, 4e-15
ENDS = ["x1", "y1", "z1", "x2", "y2", "z2"]


def kd_cuts(n: int, depth: int) -> np.ndarray:
    """Bounds of the ``2 ** depth`` runs, nested in those of every smaller depth."""
    return (np.arange((1 << depth) + 1) * n) >> depth


def kd_order(points: np.ndarray, depth: int) -> np.ndarray:
    """Order in which the runs of ``kd_cuts`` are the cells of a k-d tree: each run is halved at the
    median of its widest coordinate, so boxes are small and follow the density."""
    order = np.arange(len(points))
    for level in range(depth):
        cuts = kd_cuts(len(points), level)
        mine = points[order]
        wide = np.maximum.reduceat(mine, cuts[:-1]) - np.minimum.reduceat(mine, cuts[:-1])
        run = np.repeat(np.arange(1 << level), np.diff(cuts))
        order = order[np.lexsort((mine[np.arange(len(mine)), wide.argmax(axis=1)[run]], run))]
    return order


def kd_depth(n: int, size: int) -> int:
    """Halvings of ``n`` that leave runs of about ``size``, none of them empty."""
    depth = 0
    while n >> (depth + 1) >= size:
        depth += 1
    return depth


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...`` of ``count[0]`` numbers, then those of the next."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class BoxTree:
    """Boxes around the cells of a k-d tree over the items, halved from one root to the leaves."""

    def __init__(self, ends: np.ndarray):
        self.depth = kd_depth(len(ends), LEAF)
        self.order = kd_order((ends[:, :3] + ends[:, 3:]) / 2, self.depth)
        self.a, self.b = ends[self.order, :3], ends[self.order, 3:]
        self._boxes()

    def _boxes(self) -> None:
        self.points = bool((self.a == self.b).all())
        self.low, self.high = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        self.levels = []
        for level in range(self.depth + 1) if len(self.a) else ():
            at = kd_cuts(len(self.a), level)[:-1]
            self.levels.append((np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)))

    def __getstate__(self):
        return self.depth, self.order, self.a, self.b

    def __setstate__(self, state):
        self.depth, self.order, self.a, self.b = state
        self._boxes()

    def nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of the nearest items of each row, with the slack above."""
        known = np.flatnonzero(np.isfinite(p).all(axis=1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(known) and len(self.a):
            found += self._nearest(p[known])
        row, item, far = (np.concatenate(x) for x in zip(*found, strict=True))
        row = known[row]
        at = np.argsort(row, kind="stable")
        return row[at], self.order[item[at]], far[at]

    def _nearest(self, p: np.ndarray):
        """Rows that lie together go down the tree together, as the box around them."""
        depth = kd_depth(len(p), TOGETHER)
        order = kd_order(p, depth)
        cuts = kd_cuts(len(p), depth)
        size = int(np.diff(cuts).max())
        # runs differ by one row at most; the last row of a shorter one is repeated
        member = order[np.minimum(cuts[:-1, None] + np.arange(size), cuts[1:, None] - 1)]
        real = np.diff(cuts)
        q = p[member].transpose(2, 0, 1).copy()
        low, high = q.min(axis=2).T, q.max(axis=2).T
        bound = np.full(len(real), np.inf)
        runs = np.arange(len(real))
        work = [(0, runs, np.zeros(len(runs), dtype=np.int64))]
        while work:
            level, run, node = work.pop()
            if len(run) > PAIRS and run[0] != run[-1]:
                half = np.searchsorted(run, run[len(run) // 2])
                half = half if half else np.searchsorted(run, run[0], side="right")
                work += [(level, run[half:], node[half:]), (level, run[:half], node[:half])]
                continue
            if level > self.depth:
                yield from self._pairs(q, member, real, run, node)
                continue
            if level < self.depth:
                run, node = np.repeat(run, 2), (node[:, None] * 2 + (0, 1)).reshape(-1)
                boxes = self.levels[level + 1]
            else:
                cut = kd_cuts(len(self.a), self.depth)
                count = np.diff(cut)[node]
                run, node = np.repeat(run, count), _ranges(cut[node], count)
                boxes = self.low, self.high
            off, reach = np.zeros(len(run)), np.zeros(len(run))
            for k in range(3):
                below, above = low[run, k] - boxes[1][node, k], boxes[0][node, k] - high[run, k]
                gap = np.maximum(np.maximum(below, above), 0.0)
                off += gap * gap
                span = np.maximum(high[run, k] - boxes[0][node, k], boxes[1][node, k] - low[run, k])
                reach += span * span
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            first = run[starts]
            bound[first] = np.minimum(bound[first], np.sqrt(np.minimum.reduceat(reach, starts)))
            near = np.sqrt(off) <= bound[run] * (1 + 2 * SLACK) + 2 * LEAST
            work.append((level + 1, run[near], node[near]))

    def _pairs(self, q: np.ndarray, member: np.ndarray, real: np.ndarray, run: np.ndarray, item: np.ndarray):
        """Distances of every row of a run to every item its run may need."""
        size = q.shape[2]
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        ends = np.append(starts[1:], len(run))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK // size, side="right")))
            mine, theirs = run[starts[i]:ends[j - 1]], item[starts[i]:ends[j - 1]]
            far = self._to_items(q[:, mine], theirs)
            at = starts[i:j] - starts[i]
            limit = np.minimum.reduceat(far, at, axis=0) * (1 + SLACK) + LEAST
            limit[np.arange(size) >= real[run[starts[i:j]], None]] = -1.0
            pair, column = np.nonzero(far <= np.repeat(limit, ends[i:j] - starts[i:j], axis=0))
            yield member[mine[pair], column], theirs[pair], far[pair, column]
            i = j

    def _to_items(self, q: np.ndarray, item: np.ndarray) -> np.ndarray:
        off = [q[k] - self.a[item, k, None] for k in range(3)]
        if not self.points:
            along = self.b[item] - self.a[item]
            length = (along * along).sum(-1)
            t = sum(off[k] * along[:, k, None] for k in range(3)) / np.where(length > 0, length, 1.0)[:, None]
            t = np.clip(t, 0.0, 1.0)
            off = [off[k] - t * along[:, k, None] for k in range(3)]
        return np.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


def _lists(n: int, row: np.ndarray, item: np.ndarray, payload: pa.Array) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), payload.take(pa.array(item)))


def _one_each(row: np.ndarray, item: np.ndarray, far: np.ndarray):
    """Only the nearest item of each row."""
    order = np.lexsort((item, far, row))
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    return row[order][first], item[order][first], far[order][first]


def _table(items: DataFrame) -> tuple[np.ndarray, pa.Array]:
    return _parts(items.select(*ENDS, "item").toArrow())


def _parts(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    ends = np.column_stack([np.asarray(table.column(c), dtype=np.float64) for c in ENDS])
    return ends.reshape(-1, 6), table.column("item").combine_chunks()


def attach_nearest(left: DataFrame, at: list[Column], items: DataFrame, out: str, key: str,
                   ties: bool = True, tile_items: int = TILE_ITEMS) -> DataFrame:
    """Adds ``out``: the payloads (column ``item``, a struct) of the items nearest to the point ``at``
    (x, y, z), all equally near ones with ``ties``; an empty list without coordinates or items. Items
    have the columns ``ENDS``, a point as a segment of length 0. ``key`` is unique."""
    ship_package(left.sparkSession)
    if bounded_row_count(items, tile_items) is None:
        if bounded_row_count(items, HELD_ITEMS) is None:
            return _by_tiles(left, at, items, out, key, ties, tile_items)
        return _by_held_tiles(left, at, items, out, ties, tile_items)
    ends, payload = _table(items)
    shared = left.sparkSession.sparkContext.broadcast((BoxTree(ends), payload))
    kind = ArrayType(items.schema["item"].dataType)

    @F.arrow_udf(kind)
    def nearest(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        tree, held = shared.value
        found = tree.nearest(_points(x, y, z))
        row, item, _ = found if ties else _one_each(*found)
        return _lists(len(x), row, item, held)

    return left.withColumn(out, nearest(*[c.cast("double") for c in at]))


def _points(*columns) -> np.ndarray:
    return np.column_stack([np.asarray(pc.fill_null(c, float("nan")), dtype=np.float64) for c in columns])


def _in_tiles(items: DataFrame, tile_items: int) -> DataFrame:
    """The items in one partition per tile, which are runs of about ``tile_items`` along a space-filling curve."""
    total = items.count()
    tiles = -(-total // tile_items)
    middle = [(F.col(a) + F.col(b)) / 2 for a, b in zip(ENDS[:3], ENDS[3:], strict=True)]
    box = items.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(middle) for f, n in ((F.min, "a"), (F.max, "b"))]).first()

    @F.arrow_udf("bigint")
    def curve(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        code = np.zeros(len(x), dtype=np.int64)
        for k, column in enumerate((x, y, z)):
            low, high = box[f"a{k}"], box[f"b{k}"]
            # fine steps: range partitioning cuts the curve by quantiles, whatever its units
            step = ((np.asarray(column) - low) / max(high - low, 1e-300) * ((1 << 20) - 1)).astype(np.int64)
            for bit in range(20):
                code |= ((step >> bit) & 1) << (3 * bit + k)
        return pa.array(code)

    return items.select(*ENDS, "item", curve(*middle).alias("z_")).repartitionByRange(tiles, "z_", *ENDS).drop("z_")


def _to_box(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    off = np.maximum(np.maximum(low - p, p - high), 0.0)
    return np.sqrt((off * off).sum(1))


def ask_tiles(p: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray]], load, ties: bool):
    """(row, payload) of the nearest items of each row, sorted by row. ``load`` gives a tile's tree and payload;
    each tile is loaded once for the rows that are nearest to its box, and once for others that may need it."""
    known = np.flatnonzero(np.isfinite(p).all(axis=1))
    q = p[known]
    home, near = np.zeros(len(q), np.int32), np.full(len(q), np.inf)
    for t, box in enumerate(boxes):
        far = _to_box(q, *box)
        closer = far < near
        home[closer], near[closer] = t, far[closer]
    bound = np.full(len(q), np.inf)
    rows, items, distances = [], [], []

    def ask(t: int, mine: np.ndarray) -> None:
        if not len(mine):
            return
        tree, payload = load(t)
        row, item, far = tree.nearest(q[mine])
        if not ties:
            row, item, far = _one_each(row, item, far)
        np.minimum.at(bound, mine[row], far)
        rows.append(mine[row])
        distances.append(far)
        items.append(payload.take(pa.array(item)))

    for t in range(len(boxes)):
        ask(t, np.flatnonzero(home == t))
    for t, box in enumerate(boxes):
        ask(t, np.flatnonzero((home != t) & (_to_box(q, *box) <= bound * (1 + SLACK) + LEAST)))
    if not rows:
        return np.zeros(0, np.int64), None
    row, far, payload = np.concatenate(rows), np.concatenate(distances), pa.concat_arrays(items)
    order = np.lexsort((far, row))
    kept = far[order] <= bound[row[order]] * (1 + SLACK) + LEAST
    if not ties:
        kept &= np.diff(row[order], prepend=-1) != 0
    order = order[kept]
    return known[row[order]], payload.take(pa.array(order))


def _by_held_tiles(left: DataFrame, at: list[Column], items: DataFrame, out: str, ties: bool, tile_items: int) -> DataFrame:
    """No row moves: the trees of the tiles, made in tasks, are broadcast one by one."""
    sc = left.sparkSession.sparkContext

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            ends, payload = _parts(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((BoxTree(ends), payload), protocol=5)], pa.binary())], ["tile"])

    shared, boxes = [], []
    for r in cut_lineage(_in_tiles(items, tile_items).mapInArrow(build, "tile binary")).toLocalIterator():
        tree, payload = pickle.loads(r["tile"])
        boxes.append((tree.low.min(axis=0), tree.high.max(axis=0)))
        shared.append(sc.broadcast((tree, payload)))
    kind = ArrayType(items.schema["item"].dataType)
    empty = to_arrow_type(kind)

    def load(t: int):
        value = shared[t].value
        shared[t].__dict__.pop("_value", None)  # one tile at a time is held; its file is read again when asked for
        return value

    def answers(batches):
        sizes = [len(b[0]) for b in batches]
        p = np.concatenate([_points(*b) for b in batches])
        row, payload = ask_tiles(p, boxes, load, ties)
        cuts = np.searchsorted(row, np.concatenate([[0], np.cumsum(sizes)]))
        first = 0
        for k, n in enumerate(sizes):
            if payload is None:
                yield pa.array([[]] * n, empty)
            else:
                offsets = np.searchsorted(row[cuts[k]:cuts[k + 1]], np.arange(first, first + n + 1))
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), payload.slice(cuts[k], cuts[k + 1] - cuts[k]))
            first += n

    @F.arrow_udf(kind)
    def nearest(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        asked = []
        for b in batches:
            asked.append(b)
            if sum(len(x[0]) for x in asked) >= ASKED_ROWS:
                yield from answers(asked)
                asked = []
        if asked:
            yield from answers(asked)

    return left.withColumn(out, nearest(*[c.cast("double") for c in at]))


def _by_tiles(left: DataFrame, at: list[Column], items: DataFrame, out: str, key: str, ties: bool,
              tile_items: int) -> DataFrame:
    dealt = cut_lineage(_in_tiles(items, tile_items).withColumn("tile", F.spark_partition_id()))
    bounds = dealt.groupBy("tile").agg(
        *[F.min(F.least(a, b)).alias(f"low_{a}") for a, b in zip(ENDS[:3], ENDS[3:], strict=True)],
        *[F.max(F.greatest(a, b)).alias(f"high_{a}") for a, b in zip(ENDS[:3], ENDS[3:], strict=True)],
    ).orderBy("tile").collect()  # a row per ``tile_items`` items
    ids = np.array([r["tile"] for r in bounds], dtype=np.int64)
    low, high = (np.array([[r[f"{n}_{a}"] for a in ENDS[:3]] for r in bounds]) for n in ("low", "high"))

    def to_boxes(p: np.ndarray) -> np.ndarray:
        far = np.empty((len(p), len(ids)))
        for t in range(len(ids)):
            far[:, t] = _to_box(p, low[t], high[t])
        return far

    @F.arrow_udf("int")
    def nearest_tile(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        far = to_boxes(_points(x, y, z))
        known = np.isfinite(far).all(axis=1)
        return pa.array(ids[np.where(known[:, None], far, 0).argmin(axis=1)], pa.int32(), mask=~known)

    @F.arrow_udf("array<int>")
    def other_tiles(x: pa.Array, y: pa.Array, z: pa.Array, tile: pa.Array, bound: pa.Array) -> pa.Array:
        limit = np.asarray(bound, dtype=np.float64) * (1 + SLACK) + LEAST
        near = to_boxes(_points(x, y, z)) <= limit[:, None]
        near &= ids[None, :] != np.asarray(tile)[:, None]
        row, t = np.nonzero(near)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32()),
                                        pa.array(ids[t], pa.int32()))

    kind = ArrayType(items.schema["item"].dataType)
    answer = StructType([left.schema[key], *[StructField(c, DoubleType()) for c in "xyz"],
                         StructField("tile", IntegerType()), StructField("bound", DoubleType()),
                         StructField("found", kind)])
    arrow = to_arrow_schema(answer)
    list_type = to_arrow_type(kind)

    def answered(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("spread", F.xxhash64(key))
        parts = asked.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # a row per tile
        rows = asked.join(parts, "tile").withColumn("part", F.pmod("spread", "parts").cast("int"))
        held = dealt.join(parts, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def solve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            p = _points(*[mine.column(c).combine_chunks() for c in "xyz"])
            ends = np.column_stack([np.asarray(theirs.column(c), dtype=np.float64) for c in ENDS]).reshape(-1, 6)
            row, item, far = BoxTree(ends).nearest(p)
            if not ties:
                row, item, far = _one_each(row, item, far)
            bound = np.full(len(p), np.inf)
            np.minimum.at(bound, row, far)
            lists = _lists(len(p), row, item, theirs.column("item").combine_chunks()).cast(list_type)
            return pa.Table.from_arrays(
                [mine.column(key), *[mine.column(c) for c in "xyz"], mine.column("tile"), pa.array(bound), lists],
                schema=arrow)

        return rows.select(key, *"xyz", "tile", "part").groupBy("tile", "part").cogroup(
            held.select(*ENDS, "item", "tile", "part").groupBy("tile", "part")).applyInArrow(solve, answer)

    points = left.select(key, *[c.cast("double").alias(n) for c, n in zip(at, "xyz", strict=True)])
    home = cut_lineage(answered(points.withColumn("tile", nearest_tile("x", "y", "z")).where("tile is not null")))
    more = home.select(key, *"xyz", F.explode(other_tiles("x", "y", "z", "tile", "bound")).alias("tile"))
    both = home.unionByName(answered(more)).groupBy(F.col(key).alias("_key")).agg(
        F.flatten(F.collect_list("found")).alias(out))  # at most one list a tile asked
    joined = left.join(both, left[key] == both["_key"], "left").drop("_key")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kind)))
