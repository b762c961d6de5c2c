"""Mini-batch k-means on coordinates (K2).

Every start walks over batches of ``BATCH_ROWS`` points: a centre moves to the running mean of the
points it was given, so its learning rate is one over its count. Batches come from draws: a pass
reads the points whose hash falls below ``DRAW_POINTS`` over their number (all of them, when there
are fewer), another hash each pass, so the driver sees about that many narrow points at a time
whatever the table. All starts share a draw, each in its own order. A start stops when the smoothed
batch cost has not fallen for ``PATIENCE`` batches. What decides and what is returned covers every
row: one scan gives the cost of each start over all points, the lowest wins, and its centres label
every row in a Column expression.

Points are distinct coordinates weighted by their rows, so a place that holds a third of the rows is
one point. Draws are hashes of the coordinates and do not depend on partitioning, ids or retries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

BATCH_ROWS, DRAW_POINTS, PASSES, PATIENCE = 256, 65_536, 100, 10
INIT_POINTS = 3 * BATCH_ROWS
STARVED = 0.01              # a centre with a smaller share of the largest count is set anew
# The seeds of the 20 starts.
KMEANS_SEEDS = tuple(range(42, 62))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each point's nearest centre (the first of equal ones)."""
    d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def spread_centres(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is drawn by weight times squared distance to those so far."""
    some = rng.permutation(len(x))[:max(INIT_POINTS, 3 * k)]
    x, w = x[some], w[some]
    centres = x[rng.choice(len(x), p=w / w.sum())][None, :]
    while len(centres) < k:
        odds = w * nearest(x, centres)[1]
        if odds.sum() <= 0:  # fewer different points than centres in the sample
            odds = w
        centres = np.vstack([centres, x[rng.choice(len(x), p=odds / odds.sum())]])
    return centres


@dataclass
class Start:
    """One start: its centres, the weight each was given, and the state of its stop rule."""

    rng: np.random.Generator
    centres: np.ndarray
    counts: np.ndarray
    smooth: float | None = None
    lowest: float | None = None
    since_lowest: int = 0
    since_reset: int = 0
    done: bool = False

    def walk(self, x: np.ndarray, w: np.ndarray, batch: int = BATCH_ROWS) -> None:
        """One pass over the drawn points, or up to the stop."""
        order = self.rng.permutation(len(x))
        rate = min(1.0, 2 * batch / (len(x) + 1))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            cost = self.step(x[rows], w[rows])
            self.smooth = cost if self.smooth is None else self.smooth + rate * (cost - self.smooth)
            if self.lowest is None or self.smooth < self.lowest:
                self.lowest, self.since_lowest = self.smooth, 0
            else:
                self.since_lowest += 1
            if self.since_lowest >= PATIENCE:
                self.done = True
                return

    def step(self, x: np.ndarray, w: np.ndarray) -> float:
        """Moves the centres by one batch; its mean cost before the move."""
        k = len(self.centres)
        at, d = nearest(x, self.centres)
        gained = np.bincount(at, weights=w, minlength=k)
        sums = np.stack([np.bincount(at, weights=w * x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        hit = gained > 0
        self.centres[hit] = ((self.centres[hit] * self.counts[hit, None] + sums[hit])
                             / (self.counts + gained)[hit, None])
        self.counts = self.counts + gained
        self.since_reset += len(x)
        if self.since_reset >= 10 * k or (self.counts == 0).any():
            self.reset_starved(x)
        return float((w * d).sum() / w.sum())

    def reset_starved(self, x: np.ndarray) -> None:
        """Centres that hardly any point is given to restart at points of the batch."""
        self.since_reset = 0
        starved = np.flatnonzero(self.counts < STARVED * self.counts.max())[:max(1, len(x) // 2)]
        if len(starved) and len(starved) < len(self.counts):
            self.centres[starved] = x[self.rng.permutation(len(x))[:len(starved)]] if len(x) >= len(starved) \
                else x[self.rng.integers(len(x), size=len(starved))]
            fed = np.setdiff1d(np.arange(len(self.counts)), starved)
            self.counts[starved] = self.counts[fed].min()


def _drawn(points: DataFrame, total: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of a draw, in the order of the coordinates."""
    u = F.pmod(F.xxhash64("x", "y", F.lit(salt)), F.lit(2 ** 53)) / F.lit(float(2 ** 53))
    got = points.where(u < F.lit(DRAW_POINTS / total)).toArrow()
    x, y, w = (got.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "w"))
    order = np.lexsort((y, x))
    return np.stack([x, y], axis=1)[order], w[order]


def total_costs(points: DataFrame, centres: list[np.ndarray]) -> list[float]:
    """The cost of each set of centres over all weighted points, in one scan."""
    ship_package(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def part(batches):
        sums = np.zeros(len(shared.value))
        for b in batches:
            x = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            w = b.column(2).to_numpy()
            for at in range(0, len(x), 4096):
                here = slice(at, at + 4096)
                for s, c in enumerate(shared.value):
                    sums[s] += float((w[here] * nearest(x[here], c)[1]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["s", "cost"])

    rows = points.select("x", "y", "w").mapInArrow(part, "s int, cost double").groupBy("s").agg(
        F.sum("cost").alias("cost")).collect()
    found = {r["s"]: r["cost"] for r in rows}
    return [found.get(s, 0.0) for s in range(len(centres))]


def minibatch_kmeans(points: DataFrame, k: int, seeds: tuple = KMEANS_SEEDS) -> tuple[np.ndarray, list[float]]:
    """(centres of the best start, cost of every start) of weighted points ``x, y, w``; at most as
    many centres as points. Starts whose costs agree to nine digits count as equal: the first wins."""
    points = cut_lineage(points)
    total = points.count()
    k = min(k, total)
    if not k:
        return np.zeros((0, 2)), []
    starts: list[Start] = []
    for number in range(PASSES):
        x, w = _drawn(points, total, number)
        if not starts:
            for s in seeds:
                rng = np.random.default_rng(s)
                starts.append(Start(rng, spread_centres(x, w, k, rng), np.zeros(k)))
        for s in starts:
            if not s.done:
                s.walk(x, w)
        if all(s.done for s in starts):
            break
    costs = total_costs(points, [s.centres for s in starts])
    best = next(i for i, c in enumerate(costs) if c <= min(costs) * (1 + 1e-9))
    return starts[best].centres, costs


def nearest_label(x: Column, y: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre (the first of equal ones), null without coordinates."""
    if not len(centres):
        return F.lit(None).cast("int")
    away = [F.struct(((x - F.lit(float(a))) * (x - F.lit(float(a))) + (y - F.lit(float(b))) * (y - F.lit(float(b)))
                      ).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(centres)]
    found = away[0] if len(away) == 1 else F.least(*away)
    return F.when(x.isNotNull() & y.isNotNull(), found["i"]).cast("int")


def kmeans_geo(df: DataFrame, k: int = 25, seeds: tuple = KMEANS_SEEDS, lat: str = "latitude",
               lon: str = "longitude", out: str = "geo_generation_cluster") -> DataFrame:
    """K2: clusters of the standardised coordinates, numbered by centroid (lat, lon). All columns and
    rows stay; rows without a coordinate (null or NaN) get a null cluster. A coordinate that never
    varies counts as 0. Of an empty table nothing is fitted."""
    known = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in (lat, lon)]
    both = known[0].isNotNull() & known[1].isNotNull()
    st = df.where(both).agg(*[f(c).alias(n) for c, p in zip(known, "xy", strict=True)
                              for f, n in ((F.avg, f"m{p}"), (F.stddev_pop, f"s{p}"))]).first()

    def scaled(c: Column, p: str) -> Column:
        return (c - F.lit(st[f"m{p}"] or 0.0)) / F.lit(st[f"s{p}"] or 1.0)

    x, y = scaled(known[0], "x"), scaled(known[1], "y")
    points = df.where(both).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("w"))
    centres, _ = minibatch_kmeans(points, k, seeds)
    centres = centres[np.lexsort((centres[:, 1], centres[:, 0]))]
    return df.withColumn(out, nearest_label(x, y, centres))
