"""Exact, distributed order statistics: cumulative counts, quantiles, rank selection, KS.

pandas' ``median``/``quantile`` and scipy's ECDF walk a sorted array on one machine.
Spark's built-in exact ``percentile`` keeps a map of every distinct value of a group in
one task, and an un-partitioned window sorts everything in one task. Both break when one
group holds a third of 100 TB. The plan here never does that:

1. collapse to distinct ``(keys, value)`` with counts - partial aggregation map-side, so a
   hot *value* becomes one row;
2. ``repartitionByRange(keys, value)`` - a hot *group* is split over many partitions;
   the stamped partition id is checkpointed into the shared checkpoint folder so retries
   and recomputation see the same split;
3. per (partition, group) totals -> prefix offsets (a table of at most
   #groups + #partitions rows);
4. running sums inside each (partition, group) chunk, plus the offset.

Rank selection then keeps only the rows that contain a requested rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import bounded_row_count, cut_lineage, ship_package, stored


def cumulative_counts(df: DataFrame, keys: list[str], value: str,
                      counts: dict[str, Column] | None = None) -> DataFrame:
    """Rows ``keys + [value] + counts + cum_<c> + tot_<c>`` for every distinct non-null
    value of every group: ``cum_<c>`` = sum of ``c`` over values <= this one in the group,
    ``tot_<c>`` = group total."""
    counts = counts or {"n": F.lit(1)}
    names = list(counts)
    spark = df.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    collapsed = (df.where(F.col(value).isNotNull())
                 .groupBy(*keys, value)
                 .agg(*[F.sum(e).cast("bigint").alias(n) for n, e in counts.items()]))
    ranged = cut_lineage(collapsed.repartitionByRange(nparts, *keys, value)
                         .withColumn("_pid", F.spark_partition_id()))
    per_chunk = ranged.groupBy("_pid", *keys).agg(
        *[F.sum(n).alias(f"_s_{n}") for n in names])
    wk = W.partitionBy(*keys) if keys else W.partitionBy()
    before = wk.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_chunk.select(
        F.col("_pid").alias("_o_pid"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(wk).alias(f"tot_{n}") for n in names])
    cond = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = ranged.join(offsets, on=cond, how="inner").drop(
        "_o_pid", *[f"_o_{k}" for k in keys])
    running = (W.partitionBy("_pid", *keys).orderBy(value)
               .rowsBetween(W.unboundedPreceding, W.currentRow))
    return joined.select(
        *keys, value, *names,
        *[(F.sum(n).over(running) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[F.col(f"tot_{n}") for n in names])


def select_ranks(df: DataFrame, keys: list[str], value: str,
                 ranks: dict[str, Column]) -> DataFrame:
    """Value at 0-based rank (a Column of ``tot_n``) per group, one column per name."""
    cum = cumulative_counts(df, keys, value)
    rank_cols = {name: r(F.col("tot_n")) if callable(r) else r for name, r in ranks.items()}
    cum = cum.select("*", *[c.alias(f"_r_{n}") for n, c in rank_cols.items()])
    start = F.col("cum_n") - F.col("n")
    hit = None
    for n in rank_cols:
        h = (F.col(f"_r_{n}") >= start) & (F.col(f"_r_{n}") < F.col("cum_n"))
        hit = h if hit is None else hit | h
    hits = cum.where(hit)
    return hits.groupBy(*keys).agg(
        *[F.max(F.when((F.col(f"_r_{n}") >= start) & (F.col(f"_r_{n}") < F.col("cum_n")),
                       F.col(value))).alias(n) for n in rank_cols],
        F.max("tot_n").alias("_n"))


# A sketch places a rank within 1 / SKETCH of the rows; brackets reach twice as far.
SKETCH = 5_000
# Values between brackets, up to so many distinct ones, are ranked by one window.
FEW_VALUES = 200_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float], cheap: bool = False) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``quantile``, Spark ``percentile``,
    DuckDB ``quantile_cont``) per group, exact. Groups whose values are all NULL are
    absent - left-join from the group list where they must appear."""
    return column_quantiles(df, keys, [value], probs, cheap=cheap).drop("_feature")


def column_quantiles(df: DataFrame, keys: list[str], cols: list[str],
                     probs: dict[str, float], sketch: int = SKETCH, cheap: bool = False) -> DataFrame:
    """As ``exact_quantiles`` for many columns: rows ``keys, _feature`` (the column) and one column
    per probability. No row is shuffled for it: a mergeable sketch per group and column brackets
    every wanted rank; one scan counts the values below each bracket, another keeps the few values
    inside; the ranks among those are exact. Should a sketch be wrong about a bracket, the ranks of
    all values are taken instead. The keys and values are checkpointed first, as they are read three
    times, unless ``df`` is ``cheap`` to read again."""
    want = [(c, n, float(p)) for c in cols for n, p in probs.items()]
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    narrow = narrow if cheap else stored(narrow)
    at = {c: F.col(f"_v{i}") for i, c in enumerate(cols)}
    edges = [x for p in probs.values() for x in (max(0.0, p - 2 / sketch), min(1.0, p + 2 / sketch))]
    sketched = narrow.groupBy(*keys).agg(*[x for i, c in enumerate(cols) for x in (
        F.count(at[c]).alias(f"_n{i}"), F.min(at[c]).alias(f"_min{i}"), F.max(at[c]).alias(f"_max{i}"),
        F.percentile_approx(at[c], edges, sketch).alias(f"_a{i}"))])
    # in few values a bracket is narrower than the two ranks around a quantile: all values are inside
    few = [F.col(f"_n{i}") < 2 * sketch for i in range(len(cols))]
    names = list(probs)
    brackets = cut_lineage(sketched.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"_n{i}") for i in range(len(cols))],
        *[x for j, (c, n, _) in enumerate(want) for x in (
            F.when(few[cols.index(c)], F.col(f"_min{cols.index(c)}")).otherwise(
                F.col(f"_a{cols.index(c)}")[2 * names.index(n)]).alias(f"_lo{j}"),
            F.when(few[cols.index(c)], F.col(f"_max{cols.index(c)}")).otherwise(
                F.col(f"_a{cols.index(c)}")[2 * names.index(n) + 1]).alias(f"_hi{j}"))]))
    small = brackets if bounded_row_count(brackets) is None else F.broadcast(brackets)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = narrow.join(small, on) if keys else narrow.crossJoin(F.broadcast(brackets))
    below = placed.groupBy(*keys).agg(*[
        F.count_if(at[c] < F.col(f"_lo{j}")).alias(f"_b{j}") for j, (c, _, _) in enumerate(want)],
        *[F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(cols))])
    items = F.explode(F.array(*[F.struct(
        F.lit(c).alias("_feature"), F.lit(n).alias("_name"), F.lit(p).alias("_p"),
        F.col(f"_n{cols.index(c)}").alias("_tot"), F.col(f"_b{j}").alias("_below")) for j, (c, n, p) in enumerate(want)]))
    goals = cut_lineage(below.select(*keys, items.alias("_i")).select(*keys, "_i.*").where("_tot > 0"))
    inside = F.explode(F.array_compact(F.array(*[
        F.when(at[c].between(F.col(f"_lo{j}"), F.col(f"_hi{j}")), F.struct(
            F.lit(c).alias("_feature"), F.lit(n).alias("_name"), at[c].alias("_v")))
        for j, (c, n, _) in enumerate(want)])))
    gk = [*keys, "_feature", "_name"]
    values = cut_lineage(placed.select(*keys, inside.alias("_x")).select(*keys, "_x.*").groupBy(*gk, "_v").agg(
        F.count(F.lit(1)).alias("_c")))
    if bounded_row_count(values, FEW_VALUES) is not None:
        run = W.partitionBy(*gk).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        cum = values.select(*gk, "_v", "_c", F.sum("_c").over(run).alias("_cum"))
    else:
        cum = cumulative_counts(values, gk, "_v", {"_c": F.col("_c")}).select(
            *gk, "_v", "_c", F.col("cum__c").alias("_cum"))
    same = (F.col("_g_feature") == F.col("_feature")) & (F.col("_g_name") == F.col("_name"))
    for k in keys:
        same = same & F.col(f"_g_{k}").eqNullSafe(F.col(k))
    g = goals.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_feature").alias("_g_feature"),
                     F.col("_name").alias("_g_name"), "_p", "_tot", "_below")
    h = (F.col("_tot") - 1) * F.col("_p")
    last, first = F.col("_below") + F.col("_cum"), F.col("_below") + F.col("_cum") - F.col("_c")

    def at_rank(r: Column) -> Column:
        return F.max(F.when((first <= r) & (r < last), F.col("_v")))

    gcols = [*[f"_g_{k}" for k in keys], "_g_feature", "_g_name", "_p", "_tot"]
    found = cut_lineage(g.join(cum, same, "left").groupBy(*gcols).agg(
        at_rank(F.floor(h)).alias("_low"), at_rank(F.ceil(h)).alias("_high")))
    if found.where("_low is null or _high is null").limit(1).count():
        long = narrow.unpivot(keys, list(narrow.columns[len(keys):]), "_f", "_v")
        names_of = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"_v{i}"), F.lit(c))])
        return _ranked_quantiles(long.select(*keys, names_of[F.col("_f")].alias("_feature"), "_v"),
                                 [*keys, "_feature"], "_v", probs)
    share = h - F.floor(h)
    value = F.when(share == 0, F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * share)
    return found.select(*[F.col(f"_g_{k}").alias(k) for k in keys], F.col("_g_feature").alias("_feature"),
                        "_g_name", value.alias("_q")).groupBy(*keys, "_feature").agg(
        *[F.max(F.when(F.col("_g_name") == n, F.col("_q"))).alias(n) for n in probs])


def value_at_rank(df: DataFrame, value: Column, number: Column, rank) -> DataFrame:
    """One row ``value``: the value at the 0-based rank ``rank(rows)`` (a number). ``number`` is a
    numeric key that never falls as the value rises; it brackets the rank as above, so only a
    few rows are ranked."""
    keyed = stored(df.select(value.alias("value"), number.cast("double").alias("_h")))
    n = keyed.where("value is not null").count()
    if not n:
        return keyed.select("value").limit(0)
    k = rank(n)
    edges = [max(0.0, k / n - 2 / SKETCH), min(1.0, k / n + 2 / SKETCH)]
    low, high = keyed.where("value is not null").agg(F.percentile_approx("_h", edges, SKETCH)).first()[0]
    below = keyed.where((F.col("_h") < low) & F.col("value").isNotNull()).count()
    some = keyed.where(F.col("_h").between(low, high))
    if not below <= k < below + some.count():
        below, some = 0, keyed
    return select_ranks(some.select("value"), [], "value", {"at": F.lit(k - below)}).select(F.col("at").alias("value"))


def _ranked_quantiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Quantiles from the ranks of all values."""
    ranks = {}
    for name, p in probs.items():
        h = lambda tot, p=p: (tot - 1) * F.lit(float(p))
        ranks[f"_lo_{name}"] = lambda tot, h=h: F.floor(h(tot))
        ranks[f"_hi_{name}"] = lambda tot, h=h: F.ceil(h(tot))
    sel = select_ranks(df.select(*keys, F.col(value).cast("double").alias(value)),
                       keys, value, ranks)
    outs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    return sel.select(*keys, *outs)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def ks_statistic(sample_a: DataFrame, sample_b: DataFrame, keys: list[str],
                 value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D per group: max |F_a(x) - F_b(x)| over all
    distinct x, with n_a and n_b. Both ECDFs are built in one distributed pass."""
    a = sample_a.select(*keys, F.col(value).cast("double").alias(value),
                        F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = sample_b.select(*keys, F.col(value).cast("double").alias(value),
                        F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    cum = cumulative_counts(a.unionByName(b), keys, value,
                            {"na": F.col("_a"), "nb": F.col("_b")})
    diff = F.abs(F.try_divide(F.col("cum_na").cast("double"), F.col("tot_na"))
                 - F.try_divide(F.col("cum_nb").cast("double"), F.col("tot_nb")))
    return cum.groupBy(*keys).agg(F.max(diff).alias("ks_statistic"),
                                  F.max("tot_na").alias("n_a"), F.max("tot_nb").alias("n_b"))


# Intervals between the split points of one column.
KS_SPLITS = 4096


def ks_columns(sample_a: DataFrame, sample_b: DataFrame, cols: list[str]) -> DataFrame:
    """``ks_statistic`` of each of ``cols``, as rows (feature, ks_statistic, n_a, n_b); a column without a value
    has no row. Both samples are read three times, but few values move: they are counted between split points
    of a sketch of all values. That gives D at these points exactly and bounds it between them, so only
    intervals that could hold a larger D are ranked value by value."""
    spark = sample_a.sparkSession
    ship_package(spark)
    at = [f"v{i}" for i in range(len(cols))]
    both = sample_a.select(*[F.col(c).cast("double").alias(v) for c, v in zip(cols, at, strict=True)], F.lit(0).alias("s")).unionByName(
        sample_b.select(*[F.col(c).cast("double").alias(v) for c, v in zip(cols, at, strict=True)], F.lit(1).alias("s")))
    probs = F.lit(np.arange(1, KS_SPLITS) / KS_SPLITS)  # one literal
    found = both.agg(*[F.percentile_approx(v, probs, KS_SPLITS).alias(v) for v in at]).first()
    edges = [np.unique(np.array(found[v] or [], dtype=np.float64)) for v in at]

    def count(batches):
        cells = [np.zeros((2, 2 * len(e) + 1), dtype=np.int64) for e in edges]
        for b in batches:
            for i, e in enumerate(edges):
                _, cell, s = _cells(b, i, e)
                cells[i] += np.bincount(s * cells[i].shape[1] + cell, minlength=cells[i].size).reshape(2, -1)
        for i, (a, b) in enumerate(cells):
            k = np.flatnonzero(a + b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i), pa.int32()), pa.array(k), pa.array(a[k]), pa.array(b[k])],
                                             ["f", "cell", "na", "nb"])

    t = both.mapInArrow(count, "f int, cell bigint, na bigint, nb bigint").groupBy("f", "cell").agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb")).toArrow()
    f, cell, na, nb = (t.column(c).to_numpy() for c in ("f", "cell", "na", "nb"))
    best, total, open_, before = {}, {}, {}, []
    for i, e in enumerate(edges):
        k = np.zeros((2, 2 * len(e) + 1), dtype=np.int64)
        k[:, cell[f == i]] = na[f == i], nb[f == i]
        if not k.any():
            continue
        upto = k.cumsum(axis=1)
        total[i] = upto[:, -1].tolist()
        if not all(total[i]):
            continue
        share = upto / upto[:, -1:]
        best[i] = float(np.abs(share[0] - share[1]).max())
        start = (upto - k) / upto[:, -1:]
        most = np.maximum(share[0] - start[1], share[1] - start[0])
        wide = np.flatnonzero((np.arange(k.shape[1]) % 2 == 0) & (k > 0).all(axis=0) & (most > best[i]))
        if len(wide):
            open_[i] = wide
            before += [(i, int(c), *(int(upto[s, c] - k[s, c]) for s in (0, 1)), *total[i]) for c in wide]

    def keep(batches):
        for b in batches:
            for i, wide in open_.items():
                v, cell, s = _cells(b, i, edges[i])
                hit = np.isin(cell, wide)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), i), pa.int32()), pa.array(cell[hit]), pa.array(v[hit]),
                                                      pa.array(1 - s[hit]), pa.array(s[hit])], ["f", "cell", "v", "a", "b"])

    if open_:
        inside = both.mapInArrow(keep, "f int, cell bigint, v double, a bigint, b bigint")
        cum = cumulative_counts(inside, ["f", "cell"], "v", {"na": F.col("a"), "nb": F.col("b")})
        start = F.broadcast(spark.createDataFrame(before, "f int, cell bigint, _a bigint, _b bigint, _na bigint, _nb bigint"))
        diff = F.abs((F.col("_a") + F.col("cum_na")).cast("double") / F.col("_na") - (F.col("_b") + F.col("cum_nb")).cast("double") / F.col("_nb"))
        for r in cum.join(start, ["f", "cell"]).groupBy("f").agg(F.max(diff).alias("d")).collect():
            best[r["f"]] = max(best[r["f"]], r["d"])
    return spark.createDataFrame([(cols[i], best.get(i), *n) for i, n in total.items()],
                                 "feature string, ks_statistic double, n_a bigint, n_b bigint")


def _cells(batch: pa.RecordBatch, i: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The known values of column ``i``, their cells (2 k between split points, 2 k + 1 at the k-th) and samples."""
    known = np.asarray(batch.column(i).is_valid())
    v = np.asarray(batch.column(i).drop_null(), dtype=np.float64)
    at = np.searchsorted(edges, v)
    same = np.append(edges, np.nan)[at] == v
    return v, 2 * at + same, np.asarray(batch.column(batch.num_columns - 1)).astype(np.int64)[known]


def ks_pvalue(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: Q_KS(sqrt(en) * D) with the Stephens correction
    term, 2 * sum_{j>=1} (-1)^(j-1) exp(-2 j^2 l^2), clamped to [0, 1]."""
    en = F.sqrt(n_a * n_b / (n_a + n_b).cast("double"))
    lam = (en + 0.12 + 0.11 / en) * d
    s = F.lit(0.0)
    for j in range(1, terms + 1):
        s = s + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam)
    return F.when(lam < 1e-3, F.lit(1.0)).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


# Up to this size of both samples the p-value is exact.
KS_EXACT = 10_000


def ks_exact_pvalue(d: float, n_a: int, n_b: int) -> float:
    """P(D >= d) for samples of ``n_a`` and ``n_b`` without ties, by lattice paths: of all orders of
    the two samples, the share whose path (i, j) somewhere has |i / n_a - j / n_b| >= d. Points
    with i + j = k are one step, so the work is (n_a + n_b) steps of min(n_a, n_b) entries."""
    m, n = sorted((n_a, n_b))
    if not m:
        return float("nan")
    least = round(d * m * n)
    if least <= 0:
        return 1.0
    out = np.zeros(m + 1)  # share of the paths to (i, k - i) that have been outside
    i = np.arange(m + 1)
    for k in range(1, m + n + 1):
        j = k - i
        step = out * np.maximum(j, 0)
        step[1:] += out[:-1] * i[1:]
        step /= k
        step[(j < 0) | (j > n)] = 0.0
        step[(np.abs(i * n - j * m) >= least) & (j >= 0) & (j <= n)] = 1.0
        out = step
    return float(min(1.0, out[m]))


def ks_pvalue_of(d: Column, n_a: Column, n_b: Column) -> Column:
    """Exact for samples of at most ``KS_EXACT``, asymptotic above, like the reference's call. Call
    ``ship_package`` first; there is one value per compared pair of samples."""
    @F.arrow_udf("double")
    def exact(d: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(d.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([None if x is None or max(p, q) > KS_EXACT else ks_exact_pvalue(x, p, q) for x, p, q in rows], pa.float64())

    value = exact(d, n_a, n_b)
    return F.when(F.greatest(n_a, n_b) <= KS_EXACT, value).otherwise(ks_pvalue(d, n_a, n_b))
