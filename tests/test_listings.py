"""Listings queries on tables built here."""

import datetime
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from oracle_harness import compare, duck

import __spark_entry__ as E

QUERIES, ORACLES = E.queries(), E.oracle_sql()


def tables(lines: int, seed: int = 5, **more) -> str:
    """A folder with the tables that listings are derived from."""
    rnd = random.Random(seed)
    out = tempfile.mkdtemp(prefix="geoflat-test-")
    day = datetime.datetime(2024, 1, 1)
    found = {
        "lineitem": pd.DataFrame({
            "l_orderkey": [k // 4 for k in range(lines)], "l_partkey": [rnd.randrange(200) for _ in range(lines)],
            "l_suppkey": [rnd.randrange(20) for _ in range(lines)], "l_linenumber": pd.array([k % 4 + 1 for k in range(lines)], "int32"),
            "l_quantity": [float(rnd.randint(10, 50)) for _ in range(lines)],
            "l_extendedprice": [rnd.randint(400_000, 9_000_000) / 100 for _ in range(lines)],
            "l_returnflag": [rnd.choice("ANR") for _ in range(lines)],
            "l_shipdate": [day + datetime.timedelta(days=rnd.randrange(300)) for _ in range(lines)]}),
        "nation": pd.DataFrame({"n_nationkey": pd.array(range(25), "int32")}),
        "supplier": pd.DataFrame({"s_suppkey": range(20), "s_name": [f"s{k}" for k in range(20)]}), **more}
    for name, table in found.items():
        table.astype({c: "datetime64[us]" for c in table if c.endswith("date")}).to_parquet(os.path.join(out, f"{name}.parquet"))
    return out


def check(spark, name: str, at: str) -> dict:
    res = compare(QUERIES[name](spark, at), duck(at), ORACLES[name], sig=7)  # means of few rows may lie between two roundings
    assert res["ok"], str(res)
    return res


def test_flagship_filters_stay_above_the_distances(spark):
    at = tables(300)
    assert check(spark, "enriched_cluster_summary", at)["spark_rows"] > 3
    from geoflat.plans import q_spatial
    seen = []
    real, q_spatial.clean_listings = q_spatial.clean_listings, lambda df: seen.append(df) or real(df)
    try:
        QUERIES["enriched_cluster_summary"](spark, at)
    finally:
        q_spatial.clean_listings = real
    plan = seen[0].where(F.col("distance_to_mkad_km") <= 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "ATAN2" not in plan.upper()


def test_trees_are_grown_from_all_rows(spark, monkeypatch):
    import numpy as np

    from geoflat.operators import boosting as B
    rng = np.random.default_rng(8)
    n = 60_000
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n), np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n))], axis=1)
    y = np.round(3 * x[:, 0] + (x[:, 2] > 2) * 5 + rng.normal(size=n), 3)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*"abc", "y"])).repartition(5).cache()
    for got, k in zip(B.column_borders(df, list("abc")), range(3), strict=True):
        assert np.array_equal(got, B.quantile_borders(x[:, k]))
    held = df.limit(2000).cache()
    hx = held.toPandas().to_numpy()
    want = B.fit_symmetric_trees(x, y, hx[:, :3], hx[:, 3], iterations=4, depth=3)
    for rows, replay in ((1_000_000, 50), (9_000, 2)):
        monkeypatch.setattr(B, "TASK_ROWS", rows)
        monkeypatch.setattr(B, "BLOCK_ROWS", 7_000)
        monkeypatch.setattr(B, "REPLAY", replay)
        got = B.fit_all_rows(df, held, list("abc"), "y", iterations=4, depth=3)
        assert got.base == want.base and np.array_equal(got.feature, want.feature) and np.array_equal(got.border, want.border)
        assert np.allclose(got.value, want.value, rtol=0, atol=1e-12) and np.allclose(got.holdout_errors, want.holdout_errors)
        assert np.array_equal(got.weight, want.weight) and (got.weight.sum(axis=1) == n).all()


def test_long_polyline_moves_no_listing(spark, monkeypatch):
    import numpy as np

    from geoflat.operators import near_index
    from geoflat.operators import spatial as SP
    at = tables(400, customer=pd.DataFrame({"c_custkey": range(900)}), part=pd.DataFrame({"p_partkey": range(1100)}))
    plain = near_index.attach_nearest
    monkeypatch.setattr(SP, "attach_nearest", lambda *a, **k: plain(*a, **{**k, "tile_items": 100}))
    for asked in (near_index.ASKED_ROWS, 90):
        monkeypatch.setattr(near_index, "ASKED_ROWS", asked)
        check(spark, "point_to_long_polyline", at)
    plan = QUERIES["point_to_long_polyline"](spark, at)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
    monkeypatch.setattr(near_index, "HELD_ITEMS", 0)  # more items than may be held: rows go to the tiles
    check(spark, "point_to_long_polyline", at)
    # keys may repeat or be null, and a point may be missing
    seg = spark.createDataFrame([(0, 37.0 + k / 1e3, 55.5 + (k % 7) / 1e2, 37.0 + (k + 1) / 1e3, 55.5 + ((k + 1) % 7) / 1e2)
                                 for k in range(700)], "feature_id int, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = [("a", 55.6, 37.2), ("a", 55.4, 37.5), (None, 55.55, 37.6), ("b", None, 37.0), ("c", 55.6, 37.2)]
    left = spark.createDataFrame(rows, "listing_id string, latitude double, longitude double").repartition(3)
    monkeypatch.setattr(near_index, "HELD_ITEMS", 20_000_000)
    got = SP.point_to_polyline(left, seg, "d").collect()
    monkeypatch.setattr(SP, "SEGMENT_LIMIT", 1000)
    want = SP.point_to_polyline(left, seg, "d").collect()
    order = lambda rows: sorted(rows, key=repr)
    assert [r[:3] for r in order(got)] == [r[:3] for r in order(want)]
    assert np.allclose(*[[r["d"] or -1.0 for r in order(x)] for x in (got, want)], rtol=1e-12)


def test_ks_ranks_only_open_intervals(spark, monkeypatch):
    import numpy as np

    from geoflat.operators import ranks as R
    rng = np.random.default_rng(4)
    a = pd.DataFrame({"n": rng.normal(size=20_000), "k": rng.integers(0, 9, 20_000) * 1.0, "far": rng.normal(size=20_000),
                      "one": 3.0, "some": np.where(rng.random(20_000) < 0.5, None, rng.random(20_000)), "none": None, "lone": 1.0})
    b = pd.DataFrame({"n": rng.normal(size=15_000) * 1.02, "k": rng.integers(0, 9, 15_000) * 1.0, "far": rng.normal(size=15_000) + 9,
                      "one": 3.0, "some": rng.random(15_000), "none": None, "lone": None})
    schema = ", ".join(f"{c} double" for c in a)
    da, db = (spark.createDataFrame([tuple(None if v is None or v != v else float(v) for v in r) for r in d.itertuples(index=False)], schema)
              for d in (a, b))
    moved = []
    plain = R.cumulative_counts
    monkeypatch.setattr(R, "cumulative_counts", lambda df, *x: moved.append(df.count()) or plain(df, *x))
    for splits in (R.KS_SPLITS, 50):
        monkeypatch.setattr(R, "KS_SPLITS", splits)
        got = {r[0]: r[1:] for r in R.ks_columns(da, db, list(a)).collect()}
        assert set(got) == set(a) - {"none"} and got["lone"] == (None, 20_000, 0)
        for c in ("n", "k", "far", "one", "some"):
            x, y = (np.sort(d[c].dropna().to_numpy(dtype=float)) for d in (a, b))
            z = np.concatenate([x, y])
            d = np.abs(np.searchsorted(x, z, side="right") / len(x) - np.searchsorted(y, z, side="right") / len(y)).max()
            assert got[c] == (d, len(x), len(y)), c
    assert moved[0] < 1000, moved  # of some 125,000 values


def test_page_files_are_compressed(spark, monkeypatch, tmp_path):
    from geoflat.plans import q_io
    monkeypatch.setattr(q_io, "_scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q_io, "PAGES_IN_FILE", 40)
    check(spark, "stream_ingest_cards", tables(300))
    files = list(tmp_path.glob("in/wave*/part-*"))
    assert len(files) > 5 and all(f.name.endswith(".json.gz") for f in files)
