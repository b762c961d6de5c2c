"""Micro fixtures for the edge cases: numeric traps, NBSP and Cyrillic case, equal-distance
ties, a hot group, KS(x, x) = 0, partition-count stability, exact split size."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoflat.functions import numeric as N
from geoflat.functions import text as T
from geoflat.operators import ranks as R
from geoflat.operators import spatial as SP
from geoflat.operators import stats as S
from geoflat.operators import synth as J


def test_numeric_traps(spark):
    df = spark.createDataFrame([(s,) for s in ["nan", "inf", "1d", " 12.5 ", "", None, "1e3"]], "t string")
    got = [r[0] for r in df.select(N.coerce_numeric("t")).collect()]
    assert got == [None, None, None, 12.5, None, None, 1000.0]
    got = [r[0] for r in spark.createDataFrame([("12 500,5 ",)], "t string")
           .select(N.coerce_numeric_locale("t")).collect()]
    assert got == [12500.5]


def test_whitespace_and_cyrillic_case(spark):
    df = spark.createDataFrame([("a  b \n",), ("на карте Москва, ул. Ленина, 5",)], "t string")
    r = df.select(T.collapse_ws("t").alias("c"), T.clean_address("t").alias("a")).collect()
    assert r[0]["c"] == "a b"
    assert r[1]["a"] == "Москва, ул. Ленина, 5"


def test_nearest_tie_goes_to_first_station(spark):
    left = spark.createDataFrame([("x", 55.75, 37.60)], "listing_id string, latitude double, longitude double")
    dim = spark.createDataFrame([("b", 55.76, 37.60, 2), ("a", 55.74, 37.60, 1)],
                                "name string, lat double, lon double, ord long")
    for form in (None, "grid"):
        r = SP.nearest_one(left, dim, out="nn", force=form).select("nn.name").first()[0]
        assert r == "a"


def test_grid_nearest_crosses_180_degrees(spark):
    rnd = random.Random(3)
    left = [("east", 60.0, 179.99), ("west", -10.0, -179.99), ("pole", 89.9, 5.0), ("none", None, 1.0)]
    left += [(f"l{i}", rnd.uniform(-85, 85), rnd.choice([-1, 1]) * rnd.uniform(170, 180)) for i in range(40)]
    dim = [("a", 60.0, 179.5, 1), ("b", 60.0, -179.99, 2), ("c", -10.0, 179.9, 3), ("d", 89.9, -175.0, 4)]
    dim += [(f"p{i}", rnd.uniform(-85, 85), rnd.uniform(-180, 180), 10 + i) for i in range(25)]
    left = spark.createDataFrame(left, "listing_id string, latitude double, longitude double")
    dim = spark.createDataFrame(dim, "name string, lat double, lon double, ord long")
    got = [{r[0]: r[1] for r in SP.nearest_one(left, dim, out="nn", force=form)
            .select("listing_id", "nn.name").collect()} for form in (None, "grid")]
    assert got[0] == got[1]
    assert [got[1][k] for k in ("east", "west", "pole", "none")] == ["b", "c", "d", None]


def test_exact_quantiles_match_pandas_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)]
    rows += [(f"g{i % 7}", rnd.random() * 100) for i in range(1000)]
    rows += [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["med"]) for r in
           R.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "med": 0.5}).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, s in pdf.groupby("g")["v"]:
        assert math.isclose(got[g][0], s.quantile(0.25), rel_tol=1e-12)
        assert math.isclose(got[g][1], s.median(), rel_tol=1e-12)


def test_ks_of_identical_samples_is_zero(spark):
    df = spark.createDataFrame([(float(i % 13),) for i in range(500)], "v double").withColumn("f", F.lit("x"))
    r = R.ks_statistic(df, df, ["f"], "v").first()
    assert r["ks_statistic"] == 0.0 and r["n_a"] == 500


def test_row_index_independent_of_partitions(spark):
    df = spark.createDataFrame([(i % 3, f"id{i:04d}") for i in range(300)], "c int, id string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for p in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        out.append(sorted(tuple(r) for r in S.row_index(df, ["c"], "id", "i").select("c", "id", "i").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
    assert [r[2] for r in out[0] if r[0] == 0][:3] == [0, 1, 2]


def test_exact_split_size(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(2585)], "listing_id string")
    n_test = J.train_test_split(df, "listing_id").where("split = 'test'").count()
    assert n_test == 517  # ceil(0.2 * 2585)


def test_row_index_null_keys_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5), (None, 6)], "k string, v int")
    got = sorted((r["k"] or "", r["row_idx"], r["row_idx_n"]) for r in S.row_index(df, ["k"], "v").collect())
    assert got == [("", 0, 2), ("", 1, 2), ("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]


def test_long_polyline_equals_inlined(spark):
    pts = [(37.0 + 0.3 * math.cos(k / 100), 55.7 + 0.2 * math.sin(k / 100)) for k in range(701)]
    seg = spark.createDataFrame([(7, k, *pts[k], *pts[k + 1]) for k in range(700)],
                                "feature_id int, seg_id int, lon1 double, lat1 double, lon2 double, lat2 double")
    left = spark.createDataFrame([(1, 55.75, 37.6), (2, None, 37.0), (3, 55.1, 36.2)],
                                 "id int, latitude double, longitude double")
    long_ = {r["id"]: r["d"] for r in SP.point_to_polyline(left, seg, "d", first_feature_only=True, key="id").collect()}
    near = {}
    for low in range(0, 700, 350):
        part = seg.where((F.col("seg_id") >= low) & (F.col("seg_id") < low + 350))
        for r in SP.point_to_polyline(left, part, "d").collect():
            if r["d"] is not None:
                near[r["id"]] = min(r["d"], near.get(r["id"], 1e9))
    assert long_[2] is None and {k: v for k, v in long_.items() if v is not None} == near


def test_empty_polyline_is_an_error(spark):
    seg = spark.createDataFrame([], "feature_id int, lon1 double, lat1 double, lon2 double, lat2 double")
    left = spark.createDataFrame([(1, 55.75, 37.6)], "id int, latitude double, longitude double")
    with pytest.raises(ValueError):
        SP.point_to_polyline(left, seg, "d")


def test_wide_category_keeps_one_schema(spark):
    from geoflat.operators import ml
    df = spark.range(300).select(F.concat(F.lit("c"), F.col("id")).alias("cat"), "id")
    out = ml.one_hot(df, "cat")
    assert out.columns == ["id", *sorted(f"cat_c{k}" for k in range(300))]
    assert all(sum(r[f"cat_c{k}"] for k in range(300)) == r[f"cat_c{r['id']}"] == 1 for r in out.collect())


def test_zero_streak_covers_every_page_unless_limited(spark):
    from geoflat.operators import crawl
    log = spark.createDataFrame([("g", p, 0, p if p % 9 else 0) for p in range(1, 1501)],
                                "grp string, page int, pos int, link int")
    got = crawl.zero_streak_stop(log).collect()
    assert len(got) == 1500 and all(r["read"] for r in got)
    assert {r["zero_streak"] for r in got} == {0, 1}
    assert crawl.zero_streak_stop(log, max_pages=100).count() == 100


def test_kmeans_takes_the_best_of_all_starts(spark):
    import random

    import numpy as np

    from geoflat.operators import clusters as C
    rng = random.Random(5)
    places = [(rng.gauss(i % 7, 0.2), rng.gauss(i % 5, 0.2)) for i in range(2100)]
    points = spark.createDataFrame([(x, y, 1 + i % 3) for i, (x, y) in enumerate(places)], "x double, y double, w bigint")
    centres, costs = C.minibatch_kmeans(points, 25)

    def cost(c):
        return sum((1 + i % 3) * min((x - a) ** 2 + (y - b) ** 2 for a, b in c) for i, (x, y) in enumerate(places))
    assert len(costs) == 20 and len(centres) == 25
    assert cost(centres) == pytest.approx(min(costs))
    assert len({round(c, 6) for c in costs}) > 1          # the starts differ
    one_start = [C.minibatch_kmeans(points, 25, (s,))[1][0] for s in (42, 50)]
    assert one_start == pytest.approx([costs[0], costs[8]])
    again = C.minibatch_kmeans(points.repartition(5), 25)[0]
    assert np.array_equal(centres, again)                  # not a matter of partitioning


def test_kmeans_step_is_the_running_mean():
    import numpy as np

    from geoflat.operators import clusters as C
    rng = np.random.default_rng(1)
    s = C.Start(rng, np.array([[0.0, 0.0], [10.0, 10.0]]), np.zeros(2))
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(10, 1, (60, 2))])
    w = rng.integers(1, 4, 120).astype(float)
    for at in range(0, 60, 20):
        rows = np.r_[at:at + 20, 60 + at:80 + at]
        s.step(x[rows], w[rows])
    assert np.allclose(s.centres, [np.average(x[:60], axis=0, weights=w[:60]), np.average(x[60:], axis=0, weights=w[60:])])
    assert list(s.counts) == [w[:60].sum(), w[60:].sum()]
    s.counts[1] = 0.0
    s.reset_starved(x[:5])
    assert any(np.array_equal(s.centres[1], p) for p in x[:5]) and s.counts[1] == s.counts[0]


def test_kmeans_labels_every_row(spark, monkeypatch):
    from geoflat.operators import clusters as C
    rows = [(i, 55 + i % 3, 37 + i % 3) for i in range(30)] + [(30, 56, 38)] * 500 + [(31, None, 37), (32, 55, float("nan"))]
    df = spark.createDataFrame([(i, None if a is None else float(a), float(o)) for i, a, o in rows],
                               "listing_id int, latitude double, longitude double")
    got = C.kmeans_geo(df, 5).collect()
    assert len(got) == len(rows)
    assert {r["listing_id"]: r["geo_generation_cluster"] for r in got} == {
        **{i: i % 3 for i in range(30)}, 30: 1, 31: None, 32: None}
    assert C.kmeans_geo(df.where("longitude = 37 and latitude = 55"), 2).agg({"geo_generation_cluster": "max"}).first()[0] == 0
    assert C.kmeans_geo(df.limit(0)).count() == 0
    monkeypatch.setattr(C, "DRAW_POINTS", 2)               # draws smaller than the table
    monkeypatch.setattr(C, "PASSES", 4)
    assert {r["geo_generation_cluster"] for r in C.kmeans_geo(df, 1).collect()} == {0, None}


def test_kmeans_feeds_summary_and_synthesis(spark):
    from geoflat.plans import q_ml
    from conftest import SF_SMALL
    labelled = q_ml.kmeans_clustered(spark, SF_SMALL)
    by = {r[0]: r[1] for r in labelled.groupBy("geo_generation_cluster").count().collect()}
    summary = q_ml.q_kmeans_cluster_summary(spark, SF_SMALL).collect()
    assert {r["geo_generation_cluster"]: r["count"] for r in summary} == by and len(by) == 25
    assert all(r["median_price"] > 0 for r in summary)
    report = q_ml.q_kmeans_synth(spark, SF_SMALL).collect()
    assert {r["geo_generation_cluster"] for r in report} == set(by)
    assert sum(r["synthetic_rows"] for r in report) > 0


def test_ridge_equals_the_normal_equations(spark):
    import numpy as np

    from geoflat.operators import ml as K
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 3)) * [1, 50, 0.1] + [0, 1000, 5], 3)
    y = np.round(x @ [3.0, -0.5, 20.0] + 1e6 + rng.normal(size=200))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = K.ridge_fit(df, ["a", "b", "c"], "y", alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.weights, w, rtol=1e-8) and abs(m.intercept - (y.mean() - x.mean(0) @ w)) < 1e-3
    got = [r[0] for r in K.ridge_predict(m, df).select("prediction").collect()]
    assert np.allclose(got, x @ w + y.mean() - x.mean(0) @ w)
    assert K.ridge_fit(df.limit(0), ["a"], "y").weights == [0.0]


def test_symmetric_trees_by_brute_force(spark):
    import numpy as np

    from geoflat.operators import boosting as B
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = 5 * (x[:, 0] > 0.3) - 3 * x[:, 1] + rng.normal(size=400) * 0.1
    m = B.fit_symmetric_trees(x[:300], y[:300], x[300:], y[300:], iterations=60, depth=3, rate=0.3)
    errors = [np.abs(y[300:] - B.SymmetricTrees(m.base, m.feature[:k], m.border[:k], m.value[:k], m.weight[:k], []).predict(
        x[300:])).mean() for k in range(1, len(m.feature) + 1)]
    assert np.allclose(errors, m.holdout_errors[:len(errors)]) and len(errors) == int(np.argmin(m.holdout_errors)) + 1
    assert min(errors) < 0.25 * np.abs(y[300:] - m.base).mean()
    # the first question of the first tree has the largest gain of all, by trying each
    sign = np.sign(y[:300] - np.median(y[:300]))
    def gain(f, b):
        left = x[:300, f] <= b
        return sum(sign[s].sum() ** 2 / (s.sum() + B.L2) for s in (left, ~left))
    best = max(gain(f, b) for f in range(4) for b in B.quantile_borders(x[:300, f]))
    assert abs(gain(m.feature[0][0], m.border[0][0]) - best) < 1e-9
    # leaf values are medians of residuals, times the rate
    leaf = sum((x[:300, f] > b).astype(int) << k for k, (f, b) in enumerate(zip(m.feature[0], m.border[0], strict=True)))
    for v in range(8):
        want = np.median((y[:300] - m.base)[leaf == v]) * 0.3 if (leaf == v).any() else 0
        assert abs(m.value[0][v] - want) < 1e-12
    importance = m.importance(4)
    assert abs(importance.sum() - 100) < 1e-9 and importance[:2].sum() > 90
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    assert np.allclose([r[0] for r in df.select(B.predicted(df, m, list("abcd"))).collect()], m.predict(x))
    none = B.fit_symmetric_trees(x[:0], y[:0], x[:0], y[:0], iterations=3)
    assert none.predict(x).tolist() == [0.0] * 400


def test_geojson_parts_stay_one_feature(spark, tmp_path):
    import json

    from geoflat.operators.spatial import point_to_polyline
    from geoflat.sources.osm import read_ring_geojson
    parts = [[[37.0 + k / 1e4, 55.0], [37.0 + k / 1e4, 55.1]] for k in range(1001)]
    feats = [{"type": "Feature", "properties": {}, "geometry": {"type": t, "coordinates": c}}
             for t, c in [("MultiLineString", parts), ("LineString", [[38.0, 55.0], [38.0, 55.1]])]]
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    seg = read_ring_geojson(spark, str(tmp_path / "r.json"))
    assert {r["feature_id"]: r["n"] for r in seg.groupBy("feature_id").agg(
        F.count("*").alias("n")).collect()} == {0: 1001, 1: 1}
    near = spark.createDataFrame([(55.05, 37.1)], "latitude double, longitude double")
    two = seg.where("feature_id = 1 OR part IN (0, 1000)")
    assert point_to_polyline(near, two, "km", crs="webmercator", first_feature_only=True).first()["km"] < 0.01


def _brute_points(rows, dims):
    """Nearest (ord) per row by the haversine formula, ties to the least ord."""
    import math
    out = {}
    for key, lat, lon in rows:
        best = None
        for dlat, dlon, ord_ in dims:
            p1, p2 = math.radians(lat), math.radians(dlat)
            a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(dlon - lon) / 2) ** 2
            d = 2 * 6371 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))
            if best is None or (round(d, 7), ord_) < best:
                best = (round(d, 7), ord_)
        out[key] = best
    return out


def test_near_index_points_equal_brute_force_in_one_tree_and_in_tiles(spark, monkeypatch):
    import random

    from geoflat.operators import near_index
    rng = random.Random(8)
    dims = [(rng.gauss(50, 2), rng.gauss(179.5, 1), k) for k in range(300)]
    dims = [(a, b if b <= 180 else b - 360, k) for a, b, k in dims]
    dims += [(-89.9, 0.0, 300), (10.0, 10.0, 302), (10.0, 10.0, 301), (10.0, 12.0, 303)]  # far, twins, a tie
    rows = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)]
    rows += [(200 + k, *dims[k][:2]) for k in range(40)] + [(900, 10.0, 11.0), (901, 10.0, 10.0)]
    left = spark.createDataFrame(rows + [(999, None, 3.0)], "listing_id bigint, latitude double, longitude double")
    dim = spark.createDataFrame(dims, "lat double, lon double, ord bigint").withColumn("name", F.col("ord").cast("string"))
    want = _brute_points(rows, dims)
    plain = near_index.attach_nearest
    for size in (near_index.TILE_ITEMS, 37):
        monkeypatch.setattr(SP, "attach_nearest", lambda *a, **k: plain(*a, **{**k, "tile_items": size}))
        monkeypatch.setattr(near_index, "PART_ROWS", 50)
        got = {r["listing_id"]: r["nn"] for r in SP.nearest_one(left, dim, out="nn", force="grid").collect()}
        assert got.pop(999) is None and len(got) == len(want)
        for key, (d, ord_) in want.items():
            assert abs(got[key]["dist"] - d) < 1e-6, (size, key)
            if key >= 200:
                assert (got[key]["ord"], got[key]["name"]) == (ord_, str(ord_)), (size, key)


def test_near_index_memory_is_bounded_on_a_winding_line():
    """Many boxes of a winding line lie about as near to a row; one batch must not hold them all."""
    import tracemalloc

    import numpy as np

    from geoflat.operators import near_index
    turn, far = np.arange(8001) * 2 * np.pi / 1500, 0.05 + np.arange(8001) / 4e4
    at = np.column_stack([far * np.cos(turn), far * np.sin(turn), np.zeros(len(far))])
    a, b = at[:-1], at[1:]
    rows = np.random.default_rng(5).uniform(-0.3, 0.3, (4096, 3)) * [1, 1, 0]
    tree = near_index.BoxTree(np.column_stack([a, b]))
    tracemalloc.start()
    row, item, found = tree.nearest(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, peak
    for r in range(0, len(rows), 64):
        t = np.clip(((rows[r] - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        want = np.sqrt(((rows[r] - a - t[:, None] * (b - a)) ** 2).sum(1))
        assert want.argmin() in item[row == r] and np.allclose(found[row == r], want.min(), rtol=1e-8, atol=0)


def test_near_index_segments_equal_brute_force(spark, monkeypatch):
    import numpy as np

    from geoflat.operators import near_index
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=(900, 2)) * [0.01, 0.02], axis=0) + [55.75, 37.6]
    seg = [(float(a[0]), float(a[1]), float(b[0]), float(b[1]), 0) for a, b in zip(walk, walk[1:], strict=False)]
    seg += [(55.0, 37.0, 55.0, 37.0, 0), (50.0, 30.0, 60.0, 45.0, 0)]  # a point, a very long one
    segments = spark.createDataFrame(seg, "lat1 double, lon1 double, lat2 double, lon2 double, feature_id int")
    left = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(
        rng.uniform([50, 30], [60, 45], size=(150, 2)))] + [(500, None, 1.0)], "listing_id bigint, latitude double, longitude double")
    plain = near_index.attach_nearest
    found = []
    monkeypatch.setattr(SP, "SEGMENT_LIMIT", 1)
    for size in (10 ** 6, 100):
        monkeypatch.setattr(SP, "attach_nearest", lambda *a, **k: plain(*a, **{**k, "tile_items": size}))
        found.append({r[0]: r[1] for r in SP.point_to_polyline(left, segments, "d").select("listing_id", "d").collect()})
    from geoflat.functions.geo import project_utm37
    def flat(df, la, lo):
        return np.array([list(r) for r in df.select(*[c for a, b in zip(la, lo, strict=True) for c in project_utm37(a, b)]).collect()])
    p = flat(left.where("latitude is not null").orderBy("listing_id"), ["latitude"], ["longitude"])
    s = flat(segments, ["lat1", "lat2"], ["lon1", "lon2"])
    ab = s[:, 2:] - s[:, :2]
    size = (ab ** 2).sum(1)
    t = ((p[:, None] - s[None, :, :2]) * ab).sum(-1) / np.where(size > 0, size, 1)
    want = np.sqrt(((p[:, None] - s[None, :, :2] - np.clip(t, 0, 1)[..., None] * ab) ** 2).sum(-1)).min(1) / 1000
    for got in found:
        assert got.pop(500) is None
        assert np.allclose([got[k] for k in range(150)], want, rtol=1e-9)


def _brute_elements(html):
    """Texts of li and a elements by the standard parser, with the closing rules of lists."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.open, self.done = [], []

        def close_from(self, k):
            for e in self.open[k:]:
                if e[0] in ("li", "a"):
                    self.done.append(" ".join(e[1]))
            del self.open[k:]

        def handle_starttag(self, tag, attrs):
            if tag not in ("li", "a", "ul", "ol"):
                return
            if tag == "li":
                k = max((i for i, e in enumerate(self.open) if e[0] in ("li", "ul", "ol")), default=None)
                if k is not None and self.open[k][0] == "li":
                    self.close_from(k)
            if tag == "a" and any(e[0] == "a" for e in self.open):
                self.close_from(max(i for i, e in enumerate(self.open) if e[0] == "a"))
            self.open.append((tag, []))

        def handle_endtag(self, tag):
            if tag in ("li", "a", "ul", "ol") and any(e[0] == tag for e in self.open):
                self.close_from(max(i for i, e in enumerate(self.open) if e[0] == tag))

        def handle_data(self, data):
            if data.strip():
                for e in self.open:
                    e[1].append(data.strip())
    p = P()
    p.feed(html)
    p.close()
    p.close_from(0)
    return sorted(p.done)


def test_element_texts_keep_nested_elements(spark):
    import random

    from geoflat.operators import extract as E
    pages = ["<ul><li><a>X</a> Y</li></ul>", "<li>a<li>b<ul><li>c</li> d</ul> e</li>", "<a>one<a>two</a> three",
             "<li>no end <b>bold</b>", "</a></li>text", "", "<LI CLASS='x'>Up</LI><link><article>n</article>"]
    rng = random.Random(1)
    bits = ["<ul>", "</ul>", "<li>", "</li>", "<a href='q'>", "</a>", "<b>", "</b>", " w ", "x", "y z", "<br>"]
    pages += ["".join(rng.choice(bits) + (str(k) if rng.random() < .3 else "") for k in range(rng.randrange(25))) for _ in range(150)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(pages)] + [(-1, None)], "k int, html string")
    got = {r["k"]: sorted(r["t"]) for r in E.element_texts(df, "html", "t").collect()}
    assert got.pop(-1) == []
    for k, h in enumerate(pages):
        assert got[k] == _brute_elements(h), h


def test_exact_ks_pvalue_equals_enumeration():
    import itertools

    from geoflat.operators.ranks import ks_exact_pvalue
    for m, n in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 2)):
        found = []
        for at in itertools.combinations(range(m + n), m):
            i = j = 0
            worst = 0.0
            for k in range(m + n):
                i, j = (i + 1, j) if k in at else (i, j + 1)
                worst = max(worst, abs(i / m - j / n))
            found.append(worst)
        for d in sorted(set(found)):
            want = sum(x >= d - 1e-12 for x in found) / len(found)
            assert abs(ks_exact_pvalue(d, m, n) - want) < 1e-12
    assert ks_exact_pvalue(0.0, 5, 7) == 1.0
    assert 0 < ks_exact_pvalue(0.9, 60, 70) < 1e-15  # no cancellation in the far tail


def test_features_keep_their_file_order_however_files_are_split(spark, tmp_path):
    from geoflat.sources import osm
    for name, first, count in (("b", 400, 300), ("a", 0, 400)):        # written out of order, unlike sizes
        (tmp_path / f"{name}.json").write_text("".join(
            '{"geometry": {"type": "LineString", "coordinates": [[%d, 1], [%d, 2]]}}\n' % (k, k)
            for k in range(first, first + count)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seg = osm.read_ring_geojson(spark, str(tmp_path), seq=True)
            got = seg.select("feature_id", "lon1").collect()
            assert len(got) == 700 and all(r["feature_id"] == r["lon1"] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_stored_stages_are_compact_and_keep_every_value(spark):
    """Wide stages are written by column: smaller than as whole rows, with the same values."""
    import os

    from geoflat.plans.clean import clean_listings
    from geoflat.session import cut_lineage, ensure_checkpoint_dir, stored

    def written():
        root = ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(root) for f in fs)

    rows = spark.range(40_000).selectExpr(
        "cast(id as string) as listing_id", "4e6 + id as price", "20e0 + id % 50 as area_total", "1 + id % 5 as floor",
        "9 as floors_total", "55e0 + id % 91 / 1e3 as latitude", "37e0 + id % 97 / 1e3 as longitude",
        *[f"md5(cast(id % {n} as string)) as {c}" for n, c in ((3, "walls"), (5, "parking"), (7, "renovation"), (11, "elevator"))])
    at = [written()]
    kept = clean_listings(rows)
    at.append(written())
    cut_lineage(rows)
    at.append(written())
    assert kept.count() == 40_000 and at[1] - at[0] < (at[2] - at[1]) / 2, at
    odd = spark.sql("""select * from values (1, double('nan'), 'a\n,"', named_struct('t', timestamp'2024-01-01 00:00:01.000001')),
                       (2, -0.0d, '', null), (3, null, null, null), (3, null, null, null) as t(id, x, s, o)""")
    assert sorted(map(str, stored(odd).collect())) == sorted(map(str, odd.collect()))
    assert stored(odd.where("id > 9")).count() == 0


def test_quantiles_of_small_groups_need_no_ranking_of_all_values(spark, monkeypatch):
    rows = [("big", float(i % 4001)) for i in range(12000)] + [("small", i * i / 7) for i in range(34)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(R, "_ranked_quantiles", lambda *a: pytest.fail("all values were ranked"))
    got = {r["g"]: (r["a"], r["b"]) for r in R.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.99}).collect()}
    for g, v in pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"]:
        assert got[g] == pytest.approx((v.quantile(0.01), v.quantile(0.99)), rel=1e-12)


def test_row_index_null_values_have_no_position(spark):
    df = spark.createDataFrame([(k, v, i) for k in ("a", None) for i, v in enumerate([3, None, 1, None, 2])], "k string, v int, i int")
    got = {(r["k"], r["i"]): (r["p"], r["p_n"]) for r in S.row_index(df, ["k"], "v", "p").collect()}
    for k in ("a", None):
        assert [got[k, i] for i in range(5)] == [(2, 3), (None, None), (0, 3), (None, None), (1, 3)]


def test_row_index_moves_rows_once(spark):
    df = spark.range(1000).selectExpr("id % 3 as c", "id")
    plan = S.row_index(df, ["c"], "id", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_dedup_sorts_only_repeated_keys(spark):
    from geoflat.operators import filters as D
    rows = [(None, 1.0, "b", "x"), (None, 1.0, "a", "y"), (1, None, "c", "z"), (2, 2.0, None, "w"), (3, 3.0, "d", "v"),
            (4, 4.0, None, "u"), (4, 4.0, "e", "t")]
    df = spark.createDataFrame(rows, "p int, q double, id string, s string")
    fast = sorted(map(str, D.dedup_keep_first(df, ["p", "q"], "id").collect()))
    assert fast == sorted(map(str, D._dedup_all(df, ["p", "q"], "id").collect())) and len(fast) == 5
    alone = D.dedup_keep_first(spark.range(50).selectExpr("id as p", "cast(id as string) as id"), ["p"], "id")
    assert alone.count() == 50 and "SortAggregate" not in alone._jdf.queryExecution().executedPlan().toString()


def test_py_strip_equals_the_unicode_pattern(spark):
    signs = [chr(i) for i in range(1, 0x3100) if not 0x80 <= i < 0xa0 or i == 0x85]
    df = spark.createDataFrame([(f"{c}{c} a{c}b {c}",) for c in signs] + [("",), (" \n",), (None,)], "t string")
    assert df.where(~T.py_strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_product_sums_are_exact():
    import numpy as np
    import pyarrow as pa
    from geoflat.operators import ml as K
    rng = np.random.default_rng(3)
    x = [None if i % 5 == 0 else float(v) for i, v in enumerate(rng.normal(0, 1e8, 4000))]
    y = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.normal(3, 1e-2, 4000))]
    batch = pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    pairs = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    cols = [[1.0] * 4000, x, y]
    assert K.product_sums(batch, pairs) == [
        sum(int(np.rint(a * b * 1e6)) for a, b in zip(cols[i], cols[j]) if a is not None and b is not None) for i, j in pairs]


def test_correlations_equal_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(1e3, 1.0, (500, 3)), columns=list("abc"))
    pdf["c"] += pdf["a"]
    pdf.loc[::3, "b"] = None
    pdf["k"], pdf["e"] = 7.25, None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()],
                               "a double, b double, c double, k double, e double").repartition(5)
    plan = S.corr_matrix(df, list("abcke"))
    got = {(r["feature_x"], r["feature_y"]): r["corr"] for r in plan.collect()}
    assert len(got) == 25 and got["a", "a"] == 1.0 and got["k", "k"] is None and got["a", "k"] is None and got["e", "a"] is None
    want = pdf[list("abc")].corr()
    for x in "abc":
        for y in "abc":
            assert abs(got[x, y] - want.loc[x, y]) < 1e-9
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["corr"] for r in S.corr_matrix(df.limit(0), ["a", "b"]).collect()} == {None}
