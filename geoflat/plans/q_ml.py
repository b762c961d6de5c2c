"""Registered queries: scaling, clustering, regression models and their error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rand import hash_u64_sql
from ..operators import boosting as B
from ..operators import ml as K
from ..operators import stats as S
from ..operators import synth as J
from ..operators.clusters import kmeans_geo
from ..session import cut_lineage, stored
from ..sources import fixtures as X
from ..sources.fixtures import oracle_with
from .catalog import query, rnd, sig, sig_sql
from .q_clean import cleaned_listings, cluster_summary

# Features of the model table, and the wall classes that the fixture has.
NUMERIC_FEATURES = ["area_total", "rooms", "floor", "floors_total", "kitchen_area", "metro_walk_min",
                    "metro_missing", "floor_ratio"]
WALLS = ["деревянный", "кирпич", "монолит", "панель"]
MODEL_FEATURES = NUMERIC_FEATURES + [f"walls_clean_{w}" for w in WALLS]

# The model table from the regression notebook's rules, and the same split as everywhere.
_TABLE_SQL = oracle_with("model_listings") + """
, med AS (SELECT quantile_cont(CAST(metro_walk_min AS DOUBLE), 0.5) AS m, quantile_cont(kitchen_area, 0.5) AS k
          FROM model_listings),
filled AS (SELECT listing_id, price, area_total, CAST(rooms AS DOUBLE) AS rooms, CAST(floor AS DOUBLE) AS floor,
                  CAST(floors_total AS DOUBLE) AS floors_total, coalesce(kitchen_area, k) AS kitchen_area,
                  coalesce(CAST(metro_walk_min AS DOUBLE), m) AS metro_walk_min,
                  CAST(metro_walk_min IS NULL AS INTEGER) AS metro_missing,
                  CASE walls WHEN 'Монолитный' THEN 'монолит' WHEN 'Кирпично-монолитный' THEN 'монолит'
                             WHEN 'Кирпичный' THEN 'кирпич' WHEN 'Панельный' THEN 'панель' ELSE lower(walls) END AS w
           FROM model_listings, med),
model AS (SELECT *, floor / floors_total AS floor_ratio, """ + ", ".join(
    f"CAST(w = '{w}' AS INTEGER) AS walls_clean_{w}" for w in WALLS) + """ FROM filled
  WHERE price IS NOT NULL AND area_total IS NOT NULL AND rooms IS NOT NULL AND floor IS NOT NULL
    AND floors_total IS NOT NULL AND w IS NOT NULL
    AND price >= 2000000 AND price <= 200000000 AND area_total >= 15 AND area_total <= 250
    AND kitchen_area >= 3 AND kitchen_area <= 60 AND floor >= 1 AND floor <= 100
    AND floors_total >= 1 AND floors_total <= 100 AND floor <= floors_total
    AND metro_walk_min >= 1 AND metro_walk_min <= 90)"""

_P = len(MODEL_FEATURES)
_VALUES = ["1.0", *MODEL_FEATURES, "price"]
# Normal equations of the centred columns, solved by Gauss-Jordan steps, one row of the recursion each.
_RIDGE_SQL = _TABLE_SQL + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY {hash_u64_sql("listing_id", "'split'", "'42'")}, listing_id) AS _rk,
                    count(*) OVER () AS _cnt FROM model),
tr AS (SELECT [{", ".join(f"CAST({c} AS DOUBLE)" for c in _VALUES)}] AS v FROM ranked WHERE _rk > ceil(0.2 * _cnt)),
te AS (SELECT * FROM ranked WHERE _rk <= ceil(0.2 * _cnt)),
cell AS (SELECT i, j, sum(CAST(round_even(v[i] * v[j] * 1e6, 0) AS HUGEINT)) / 1e6 AS s
         FROM tr, range(1, {_P + 3}) a(i), range(1, {_P + 3}) b(j) GROUP BY i, j),
gram AS (SELECT c.i - 1 AS i, list(c.s - a.s * b.s / n.s + CASE WHEN c.i = c.j THEN 1.0 ELSE 0.0 END ORDER BY c.j) AS line
         FROM cell c JOIN cell a ON a.i = 1 AND a.j = c.i JOIN cell b ON b.i = 1 AND b.j = c.j JOIN cell n ON n.i = 1 AND n.j = 1
         WHERE c.i BETWEEN 2 AND {_P + 1} AND c.j >= 2 GROUP BY c.i),
solve AS (
  SELECT 1 AS k, list(line ORDER BY i) AS m FROM gram
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
           ELSE list_transform(r, lambda x, j: x - r[k] / m[k][k] * m[k][j]) END) FROM solve WHERE k <= {_P}),
w AS (SELECT list_transform(m, lambda r: r[{_P + 1}]) AS w FROM solve WHERE k = {_P + 1}),
mean AS (SELECT list(a.s / n.s ORDER BY a.j) AS m FROM cell a JOIN cell n ON n.i = 1 AND n.j = 1 WHERE a.i = 1 AND a.j >= 2),
pred AS (SELECT listing_id, price AS price_real, area_total,
                m[{_P + 1}] + {" + ".join(f"ww.w[{k + 1}] * ({c} - m[{k + 1}])" for k, c in enumerate(MODEL_FEATURES))} AS price_pred
         FROM te, w AS ww, mean),
errs AS (SELECT *, price_pred - price_real AS delta, abs(price_pred - price_real) AS abs_error,
                abs(price_pred - price_real) / nullif(abs(price_real), 0) * 100 AS ape,
                abs(price_pred - price_real) / nullif(area_total, 0) AS error_per_m2 FROM pred)
"""
_RIDGE_SQL = _RIDGE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def model_rows(spark, sf_dir):
    """The model table, which is stored, and its features."""
    m = K.model_table(X.model_listings(spark, sf_dir))
    return m, NUMERIC_FEATURES + [c for c in m.columns if c.startswith("walls_clean_")]


def _model_split(spark, sf_dir):
    m, features = model_rows(spark, sf_dir)
    s = J.train_test_split(m, "listing_id")
    return s.where("split = 'train'"), s.where("split = 'test'"), features


def _ridge_pred(spark, sf_dir):
    train, test, features = _model_split(spark, sf_dir)
    return K.predict_table(K.ridge_predict(K.ridge_fit(train, features, "price"), test))


@query("standardize", sql=oracle_with("listings") + f"""
SELECT listing_id, round((latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER (), 6) AS latitude_z,
       round((longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER (), 6) AS longitude_z
FROM listings""")
def q_standardize(spark, sf_dir):
    """K1: population-std scaling of the coordinates."""
    z = K.standardize(X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude"),
                      ["latitude", "longitude"])
    return z.select("listing_id", rnd("latitude_z", 6).alias("latitude_z"),
                    rnd("longitude_z", 6).alias("longitude_z"))


def kmeans_clustered(spark, sf_dir, k: int = 25):
    """Cleaned listings with their k-means cluster, written once to the checkpoint folder."""
    return stored(kmeans_geo(stored(cleaned_listings(spark, sf_dir)), k))


@query("kmeans_geo")
def q_kmeans_geo(spark, sf_dir):
    """K2: 25 mini-batch k-means clusters on scaled coordinates, best of 20 starts, stable ids
    (rows-only check)."""
    c = cut_lineage(cleaned_listings(spark, sf_dir).select("listing_id", "latitude", "longitude"))
    return kmeans_geo(c).select("listing_id", "geo_generation_cluster")


@query("kmeans_cluster_summary")
def q_kmeans_cluster_summary(spark, sf_dir):
    """K2 + F1: size, mean coordinates and median prices of the k-means clusters (rows-only check)."""
    return cluster_summary(kmeans_clustered(spark, sf_dir))


@query("kmeans_synth")
def q_kmeans_synth(spark, sf_dir):
    """K2 + F9 + J1 + J2 + F2: training rows of each k-means cluster, and the rows interpolated inside
    it (rows-only check)."""
    filled = S.group_median_impute(kmeans_clustered(spark, sf_dir), "rooms", "kitchen_area")
    train = stored(J.train_test_split(filled, "listing_id").where("split = 'train'").drop("split"))
    return J.cluster_report(J.mark_original(train).unionByName(J.synth_interpolate(train, cheap=True)))


@query("ridge", sql=_RIDGE_SQL + f"SELECT listing_id, {sig_sql('price_pred', 9)} AS price_pred FROM errs")
def q_ridge(spark, sf_dir):
    """K3: ridge regression (alpha 1) on the train split, predictions on the test split."""
    return _ridge_pred(spark, sf_dir).select("listing_id", sig("price_pred", 9).alias("price_pred"))


@query("predict_table", sql=_RIDGE_SQL + f"""
SELECT listing_id, price_real, {sig_sql('price_pred', 6)} AS price_pred, {sig_sql('abs_error', 4)} AS abs_error
FROM errs""")
def q_predict_table(spark, sf_dir):
    """K6 + C35: predictions next to the truth with error columns."""
    p = _ridge_pred(spark, sf_dir)
    return p.select("listing_id", "price_real", sig("price_pred", 6).alias("price_pred"),
                    sig("abs_error", 4).alias("abs_error"))


@query("regression_metrics", sql=_RIDGE_SQL + f"""
SELECT {sig_sql('avg(abs_error)', 5)} AS mae, {sig_sql('avg(ape)', 5)} AS mape FROM errs""")
def q_regression_metrics(spark, sf_dir):
    """MAE and MAPE of the ridge model on the test split."""
    m = K.regression_metrics(_ridge_pred(spark, sf_dir))
    return m.select(sig("mae", 5).alias("mae"), sig("mape", 5).alias("mape"))


@query("mae_per_m2", sql=_RIDGE_SQL + f"SELECT {sig_sql('avg(error_per_m2)', 5)} AS mae_per_m2 FROM errs")
def q_mae_per_m2(spark, sf_dir):
    """F20."""
    return K.mae_per_m2(_ridge_pred(spark, sf_dir)).select(sig("mae_per_m2", 5).alias("mae_per_m2"))


@query("segment_errors", sql=_RIDGE_SQL + f"""
, b AS (SELECT CASE WHEN price_real > 0 AND price_real <= 10000000 THEN '0-10M'
  WHEN price_real > 10000000 AND price_real <= 20000000 THEN '10-20M' WHEN price_real > 20000000 AND price_real <= 40000000 THEN '20-40M'
  WHEN price_real > 40000000 AND price_real <= 100000000 THEN '40-100M' WHEN price_real > 100000000 AND price_real <= 500000000 THEN '100M+'
  END AS price_bin, abs_error, ape FROM errs),
bins AS (SELECT * FROM (VALUES ('0-10M'), ('10-20M'), ('20-40M'), ('40-100M'), ('100M+')) t(price_bin))
SELECT bins.price_bin, CAST(count(b.price_bin) AS BIGINT) AS count, {sig_sql('avg(b.abs_error)', 5)} AS mae,
       {sig_sql('avg(b.ape)', 5)} AS mape FROM bins LEFT JOIN b USING (price_bin) GROUP BY bins.price_bin""")
def q_segment_errors(spark, sf_dir):
    """errors per price segment, every segment listed."""
    s = K.segment_errors(_ridge_pred(spark, sf_dir))
    return s.select("price_bin", "count", sig("mae", 5).alias("mae"), sig("mape", 5).alias("mape"))


@query("top_deals", sql=_RIDGE_SQL + f"""
SELECT listing_id, price_real, {sig_sql('price_pred', 6)} AS price_pred, {sig_sql('delta', 6)} AS delta, area_total
FROM errs ORDER BY delta DESC, listing_id LIMIT 20""")
def q_top_deals(spark, sf_dir):
    """H1: the 20 listings priced furthest below the model."""
    t = K.top_deals(_ridge_pred(spark, sf_dir))
    return t.select("listing_id", "price_real", sig("price_pred", 6).alias("price_pred"),
                    sig("delta", 6).alias("delta"), "area_total")


@query("model_features", sql=_TABLE_SQL + f"""
SELECT listing_id, price, {", ".join(MODEL_FEATURES)} FROM model""")
def q_model_features(spark, sf_dir):
    """K7: the model table (price per m2 - a target leak - is off by default)."""
    m, features = model_rows(spark, sf_dir)
    return m.select("listing_id", "price", *[F.col(c).cast("double").alias(c) if c in ("rooms", "floor", "floors_total")
                                             else F.col(f"`{c}`") for c in features])


def _boosted(spark, sf_dir):
    """The best of 700 iterations on the test rows of the split: model, features, predictions of all
    test rows, training rows. Fitted on all training rows."""
    train, test, features = _model_split(spark, sf_dir)
    train, test = stored(train), stored(test)
    model = B.fit_all_rows(train, test, features, "price")
    pred = K.predict_table(test.withColumn("prediction", B.predicted(test, model, features)))
    return model, features, pred, train.count()


def _importance_rows(spark, model, features, top: int = 15):
    found = zip(features, model.importance(len(features)).tolist(), strict=True)
    rows = sorted(found, key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


@query("boosted_trees")
def q_boosted_trees(spark, sf_dir):
    """K4: absolute-loss boosted symmetric trees on the model table, the best of 700 iterations on the
    test rows: the features that matter, with the model's errors on all test rows and those of the
    median of the training rows (rows-only)."""
    model, features, pred, n = _boosted(spark, sf_dir)
    pred = cut_lineage(pred.select("price_real", "abs_error", "ape"))
    plain = pred.agg(F.avg(F.abs(F.col("price_real") - F.lit(model.base))).alias("mae_of_median"))
    return _importance_rows(spark, model, features).crossJoin(K.regression_metrics(pred)).crossJoin(plain).withColumns(
        {"training_rows": F.lit(n).cast("bigint"), "best_iteration": F.lit(len(model.feature))})


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """K5: (feature, importance) desc, top 15: how much the prediction changes, sums to 100 (rows-only)."""
    train, test, features = _model_split(spark, sf_dir)
    return _importance_rows(spark, B.fit_all_rows(stored(train), stored(test), features, "price"), features)


@query("boosted_predictions")
def q_boosted_predictions(spark, sf_dir):
    """K6: predictions of the same trees for all test rows next to the truth (rows-only)."""
    return _boosted(spark, sf_dir)[2].select("listing_id", "price_real", "price_pred", "delta", "abs_error", "ape")
