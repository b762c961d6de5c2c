"""Registered queries: aggregations, distribution statistics, windows, sorts/limits,
set operations, crawl-log windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import PRICE_BIN_LABELS, PRICE_BINS, bin_cut
from ..operators import crawl as C
from ..operators import filters as D
from ..operators import stats as S
from ..operators.projection import numeric_columns
from ..operators.ranks import exact_quantiles
from ..sources import fixtures as X
from ..sources.fixtures import oracle_with
from .catalog import exact_avg, exact_avg_sql, query, rnd, sig, sig_sql
from .clean import median_impute
from .oracle_sql import with_cleaned
from .q_clean import cleaned_listings, clustered_clean

# Numeric features of the cleaned listings.
CLEAN_NUM = ["price", "area_total", "rooms", "floor", "floors_total", "latitude", "longitude",
             "build_year", "ceiling_height", "kitchen_area", "price_per_m2", "floor_ratio",
             "house_age"]
LISTING_NUM = ["price", "area_total", "rooms", "floor", "floors_total", "latitude", "longitude",
               "build_year", "ceiling_height", "kitchen_area"]


def _unpivot_sql(src: str, cols: list[str], value: str = "value") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS {value} FROM {src}" for c in cols)


# ------------------------------------------------------------------ counts
@query("value_counts", sql=oracle_with("listings") + """
SELECT link, count(*) AS count FROM listings WHERE link IS NOT NULL
GROUP BY link ORDER BY count DESC, link LIMIT 20""")
def q_value_counts(spark, sf_dir):
    """F3 + H2: 20 most frequent links (key breaks ties)."""
    return S.value_counts(X.listings(spark, sf_dir), "link", top=20)


@query("value_counts_with_null", sql=oracle_with("listings") + """
SELECT walls, count(*) AS count FROM listings GROUP BY walls""")
def q_value_counts_with_null(spark, sf_dir):
    """F3 with dropna=False: NULL is its own value."""
    return S.value_counts(X.listings(spark, sf_dir), "walls", dropna=False)


@query("counts_by_key", sql=oracle_with("listings") + """
SELECT rooms, count(*) AS count FROM listings WHERE rooms IS NOT NULL GROUP BY rooms""")
def q_counts_by_key(spark, sf_dir):
    """counts sorted by key."""
    return S.value_counts(X.listings(spark, sf_dir), "rooms", by_key=True)


@query("group_median", sql=with_cleaned() + """
SELECT rooms, round(quantile_cont(price_per_m2, 0.5), 6) AS median_price_per_m2
FROM cleaned WHERE rooms IS NOT NULL GROUP BY rooms""")
def q_group_median(spark, sf_dir):
    """exact median price per m2 by rooms."""
    m = S.group_median(cleaned_listings(spark, sf_dir), "rooms", "price_per_m2", "m")
    return m.select("rooms", rnd("m").alias("median_price_per_m2"))


@query("group_mean", sql=with_cleaned() + f"""
SELECT rooms, {sig_sql('avg(price_per_m2)')} AS mean_price_per_m2
FROM cleaned WHERE rooms IS NOT NULL GROUP BY rooms""")
def q_group_mean(spark, sf_dir):
    """F5 (old plots): mean price per m2 by rooms."""
    return (cleaned_listings(spark, sf_dir).where(F.col("rooms").isNotNull())
            .groupBy("rooms").agg(sig(F.avg("price_per_m2")).alias("mean_price_per_m2")))


def _missing_sql(cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing, "
        f"round((count(*) - count({c})) * 100e0 / count(*), 6) AS missing_pct FROM listings"
        for c in cols)
    return oracle_with("listings") + f"SELECT * FROM ({parts}) ORDER BY missing DESC, \"column\" LIMIT 20"


LISTING_COLS = ["listing_id", "source_group", "price", "area_total", "rooms", "floor",
                "floors_total", "latitude", "longitude", "build_year", "ceiling_height",
                "kitchen_area", "walls", "renovation", "parking", "elevator", "price_raw", "link"]


@query("missing_report", sql=_missing_sql(LISTING_COLS))
def q_missing_report(spark, sf_dir):
    """NULL count and % per column, top 20."""
    r = S.missing_report(X.listings(spark, sf_dir), top=20)
    return r.select("column", "missing", rnd("missing_pct").alias("missing_pct"))


@query("fill_rate", sql=oracle_with("listings") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM listings" for c in LISTING_COLS))
def q_fill_rate(spark, sf_dir):
    """non-NULL count per column."""
    return S.fill_rate(X.listings(spark, sf_dir))


@query("median_impute", sql=oracle_with("listings") + """
, m AS (SELECT quantile_cont(CAST(build_year AS DOUBLE), 0.5) AS b,
               quantile_cont(ceiling_height, 0.5) AS c, quantile_cont(kitchen_area, 0.5) AS k
        FROM listings)
SELECT listing_id, coalesce(CAST(build_year AS DOUBLE), b) AS build_year,
       coalesce(ceiling_height, c) AS ceiling_height, coalesce(kitchen_area, k) AS kitchen_area
FROM listings, m""")
def q_median_impute(spark, sf_dir):
    """F8: NULL -> global exact median, three columns in one pass."""
    l = X.listings(spark, sf_dir).select("listing_id", "build_year", "ceiling_height",
                                         "kitchen_area")
    return median_impute(l, ["build_year", "ceiling_height", "kitchen_area"])


@query("group_median_impute", sql=oracle_with("listings") + """
, gm AS (SELECT rooms, quantile_cont(kitchen_area, 0.5) AS gm FROM listings
         WHERE rooms IS NOT NULL GROUP BY rooms),
s1 AS (SELECT l.listing_id, l.rooms,
              CASE WHEN l.rooms IS NULL THEN NULL ELSE coalesce(l.kitchen_area, gm.gm) END AS k
       FROM listings l LEFT JOIN gm ON l.rooms = gm.rooms),
g AS (SELECT quantile_cont(k, 0.5) AS g FROM s1)
SELECT listing_id, rooms, coalesce(k, g) AS kitchen_area FROM s1, g""")
def q_group_median_impute(spark, sf_dir):
    """kitchen area by rooms median, then global median (reference quirk kept)."""
    l = X.listings(spark, sf_dir).select("listing_id", "rooms", "kitchen_area")
    return S.group_median_impute(l, "rooms", "kitchen_area")


@query("group_transform", sql=oracle_with("listings") + """
SELECT listing_id, round(median(kitchen_area) OVER (PARTITION BY rooms), 6) AS rooms_median_kitchen
FROM listings WHERE rooms IS NOT NULL""")
def q_group_transform(spark, sf_dir):
    """Group median attached to every row (aggregate + join instead of a window, so a
    hot group is never sorted in one task)."""
    l = X.listings(spark, sf_dir).where(F.col("rooms").isNotNull())
    m = exact_quantiles(l, ["rooms"], "kitchen_area", {"m": 0.5})
    return l.join(m, "rooms", "left").select("listing_id",
                                             rnd("m").alias("rooms_median_kitchen"))


# ------------------------------------------------------------------ describe / corr
def _describe_sql(pcts: dict[str, float]) -> str:
    q = ", ".join(f"{sig_sql(f'quantile_cont(value, {p})')} AS {n}" for n, p in pcts.items())
    return with_cleaned() + f""", long AS ({_unpivot_sql('cleaned', CLEAN_NUM)})
SELECT feature, count(value) AS count, {sig_sql('avg(value)')} AS mean,
       {sig_sql('stddev_samp(value)')} AS std, min(value) AS min, {q}, max(value) AS max
FROM long GROUP BY feature"""


def _describe(spark, sf_dir, pcts):
    d = S.describe(cleaned_listings(spark, sf_dir), CLEAN_NUM, pcts)
    return d.select("feature", "count", sig("mean").alias("mean"), sig("std").alias("std"),
                    "min", *[sig(p).alias(p) for p in pcts], "max")


@query("describe", sql=_describe_sql(S.DESCRIBE_PCTS))
def q_describe(spark, sf_dir):
    """count, mean, std, min, quartiles, max per numeric feature."""
    return _describe(spark, sf_dir, S.DESCRIBE_PCTS)


@query("describe_pcts", sql=_describe_sql(S.DESCRIBE_PCTS_WIDE))
def q_describe_pcts(spark, sf_dir):
    """describe with 1/5/25/50/75/95/99 %."""
    return _describe(spark, sf_dir, S.DESCRIBE_PCTS_WIDE)


def _corr_sql(cols: list[str], src: str = "cleaned", filt: str = "") -> str:
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                e = f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END"
            else:
                e = sig_sql(f"corr({a}, {b})")
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {e} AS corr FROM {src}")
    return " UNION ALL ".join(parts) + filt


@query("corr_matrix", sql=with_cleaned() + _corr_sql(CLEAN_NUM))
def q_corr_matrix(spark, sf_dir):
    """full Pearson matrix (pairwise complete) in long form, one aggregate."""
    c = S.corr_matrix(cleaned_listings(spark, sf_dir), CLEAN_NUM)
    return c.select("feature_x", "feature_y", sig("corr").alias("corr"))


@query("corr_with_target", sql=with_cleaned() + "SELECT * FROM (" + _corr_sql(
    CLEAN_NUM) + ") WHERE feature_y = 'price' AND feature_x <> 'price' ORDER BY corr DESC")
def q_corr_with_target(spark, sf_dir):
    """correlation of every feature with price, descending."""
    c = S.corr_matrix(cleaned_listings(spark, sf_dir), CLEAN_NUM)
    return (c.where((F.col("feature_y") == "price") & (F.col("feature_x") != "price"))
            .select("feature_x", "feature_y", sig("corr").alias("corr"))
            .orderBy(F.col("corr").desc()))


@query("negative_report", sql=oracle_with("listings") + """
, f AS (SELECT *, 2026 - build_year AS house_age, floor - floors_total AS floor_gap FROM listings)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS negatives FROM f" for c in LISTING_NUM + ["house_age", "floor_gap"]) + ") WHERE negatives > 0")
def q_negative_report(spark, sf_dir):
    """F16: numeric columns (raw listings + derived age / floor gap) with negatives."""
    l = X.listings(spark, sf_dir).withColumns({
        "house_age": 2026 - F.col("build_year"),
        "floor_gap": F.col("floor") - F.col("floors_total")})
    return S.negative_report(l, LISTING_NUM + ["house_age", "floor_gap"])


HIST_COLS = ["price", "area_total", "price_per_m2"]


@query("histogram", sql=with_cleaned() + f""", long AS ({_unpivot_sql('cleaned', HIST_COLS)}),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS n FROM long
      WHERE value IS NOT NULL GROUP BY feature),
b AS (SELECT l.feature, CAST(CASE WHEN r.hi = r.lo THEN 1
        ELSE least(floor((l.value - r.lo) / ((r.hi - r.lo) / 40)) + 1, 40) END AS INTEGER) AS bin
      FROM long l JOIN r USING (feature) WHERE l.value IS NOT NULL),
c AS (SELECT feature, bin, count(*) AS cnt FROM b GROUP BY feature, bin),
g AS (SELECT r.*, CAST(unnest(range(1, 41)) AS INTEGER) AS bin FROM r)
SELECT g.feature, g.bin,
       g.lo + (g.bin - 1) * CASE WHEN g.hi = g.lo THEN 1e0 ELSE (g.hi - g.lo) / 40 END AS bin_lo,
       g.lo + g.bin * CASE WHEN g.hi = g.lo THEN 1e0 ELSE (g.hi - g.lo) / 40 END AS bin_hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       coalesce(c.cnt, 0) / (g.n * CASE WHEN g.hi = g.lo THEN 1e0 ELSE (g.hi - g.lo) / 40 END) AS density
FROM g LEFT JOIN c USING (feature, bin)""")
def q_histogram(spark, sf_dir):
    """40 equal-width bins per feature with counts and density."""
    h = S.histogram(cleaned_listings(spark, sf_dir), HIST_COLS)
    # edges and density use the same few operations in every engine: no rounding needed
    return h.select("feature", "bin", "bin_lo", "bin_hi", "count", "density")


@query("box_stats", sql=with_cleaned() + """
, q AS (SELECT rooms, quantile_cont(price_per_m2, 0.25) AS q1, quantile_cont(price_per_m2, 0.5) AS median,
               quantile_cont(price_per_m2, 0.75) AS q3 FROM cleaned GROUP BY rooms),
j AS (SELECT c.rooms, c.price_per_m2 AS v, q.q1, q.median, q.q3,
             c.price_per_m2 BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM cleaned c JOIN q ON c.rooms IS NOT DISTINCT FROM q.rooms)
SELECT rooms, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(v) FILTER (WHERE inside), 4) AS whisker_lo,
       round(max(v) FILTER (WHERE inside), 4) AS whisker_hi,
       CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM j GROUP BY rooms, q1, median, q3""")
def q_box_stats(spark, sf_dir):
    """box-plot statistics of price per m2 by rooms."""
    b = S.box_stats(cleaned_listings(spark, sf_dir), "price_per_m2", ["rooms"])
    return b.select("rooms", *[rnd(c, 4).alias(c) for c in
                               ["q1", "median", "q3", "whisker_lo", "whisker_hi"]], "outliers")


@query("dataset_shape", sql=oracle_with("listings") + """
SELECT * FROM (
 SELECT 'input' AS step, count(*) AS rows FROM listings UNION ALL
 SELECT 'critical', count(*) FROM listings WHERE price IS NOT NULL AND area_total IS NOT NULL
   AND latitude IS NOT NULL AND longitude IS NOT NULL UNION ALL
 SELECT 'price_range', count(*) FROM listings WHERE price IS NOT NULL AND area_total IS NOT NULL
   AND latitude IS NOT NULL AND longitude IS NOT NULL AND price BETWEEN 3000000 AND 300000000
   UNION ALL
 SELECT 'floors', count(*) FROM listings WHERE price IS NOT NULL AND area_total IS NOT NULL
   AND latitude IS NOT NULL AND longitude IS NOT NULL AND price BETWEEN 3000000 AND 300000000
   AND floor BETWEEN 1 AND 100 AND floors_total BETWEEN 1 AND 100 AND floor <= floors_total)""")
def q_dataset_shape(spark, sf_dir):
    """rows after each step, one pass instead of one count per step."""
    c = F.col
    return S.dataset_shape(X.listings(spark, sf_dir), {
        "critical": c("price").isNotNull() & c("area_total").isNotNull()
        & c("latitude").isNotNull() & c("longitude").isNotNull(),
        "price_range": c("price").between(3_000_000, 300_000_000),
        "floors": c("floor").between(1, 100) & c("floors_total").between(1, 100)
        & (c("floor") <= c("floors_total")),
    })


@query("map_center", sql=with_cleaned() + """
SELECT round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon FROM cleaned""")
def q_map_center(spark, sf_dir):
    """mean latitude / longitude of the cleaned set."""
    return cleaned_listings(spark, sf_dir).agg(rnd(F.avg("latitude")).alias("center_lat"),
                                               rnd(F.avg("longitude")).alias("center_lon"))


@query("outlier_checks", sql=oracle_with("listings") + """
SELECT * FROM (
 SELECT 'floor_gt_total' AS rule, CAST(count(*) FILTER (WHERE floor > floors_total) AS BIGINT) AS count FROM listings UNION ALL
 SELECT 'price_gt_200m', count(*) FILTER (WHERE price > 200000000) FROM listings UNION ALL
 SELECT 'area_out_10_250', count(*) FILTER (WHERE area_total < 10 OR area_total > 250) FROM listings UNION ALL
 SELECT 'ceiling_out_2_5', count(*) FILTER (WHERE ceiling_height < 2 OR ceiling_height > 5) FROM listings)""")
def q_outlier_checks(spark, sf_dir):
    """(rule, count) table in one aggregate."""
    return D.outlier_checks(X.listings(spark, sf_dir))


@query("dup_counts", sql=oracle_with("listings") + """
, l AS (SELECT * EXCLUDE (listing_id) FROM listings)
SELECT (SELECT count(*) FROM l) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS full_duplicates,
       (SELECT count(*) FROM l) - (SELECT count(DISTINCT link) + max(CASE WHEN link IS NULL THEN 1 ELSE 0 END) FROM l) AS key_duplicates,
       (SELECT count(DISTINCT link) + max(CASE WHEN link IS NULL THEN 1 ELSE 0 END) FROM l) AS distinct_keys""")
def q_dup_counts(spark, sf_dir):
    """Fully duplicated rows (without the id), duplicates by link, distinct links."""
    return D.dup_counts(X.listings(spark, sf_dir).drop("listing_id"), "link")


@query("quantile_trim", sql=with_cleaned() + """
, q AS (SELECT quantile_cont(price, 0.99) AS qp, quantile_cont(area_total, 0.99) AS qa FROM cleaned)
SELECT listing_id, price, area_total FROM cleaned, q WHERE price <= qp AND area_total <= qa""")
def q_quantile_trim(spark, sf_dir):
    """Keep rows at or below the exact 99th percentile of price and area."""
    c = cleaned_listings(spark, sf_dir).select("listing_id", "price", "area_total")
    return D.quantile_trim(c, ["price", "area_total"], 0.99)


# ------------------------------------------------------------------ crawl log windows
@query("zero_streak_stop", sql=oracle_with("crawl_log") + """
, f AS (SELECT grp, link, min(page) AS p FROM (SELECT grp, link, page, pos,
          row_number() OVER (PARTITION BY grp, link ORDER BY page, pos) AS rn FROM crawl_log) WHERE rn = 1 GROUP BY grp, link),
pg AS (SELECT DISTINCT grp, page FROM crawl_log),
nc AS (SELECT pg.grp, pg.page, CAST(count(f.link) AS BIGINT) AS new_count FROM pg
       LEFT JOIN f ON f.grp = pg.grp AND f.p = pg.page GROUP BY pg.grp, pg.page),
st AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY page) AS r,
              max(CASE WHEN new_count > 0 THEN row_number_ END) OVER (PARTITION BY grp ORDER BY page
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lnz
       FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY page) AS row_number_ FROM nc)),
z AS (SELECT grp, page, new_count, CAST(r - coalesce(lnz, 0) AS BIGINT) AS zero_streak FROM st),
sp AS (SELECT grp, min(page) FILTER (WHERE zero_streak >= 6) AS stop_page FROM z GROUP BY grp)
SELECT z.grp, z.page, z.new_count, z.zero_streak,
       (sp.stop_page IS NULL OR z.page <= sp.stop_page) AS read
FROM z JOIN sp USING (grp)""")
def q_zero_streak_stop(spark, sf_dir):
    """Stop a group after 6 consecutive pages without new links."""
    return C.zero_streak_stop(X.crawl_log(spark, sf_dir))


@query("first_seen", sql=oracle_with("crawl_log") + """
, f AS (SELECT grp, link, page, pos FROM crawl_log
        QUALIFY row_number() OVER (PARTITION BY grp, link ORDER BY page, pos) = 1),
pg AS (SELECT DISTINCT grp, page FROM crawl_log),
nc AS (SELECT pg.grp, pg.page, count(f.link) AS new_count FROM pg LEFT JOIN f
       ON f.grp = pg.grp AND f.page = pg.page GROUP BY pg.grp, pg.page),
z AS (SELECT grp, page, row_number() OVER w - coalesce(max(CASE WHEN new_count > 0 THEN rn END)
        OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak
      FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY page) AS rn FROM nc)
      WINDOW w AS (PARTITION BY grp ORDER BY page)),
sp AS (SELECT grp, min(page) FILTER (WHERE streak >= 6) AS stop_page FROM z GROUP BY grp),
kept AS (SELECT f.* FROM f JOIN sp USING (grp) WHERE sp.stop_page IS NULL OR f.page <= sp.stop_page)
SELECT grp AS source_group, link, page, pos FROM kept
QUALIFY row_number() OVER (PARTITION BY link ORDER BY grp, page, pos) = 1""")
def q_first_seen(spark, sf_dir):
    """G1: per-group first sighting on read pages, then global first group per link."""
    return C.first_seen(X.crawl_log(spark, sf_dir))


@query("unprocessed_links", sql=oracle_with("crawl_log", "listings") + """
SELECT DISTINCT 'https://example.org/realty/' || CAST(link AS VARCHAR) || '/' AS link FROM crawl_log
EXCEPT SELECT link FROM listings""")
def q_unprocessed_links(spark, sf_dir):
    """E6 + I3: crawl links (as URLs) not yet present in the listings table."""
    links = X.crawl_log(spark, sf_dir).select(F.concat(
        F.lit("https://example.org/realty/"), F.col("link").cast("string"), F.lit("/")).alias("link"))
    return C.unprocessed_links(links.distinct(), X.listings(spark, sf_dir))


@query("distinct_links", sql=oracle_with("listings") + "SELECT DISTINCT link FROM listings")
def q_distinct_links(spark, sf_dir):
    """Distinct links already stored."""
    from ..sources.dims import known_links
    return known_links(X.listings(spark, sf_dir))


@query("sorted_keys", sql=with_cleaned() + """
SELECT DISTINCT geo_generation_cluster FROM clustered_clean
WHERE geo_generation_cluster IS NOT NULL ORDER BY 1""")
def q_sorted_keys(spark, sf_dir):
    """H3: distinct cluster ids, ascending."""
    return (clustered_clean(spark, sf_dir).select("geo_generation_cluster").na.drop()
            .distinct().orderBy("geo_generation_cluster"))


@query("page_urls", sql=oracle_with() + """
g AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS source_group, url FROM pages
      QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1)
                                 ORDER BY page_id DESC) = 1)
SELECT source_group, url, CAST(p AS INTEGER) AS page,
       CASE WHEN p = 1 THEN url WHEN contains(url, '?') THEN url || '&page=' || CAST(p AS VARCHAR)
            ELSE url || '?page=' || CAST(p AS VARCHAR) END AS page_url
FROM g, range(1, 4) t(p)""")
def q_page_urls(spark, sf_dir):
    """A4 + C36: search groups from the pages table (host = group, last URL wins), then
    the first 3 list-page URLs per group."""
    from ..sources.dims import search_groups
    from ..sources.tables import read_table
    p = read_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source_group"), "url", "page_id")
    g = search_groups(p, "page_id")
    return C.page_urls(g, 3).select("source_group", "url", "page", "page_url")


# ------------------------------------------------------------------ sorts / samples / sets
@query("sample_n", sql=with_cleaned() + """
SELECT listing_id, price FROM cleaned
ORDER BY md5(concat_ws('|', listing_id, '42')), listing_id LIMIT 1000""")
def q_sample_n(spark, sf_dir):
    """H4: exactly min(n, rows) rows, reproducible (seeded hash order, not rand())."""
    c = cleaned_listings(spark, sf_dir)
    return (c.orderBy(F.md5(F.concat_ws("|", "listing_id", F.lit("42"))), "listing_id")
            .limit(1000).select("listing_id", "price"))


@query("preview")
def q_preview(spark, sf_dir):
    """H5: first rows (no order guarantee, rows-only check)."""
    return X.listings(spark, sf_dir).limit(5)


@query("top_k_counts", sql=oracle_with("listings") + """
SELECT source_group, renovation, count(*) AS count FROM listings
GROUP BY source_group, renovation ORDER BY count DESC, source_group, renovation NULLS FIRST LIMIT 10""")
def q_top_k_counts(spark, sf_dir):
    """H2: top 10 of a two-key frequency table."""
    return (X.listings(spark, sf_dir).groupBy("source_group", "renovation")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "source_group", F.col("renovation").asc_nulls_first())
            .limit(10))


@query("union_by_name", sql=oracle_with("listings") + """
SELECT listing_id, price, NULL::INTEGER AS is_synthetic FROM listings
UNION ALL SELECT listing_id, NULL::DOUBLE AS price, 1 AS is_synthetic FROM listings""")
def q_union_by_name(spark, sf_dir):
    """Stack two frames with different columns; missing -> NULL."""
    l = X.listings(spark, sf_dir)
    a = l.select("listing_id", "price")
    b = l.select("listing_id", F.lit(1).alias("is_synthetic"))
    return a.unionByName(b, allowMissingColumns=True)


@query("bins_outer", sql=with_cleaned() + """
, bins AS (SELECT * FROM (VALUES ('0-10M', 1), ('10-20M', 2), ('20-40M', 3), ('40-100M', 4),
                                ('100M+', 5)) t(price_bin, ord)),
b AS (SELECT CASE WHEN price > 0 AND price <= 10000000 THEN '0-10M'
                  WHEN price > 10000000 AND price <= 20000000 THEN '10-20M'
                  WHEN price > 20000000 AND price <= 40000000 THEN '20-40M'
                  WHEN price > 40000000 AND price <= 100000000 THEN '40-100M'
                  WHEN price > 100000000 AND price <= 500000000 THEN '100M+' END AS price_bin,
             price_per_m2 FROM cleaned)
SELECT bins.price_bin, CAST(count(b.price_bin) AS BIGINT) AS count,
       round(avg(b.price_per_m2), 4) AS mean_price_per_m2
FROM bins LEFT JOIN b USING (price_bin) GROUP BY bins.price_bin""")
def q_bins_outer(spark, sf_dir):
    """C26 + E13: right-closed price bins; every bin is listed, empty ones with count 0."""
    c = cleaned_listings(spark, sf_dir).select(bin_cut("price").alias("price_bin"), "price_per_m2")
    agg = c.groupBy("price_bin").agg(F.count(F.lit(1)).alias("n"),
                                     F.avg("price_per_m2").alias("m"))
    bins = c.sparkSession.createDataFrame([(b,) for b in PRICE_BIN_LABELS], "price_bin string")
    return (F.broadcast(bins).join(agg, "price_bin", "left")
            .select("price_bin", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"),
                    rnd("m", 4).alias("mean_price_per_m2")))


@query("row_index", sql=with_cleaned() + """
SELECT geo_generation_cluster, listing_id,
       row_number() OVER (PARTITION BY geo_generation_cluster ORDER BY listing_id) - 1 AS row_idx
FROM clustered_clean""")
def q_row_index(spark, sf_dir):
    """0-based position inside the cluster (distributed cumulative count)."""
    c = clustered_clean(spark, sf_dir).select("geo_generation_cluster", "listing_id")
    return S.row_index(c, ["geo_generation_cluster"], "listing_id").select(
        "geo_generation_cluster", "listing_id", "row_idx")


@query("ecdf_cumsum", sql=oracle_with("listings") + """
, v AS (SELECT source_group, price, count(*) AS n FROM listings GROUP BY source_group, price)
SELECT source_group, price, n,
       CAST(sum(n) OVER (PARTITION BY source_group ORDER BY price) AS BIGINT) AS cum_n,
       round(sum(n) OVER (PARTITION BY source_group ORDER BY price) / sum(n) OVER (PARTITION BY source_group), 9) AS ecdf
FROM v""")
def q_ecdf_cumsum(spark, sf_dir):
    """Per group ECDF over distinct values (range-partitioned prefix sums)."""
    e = S.ecdf(X.listings(spark, sf_dir), ["source_group"], "price")
    return e.select("source_group", "price", "n", "cum_n", rnd("ecdf", 9).alias("ecdf"))


@query("cluster_stats_back", sql=with_cleaned() + """
, s AS (SELECT geo_generation_cluster, min(latitude) AS lat_min, max(latitude) AS lat_max,
               stddev_samp(area_total) AS area_std,
               quantile_cont(price_per_m2, 0.01) AS ppm2_q01, quantile_cont(price_per_m2, 0.99) AS ppm2_q99
        FROM clustered_clean GROUP BY geo_generation_cluster)
SELECT c.listing_id, c.geo_generation_cluster, s.lat_min, s.lat_max,
       """ + sig_sql("s.area_std") + """ AS area_std, round(s.ppm2_q01, 4) AS ppm2_q01,
       round(s.ppm2_q99, 4) AS ppm2_q99
FROM clustered_clean c JOIN s USING (geo_generation_cluster)""")
def q_cluster_stats_back(spark, sf_dir):
    """Cluster min/max/std/quantiles attached back to every row."""
    c = clustered_clean(spark, sf_dir)
    st = c.groupBy("geo_generation_cluster").agg(
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.stddev_samp("area_total").alias("area_std"))
    q = exact_quantiles(c, ["geo_generation_cluster"], "price_per_m2",
                        {"ppm2_q01": 0.01, "ppm2_q99": 0.99})
    s = st.join(q, "geo_generation_cluster", "left")
    return c.select("listing_id", "geo_generation_cluster").join(s, "geo_generation_cluster") \
        .select("listing_id", "geo_generation_cluster", "lat_min", "lat_max",
                sig("area_std").alias("area_std"), rnd("ppm2_q01", 4).alias("ppm2_q01"),
                rnd("ppm2_q99", 4).alias("ppm2_q99"))


_ = (numeric_columns, PRICE_BINS)
