"""Listing-shaped views derived from the driver's TPC-H-like tables.

The same SQL expression text is used by Spark (``selectExpr``) and by the DuckDB
oracle (``oracle_cte``), so both engines see identical inputs. Only ``+ * % /
case concat replace cast`` and ``e``-literals appear, which both engines evaluate
the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import cumulative_counts
from .tables import read_table

# The derivation of the fixture columns (FIXTURES.md §3).
K_EXPR = "l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863"

LISTING_EXPRS: list[tuple[str, str]] = [
    ("listing_id", "concat(cast(l_orderkey as string),'-',cast(l_partkey as string),'-',"
                   "cast(l_suppkey as string),'-',cast(l_linenumber as string),'-',"
                   "cast(cast(l_shipdate as date) as string))"),
    ("source_group", "l_returnflag"),
    ("price", "l_extendedprice*1000e0"),
    ("area_total", "l_quantity*3e0"),
    ("rooms", "case when k % 11 = 0 then null else k % 6 end"),
    ("floor", "case when k % 17 = 0 then null else 1 + k % 31 end"),
    ("floors_total", "case when k % 19 = 0 then null else 1 + k % 37 end"),
    ("latitude", "55.55e0 + (k % 4001)/1e4"),
    ("longitude", "37.35e0 + (k % 5003)/1e4"),
    ("build_year", "case when k % 13 = 0 then null else 1780 + k % 263 end"),
    ("ceiling_height", "case when k % 7 = 0 then null else 2e0 + (k % 53)/1e1 end"),
    ("kitchen_area", "case when k % 5 = 0 then null else l_quantity*0.6e0 end"),
    ("walls", "case k % 6 when 0 then 'Монолитный' when 1 then 'Кирпично-монолитный' "
              "when 2 then 'Кирпичный' when 3 then 'Панельный' when 4 then 'деревянный' "
              "else null end"),
    ("renovation", "case k % 8 when 0 then 'Евроремонт' when 1 then 'Косметический' "
                   "when 2 then 'Без ремонта' when 3 then 'Дизайнерский' "
                   "when 4 then 'Черновая отделка' when 5 then ' ' when 6 then 'Прочее' "
                   "else null end"),
    ("parking", "case k % 5 when 0 then 'Подземная, Наземная' when 1 then 'наземная ,подземная' "
                "when 2 then 'Открытая во дворе' when 3 then '' else null end"),
    ("elevator", "case k % 4 when 0 then 'Пассажирский, Грузовой' "
                 "when 1 then 'Грузовой,Пассажирский' when 2 then 'Нет' else null end"),
    ("price_raw", "concat(replace(cast(l_extendedprice as string),'.',','),' ')"),
    ("link", "concat('https://example.org/realty/', cast(k % 9973 as string), '/')"),
]

# The model table also needs walking minutes, some of them missing or out of range.
MODEL_EXTRA = ("metro_walk_min", "case when k % 23 = 0 then null else k % 97 end")

STATION_EXPRS: list[tuple[str, str]] = [
    ("metro", "concat('st_', cast(n_nationkey as string))"),
    ("lat", "55.55e0+((n_nationkey*379) % 401)/1e3"),
    ("lon", "37.35e0+((n_nationkey*211) % 503)/1e3"),
    ("city_id", "case when n_nationkey % 9 = 8 then 2 else 1 end"),
    ("station_ord", "n_nationkey"),
]

POI_EXPRS: list[tuple[str, str]] = [
    ("poi_id", "s_suppkey"),
    ("poi_type", "case s_suppkey % 5 when 0 then 'school' when 1 then 'kindergarten' "
                 "when 2 then 'clinic' when 3 then 'mall' else 'other' end"),
    ("name", "s_name"),
    ("latitude", "55.55e0+((s_suppkey*7919) % 4001)/1e4"),
    ("longitude", "37.35e0+((s_suppkey*104729) % 5003)/1e4"),
]

RING_EXPRS: list[tuple[str, str]] = [
    ("vertex", "n_nationkey"),
    ("lat", "round(55.75e0+0.16e0*cos(2e0*pi()*n_nationkey/24e0),6)"),
    ("lon", "round(37.62e0+0.28e0*sin(2e0*pi()*n_nationkey/24e0),6)"),
]

CLUSTER_EXPR = ("cast(floor((latitude-55.55e0)*12.5e0) as int)*5 + "
                "cast(floor((longitude-37.35e0)*10e0) as int)")

CARD_TEXT_EXPR = (
    "concat('Москва, ул. Тестовая, ', cast(k % 100 as string), chr(10), 'На карте', chr(10), "
    "'Станция', chr(10), cast(1 + k % 40 as string), ' мин. (1 км)', chr(10), "
    "'Характеристики', chr(10), 'Общая площадь', chr(10), "
    "replace(cast(l_quantity*3e0 as string),'.',','), ' м²', chr(10), 'Этаж/Этажность', chr(10), "
    "cast(coalesce(case when k % 17 = 0 then null else 1 + k % 31 end, 0) as string), ' из ', "
    "cast(coalesce(case when k % 19 = 0 then null else 1 + k % 37 end, 0) as string), chr(10), "
    "'Стены', chr(10), coalesce(case k % 6 when 0 then 'Монолитный' "
    "when 1 then 'Кирпично-монолитный' when 2 then 'Кирпичный' when 3 then 'Панельный' "
    "when 4 then 'деревянный' else null end,'—'), chr(10), 'История цены', chr(10), "
    "'Стены', chr(10), 'x')"
)

CRAWL_SQL = (
    "select event_type as grp, user_id as link, event_id, ts, "
    "cast(floor((row_number() over (partition by event_type order by ts, event_id) - 1)/10e0) "
    "as bigint) + 1 as page, "
    "row_number() over (partition by event_type order by ts, event_id) as pos from events"
)


def _k(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.expr(K_EXPR))


def listings(spark: SparkSession, sf_dir: str, with_cluster: bool = False) -> DataFrame:
    exprs = [f"{e} AS {c}" for c, e in LISTING_EXPRS]
    df = _k(read_table(spark, sf_dir, "lineitem")).selectExpr(*exprs)
    if with_cluster:
        df = df.withColumn("geo_generation_cluster", F.expr(CLUSTER_EXPR))
    return df


def model_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [f"{e} AS {c}" for c, e in [*LISTING_EXPRS, MODEL_EXTRA]]
    return _k(read_table(spark, sf_dir, "lineitem")).selectExpr(*exprs)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation").selectExpr(
        *[f"{e} AS {c}" for c, e in STATION_EXPRS])


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").selectExpr(
        *[f"{e} AS {c}" for c, e in POI_EXPRS])


def ring_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read_table(spark, sf_dir, "nation").filter("n_nationkey < 24")
            .selectExpr(*[f"{e} AS {c}" for c, e in RING_EXPRS]))


def ring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed ring as segments i -> (i+1) % 24, one feature (feature_id 0)."""
    v = ring_vertices(spark, sf_dir)
    a = v.select(F.col("vertex").alias("seg_id"), F.col("lon").alias("lon1"),
                 F.col("lat").alias("lat1"),
                 ((F.col("vertex") + 1) % 24).alias("nxt"))
    b = v.select(F.col("vertex").alias("nxt"), F.col("lon").alias("lon2"),
                 F.col("lat").alias("lat2"))
    return (a.join(b, "nxt").drop("nxt")
            .withColumn("feature_id", F.lit(0)))


def cards(spark: SparkSession, sf_dir: str, text: str = CARD_TEXT_EXPR) -> DataFrame:
    li = _k(read_table(spark, sf_dir, "lineitem"))
    return li.selectExpr(f"{dict(LISTING_EXPRS)['listing_id']} AS listing_id",
                         "l_returnflag AS source_group",
                         f"{dict(LISTING_EXPRS)['link']} AS link",
                         f"{text} AS text")


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    # positions per event type as chunked prefix sums: five types, so no window per type
    placed = cumulative_counts(ev.select("event_type", F.struct("ts", "event_id", "user_id").alias("o")),
                               ["event_type"], "o").withColumn("pos", F.col("cum_n"))
    return (placed
            .select(F.col("event_type").alias("grp"), F.col("o.user_id").alias("link"),
                    F.col("o.event_id").alias("event_id"), F.col("o.ts").alias("ts"),
                    (F.floor((F.col("pos") - 1) / F.lit(10.0)).cast("bigint") + 1).alias("page"),
                    "pos"))


# ---------------------------------------------------------------- oracle side
def _cte_listings() -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in LISTING_EXPRS)
    return (f"li_k AS (SELECT *, {K_EXPR} AS k FROM lineitem), "
            f"listings AS (SELECT {cols} FROM li_k)")


def _cte(name: str) -> str:
    if name == "listings":
        return _cte_listings()
    if name == "model_listings":
        cols = ", ".join(f"{e} AS {c}" for c, e in [*LISTING_EXPRS, MODEL_EXTRA])
        return f"model_listings AS (SELECT {cols} FROM (SELECT *, {K_EXPR} AS k FROM lineitem))"
    if name == "clustered":
        return f"clustered AS (SELECT *, {CLUSTER_EXPR} AS geo_generation_cluster FROM listings)"
    if name == "stations":
        cols = ", ".join(f"{e} AS {c}" for c, e in STATION_EXPRS)
        return f"stations AS (SELECT {cols} FROM nation)"
    if name == "poi":
        cols = ", ".join(f"{e} AS {c}" for c, e in POI_EXPRS)
        return f"poi AS (SELECT {cols} FROM supplier)"
    if name == "ring":
        cols = ", ".join(f"{e} AS {c}" for c, e in RING_EXPRS)
        return (f"ring AS (SELECT {cols} FROM nation WHERE n_nationkey < 24), "
                "ring_seg AS (SELECT a.vertex AS seg_id, a.lon AS lon1, a.lat AS lat1, "
                "b.lon AS lon2, b.lat AS lat2 FROM ring a JOIN ring b "
                "ON b.vertex = (a.vertex + 1) % 24)")
    if name == "cards":
        lid = dict(LISTING_EXPRS)["listing_id"]
        link = dict(LISTING_EXPRS)["link"]
        return (f"cards AS (SELECT {lid} AS listing_id, l_returnflag AS source_group, "
                f"{link} AS link, {CARD_TEXT_EXPR} AS text FROM "
                f"(SELECT *, {K_EXPR} AS k FROM lineitem))")
    if name == "crawl_log":
        return f"crawl_log AS ({CRAWL_SQL})"
    raise KeyError(name)


_DEPS = {"clustered": ["listings"]}


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views for a DuckDB oracle query."""
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    return "WITH " + ", ".join(_cte(n) for n in ordered) + " "
