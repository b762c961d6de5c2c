"""Registered queries keyed by the remaining operator ids: focused projections of the
composite queries (each with its own oracle), plus JSON tags, rooms from free text and
the nearest station of synthetic rows (the reference's tree index, E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.numeric import house_age, rint_dp
from ..operators import extract as E
from ..operators import synth as J
from ..operators.spatial import nearest_one
from ..sources import fixtures as X
from ..sources.dims import search_groups, stations_dim
from ..sources.fixtures import K_EXPR, LISTING_EXPRS, _cte, oracle_with
from ..sources.tables import read_table
from .catalog import ORACLES, QUERIES, query


def _project(name: str, base: str, cols: list[str], doc: str) -> None:
    def fn(spark, sf_dir):
        return QUERIES[base](spark, sf_dir).select(*cols)
    fn.__doc__ = doc
    sql = f"SELECT {', '.join(cols)} FROM ({ORACLES[base]})" if base in ORACLES else None
    query(name, sql=sql)(fn)


def _alias(name: str, base: str, doc: str) -> None:
    def fn(spark, sf_dir):
        return QUERIES[base](spark, sf_dir)
    fn.__doc__ = doc
    query(name, sql=ORACLES.get(base))(fn)


def register() -> None:
    _alias("write_geojson", "read_ring_geojson", "A10 (then A9): ring written as GeoJSON and read back.")
    _alias("known_links", "distinct_links", "A11: distinct stored links.")
    _alias("way_nodes_join", "polylines_from_osm", "E7: ordered node lookup per way, inner.")
    _alias("whitelist_semi", "clean_metro_whitelist", "E8: candidate n-gram in the station set.")
    _alias("links_minus_done", "unprocessed_links", "I3: links minus processed links.")
    _project("house_age", "ratios", ["listing_id", "house_age"], "C19: as-of year minus build year.")
    _project("walk_minutes", "center_distance", ["listing_id", "walk_min"],
             "C30: round-half-even of 12 x unrounded km.")
    _project("synth_continuous", "synth_interpolate",
             ["listing_id", "area_total", "kitchen_area", "ceiling_height"],
             "J3: lambda-mix + N(0, 3 % cluster std) of the continuous columns.")
    _project("synth_integer", "synth_interpolate",
             ["listing_id", "rooms", "floor", "floors_total", "build_year"],
             "J4: lambda-mix rounded half-even (then clamped).")
    _project("synth_category", "synth_interpolate",
             ["listing_id", "source_group", "walls", "renovation"],
             "J5: one coin per row picks parent a or b for every category.")
    _project("synth_price", "synth_interpolate", ["listing_id", "price", "price_per_m2"],
             "J6: price via clipped price per m2, recomputed after the area clamp.")
    _project("price", "price_coords", ["listing_id", "price"], "L3: price from page text.")
    _project("coords", "price_coords", ["listing_id", "latitude", "longitude"],
             "L4: first in-range coordinate pair in the HTML.")
    _project("labelled_fields", "card_rows", ["listing_id", "area_total", "walls", "renovation",
                                              "kitchen_area", "build_year"],
             "L6: labelled values of the characteristics block.")
    _project("floor_pair", "card_rows", ["listing_id", "floor", "floors_total"], "L7: 'N из M'.")
    _project("address_line", "card_rows", ["listing_id", "address"], "L9: address line.")
    _project("metro_line", "card_rows", ["listing_id", "metro", "metro_walk_min"],
             "L10: station and minutes after 'На карте'.")
    _project("argmin_candidates", "card_rows", ["listing_id", "metro_walk_min"],
             "F24: the candidate with the fewest minutes.")
    _project("metro_from_blocks", "card_fields_old", ["listing_id", "metro", "metro_walk_min"],
             "L11: old metro extraction from short blocks.")
    _project("area_old", "card_fields_old", ["listing_id", "area_total", "kitchen_area", "walls"],
             "L12: old area / kitchen / walls extractors (last label wins).")


register()

LID = dict(LISTING_EXPRS)["listing_id"]
_LI = f"(SELECT *, {K_EXPR} AS k FROM lineitem)"


@query("search_groups", sql="""
SELECT source_group, url FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS source_group, url,
  row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id DESC) AS rn
  FROM pages) WHERE rn = 1""")
def q_search_groups(spark, sf_dir):
    """A4: required columns, NULLs dropped, trimmed, one URL per group (last wins)."""
    p = read_table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source_group"), "url", "page_id")
    return search_groups(p, "page_id")


@query("json_tags", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing FROM events""")
def q_json_tags(spark, sf_dir):
    """A key read from a JSON / map column; absent key -> NULL."""
    ev = read_table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return ev.select("event_id", m["k"].cast("bigint").alias("k"), m["missing"].alias("missing"))


@query("char_block", sql=f"""
SELECT {LID} AS listing_id, 6 AS block_lines, 'Общая площадь' AS first_line,
  coalesce(CASE k % 6 WHEN 0 THEN 'Монолитный' WHEN 1 THEN 'Кирпично-монолитный' WHEN 2 THEN 'Кирпичный'
           WHEN 3 THEN 'Панельный' WHEN 4 THEN 'деревянный' END, '—') AS last_line FROM {_LI}""")
def q_char_block(spark, sf_dir):
    """Lines after the last 'Характеристики' up to the 'История цены' stop word."""
    b = E.with_block(X.cards(spark, sf_dir)).select("listing_id", F.col("_block").alias("b"))
    return b.select("listing_id", F.size("b").alias("block_lines"),
                    F.try_element_at("b", F.lit(1)).alias("first_line"),
                    F.try_element_at("b", F.lit(-1)).alias("last_line"))


@query("label_value_lookup", sql=f"""
SELECT {LID} AS listing_id,
  CAST(coalesce(CASE WHEN k % 17 = 0 THEN NULL ELSE 1 + k % 31 END, 0) AS VARCHAR) || ' из ' ||
  CAST(coalesce(CASE WHEN k % 19 = 0 THEN NULL ELSE 1 + k % 37 END, 0) AS VARCHAR) AS floor_info,
  CAST(NULL AS VARCHAR) AS rooms_value FROM {_LI}""")
def q_label_value_lookup(spark, sf_dir):
    """Value after the first matching label (absent label -> NULL)."""
    c = E.with_block(X.cards(spark, sf_dir))
    value = lambda *labels: E.value_after_label(F.col("_block"), list(labels), F.col("_block_low"))
    return c.select("listing_id", value("Этаж/Этажность").alias("floor_info"), value("Комнатность").alias("rooms_value"))


_ROOMS_TEXT = ("CASE k % 4 WHEN 0 THEN concat(cast(k % 5 + 1 as string), '-комн. квартира') "
               "WHEN 1 THEN concat(cast(k % 5 + 1 as string), 'к, 40 м²') "
               "WHEN 2 THEN 'Студия у парка' ELSE 'Квартира' END")


@query("rooms", sql=f"""
SELECT {LID} AS listing_id, CAST(CASE k % 4 WHEN 0 THEN k % 5 + 1 WHEN 1 THEN k % 5 + 1
  WHEN 2 THEN 0 END AS INTEGER) AS rooms FROM {_LI}""")
def q_rooms(spark, sf_dir):
    """Rooms from 'N-комн', 'Nк,' or a studio; NULL otherwise."""
    li = read_table(spark, sf_dir, "lineitem").withColumn("k", F.expr(K_EXPR))
    return li.select(F.expr(LID).alias("listing_id"),
                     E.rooms_from(F.lit(None).cast("string"), F.expr(_ROOMS_TEXT)).alias("rooms"))


def _synth_station_sql() -> str:
    from .q_synth import SYNTH_SQL
    hav = G.haversine_sql("s.latitude", "s.longitude", "t.lat", "t.lon")
    return SYNTH_SQL + ", " + _cte("stations") + f"""
, d AS (SELECT s.listing_id, t.metro, t.station_ord, {hav} AS km FROM synthetic s, stations t
        WHERE t.city_id = 1 AND s.latitude IS NOT NULL AND s.longitude IS NOT NULL)
SELECT listing_id, metro, round_even(km, 2) AS metro_distance_km FROM d
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY km, station_ord) = 1"""


@query("nearest_balltree", sql=_synth_station_sql())
def q_nearest_balltree(spark, sf_dir):
    """Nearest station of every synthetic row with coordinates (the reference uses a
    tree index; here the same join operator as E1)."""
    from .q_spatial import stations_raw
    from .q_synth import train
    syn = J.synth_interpolate(train(spark, sf_dir)).na.drop(subset=["latitude", "longitude"])
    st = stations_dim(stations_raw(spark, sf_dir), extra=["station_ord"])
    nn = nearest_one(syn.select("listing_id", "latitude", "longitude"), st, out="_st",
                     dim_ord="station_ord", dim_name="metro")
    return nn.select("listing_id", F.col("_st")["name"].alias("metro"),
                     rint_dp(F.col("_st")["dist"], 2).alias("metro_distance_km"))


def _mark_original_sql() -> str:
    from .q_synth import _PREP
    return _PREP + """
SELECT listing_id, geo_generation_cluster, 0 AS is_synthetic, 'original' AS generation_method,
       geo_generation_cluster AS parent_geo_cluster FROM train"""


def q_mark_original(spark, sf_dir):
    """Original training rows tagged (is_synthetic 0, method, parent cluster)."""
    from .q_synth import train
    return J.mark_original(train(spark, sf_dir)).select(
        "listing_id", "geo_generation_cluster", "is_synthetic", "generation_method",
        "parent_geo_cluster")


query("mark_original", sql=_mark_original_sql())(q_mark_original)
