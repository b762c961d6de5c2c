"""Registered queries: geodesy scalars, dimension sources, nearest-neighbour and polyline
joins, the enrichment stage and the flagship enriched cluster summary."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.numeric import rint_dp
from ..operators.spatial import nearest_one, nearest_per_category, point_to_polyline
from ..session import ensure_checkpoint_dir, stored
from ..sources import fixtures as X
from ..sources.dims import poi_dim, stations_dim
from ..sources.fixtures import CLUSTER_EXPR, oracle_with
from ..sources.osm import (poi_from_osm, polylines_from_osm, read_ring_geojson,
                           write_geojson)
from ..sources.tables import read_table
from .catalog import exact_avg, exact_avg_sql, query, rnd
from .clean import clean_listings
from .enrich import POI_OUT, POI_TYPES, enrich_listings
from .oracle_sql import (center_sql, clean_ctes, seg_dist_sql, utm37_sql,
                         webmercator_sql)
from .q_clean import cluster_summary

HAV_LS = G.haversine_sql("l.latitude", "l.longitude", "s.lat", "s.lon")
HAV_LP = G.haversine_sql("l.latitude", "l.longitude", "p.latitude", "p.longitude")


def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station source with its own column names (resolved by alias in A5)."""
    return X.stations(spark, sf_dir).withColumnRenamed("metro", "name")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by coordinates, from the listings that state their storeys."""
    l = X.listings(spark, sf_dir).where(F.col("floors_total").isNotNull())
    return l.select("latitude", "longitude", F.concat(
        F.lit("Москва, ул. Тестовая, "), F.col("floors_total").cast("string")).alias("address"))


GAZETTEER_SQL = """g AS (SELECT floor(latitude * 1000.0) AS glat, floor(longitude * 1000.0) AS glon,
       min('Москва, ул. Тестовая, ' || CAST(floors_total AS VARCHAR)) AS gaddr
     FROM listings WHERE floors_total IS NOT NULL GROUP BY 1, 2)"""


def geo_dims(spark: SparkSession, sf_dir: str) -> tuple[tuple, dict]:
    """Arguments of the enrichment."""
    return ((stations_raw(spark, sf_dir), poi_dim(X.poi(spark, sf_dir)), X.ring_segments(spark, sf_dir)),
            {"gazetteer": gazetteer(spark, sf_dir)})


def enriched(spark: SparkSession, sf_dir: str, nn_form: str | None = None) -> DataFrame:
    dims, kw = geo_dims(spark, sf_dir)
    return enrich_listings(X.listings(spark, sf_dir), *dims, nn_form=nn_form, **kw)


# ------------------------------------------------------------------ scalar geodesy
@query("haversine", sql=oracle_with("listings", "stations") + f"""
SELECT l.listing_id, s.metro, round({HAV_LS}, 6) AS km
FROM listings l JOIN stations s ON s.station_ord = l.rooms""")
def q_haversine(spark, sf_dir):
    """C28 over (listing, station) pairs chosen by an equi-join on rooms = station id."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude", "rooms")
    s = X.stations(spark, sf_dir)
    j = l.join(F.broadcast(s), l.rooms == s.station_ord)
    return j.select("listing_id", "metro",
                    rnd(G.haversine_km("latitude", "longitude", "lat", "lon")).alias("km"))


@query("center_distance", sql=oracle_with("listings") + f"""
SELECT listing_id, round_even({center_sql()}, 2) AS distance_to_center_km,
       CAST(round_even({center_sql()} * 12, 0) AS INTEGER) AS walk_min FROM listings""")
def q_center_distance(spark, sf_dir):
    """C29 + C30 + C34: centre distance (2 dp, half-even) and walking minutes."""
    km = G.center_distance_km("latitude", "longitude")
    return X.listings(spark, sf_dir).select(
        "listing_id", rint_dp(km, 2).alias("distance_to_center_km"),
        G.walk_minutes(km).alias("walk_min"))


@query("meters_to_degrees", sql=oracle_with("listings") + """
SELECT listing_id, round(area_total * 10 / 111000, 9) AS jitter_deg FROM listings""")
def q_meters_to_degrees(spark, sf_dir):
    """Metres -> degrees (area used as a metre amount)."""
    return X.listings(spark, sf_dir).select(
        "listing_id", rnd(G.meters_to_degrees(F.col("area_total") * 10), 9).alias("jitter_deg"))


_UX, _UY = utm37_sql("latitude", "longitude")
_WX, _WY = webmercator_sql("latitude", "longitude")


@query("project_utm37", sql=oracle_with("listings") + f"""
SELECT listing_id, round({_UX}, 3) AS utm_x, round({_UY}, 3) AS utm_y FROM listings""")
def q_project_utm37(spark, sf_dir):
    """WGS84 -> UTM 37N metres (rounded to mm)."""
    x, y = G.project_utm37("latitude", "longitude")
    return X.listings(spark, sf_dir).select("listing_id", rnd(x, 3).alias("utm_x"),
                                            rnd(y, 3).alias("utm_y"))


@query("project_webmercator", sql=oracle_with("listings") + f"""
SELECT listing_id, round({_WX}, 3) AS merc_x, round({_WY}, 3) AS merc_y FROM listings""")
def q_project_webmercator(spark, sf_dir):
    """WGS84 -> EPSG:3857 metres (rounded to mm)."""
    x, y = G.project_webmercator("latitude", "longitude")
    return X.listings(spark, sf_dir).select("listing_id", rnd(x, 3).alias("merc_x"),
                                            rnd(y, 3).alias("merc_y"))


# ------------------------------------------------------------------ dimensions
@query("stations_dim", sql=oracle_with("stations") + """
SELECT metro, lat, lon FROM stations WHERE city_id = 1 AND lat IS NOT NULL AND lon IS NOT NULL""")
def q_stations_dim(spark, sf_dir):
    """A5: alias-resolved station dimension, city 1 only."""
    return stations_dim(stations_raw(spark, sf_dir))


@query("poi_dim", sql=oracle_with("poi") + """
SELECT * FROM poi WHERE poi_type IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""")
def q_poi_dim(spark, sf_dir):
    """A7."""
    return poi_dim(X.poi(spark, sf_dir))


def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OSM-shaped elements derived from supplier (nodes with tags) and nation (ring nodes
    and one way per region, with one unknown node id to be skipped)."""
    s = read_table(spark, sf_dir, "supplier")
    lat = F.expr("55.55e0+((s_suppkey*7919) % 4001)/1e4")
    lon = F.expr("37.35e0+((s_suppkey*104729) % 5003)/1e4")
    own = F.col("s_suppkey") % 7 != 0
    m = F.col("s_suppkey") % 6
    tags = (F.when(m == 0, F.create_map(F.lit("amenity"), F.lit("school")))
            .when(m == 1, F.create_map(F.lit("amenity"), F.lit("kindergarten")))
            .when(m == 2, F.create_map(F.lit("healthcare"), F.lit("hospital")))
            .when(m == 3, F.create_map(F.lit("shop"), F.lit("mall")))
            .when(m == 4, F.create_map(F.lit("building"), F.lit("retail")))
            .otherwise(F.create_map(F.lit("amenity"), F.lit("bank"))))
    tags = F.map_concat(tags, F.create_map(F.lit("name"), F.col("s_name")))
    pois = s.select(F.lit("node").alias("type"), (F.col("s_suppkey") + 100000).alias("id"),
                    F.when(own, lat).alias("lat"), F.when(own, lon).alias("lon"),
                    F.struct(lat.alias("lat"), lon.alias("lon")).alias("center"),
                    tags.alias("tags"), F.lit(None).cast("array<bigint>").alias("nodes"))
    ring = X.ring_vertices(spark, sf_dir)
    nodes = ring.select(F.lit("node").alias("type"), F.col("vertex").cast("bigint").alias("id"),
                        "lat", "lon", F.lit(None).cast("struct<lat:double,lon:double>").alias("center"),
                        F.lit(None).cast("map<string,string>").alias("tags"),
                        F.lit(None).cast("array<bigint>").alias("nodes"))
    n = read_table(spark, sf_dir, "nation")
    ways = (n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(
        F.col("n_nationkey").cast("bigint"))).alias("nodes"))
        .select(F.lit("way").alias("type"), (F.col("n_regionkey") + 1000).cast("bigint").alias("id"),
                F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
                F.lit(None).cast("struct<lat:double,lon:double>").alias("center"),
                F.lit(None).cast("map<string,string>").alias("tags"),
                F.concat("nodes", F.array(F.lit(999).cast("bigint"))).alias("nodes")))
    return pois.unionByName(nodes).unionByName(ways)


@query("poi_from_osm", sql=oracle_with() .replace("WITH ", "WITH ") + """
e AS (SELECT s_suppkey + 100000 AS id, s_name AS name,
        CASE s_suppkey % 6 WHEN 0 THEN 'school' WHEN 1 THEN 'kindergarten'
             WHEN 2 THEN 'clinic' WHEN 3 THEN 'mall' WHEN 4 THEN 'mall' END AS poi_type,
        55.55e0+((s_suppkey*7919) % 4001)/1e4 AS latitude,
        37.35e0+((s_suppkey*104729) % 5003)/1e4 AS longitude FROM supplier)
SELECT poi_type, arg_min(name, id) AS name, latitude, longitude, min(id) AS osm_id
FROM e WHERE poi_type IS NOT NULL GROUP BY poi_type, latitude, longitude""")
def q_poi_from_osm(spark, sf_dir):
    """Classify and flatten OSM elements into the POI dimension."""
    return poi_from_osm(osm_elements(spark, sf_dir))


@query("polylines_from_osm", sql=oracle_with("ring") + """
, wn AS (SELECT n_regionkey + 1000 AS way_id, n_nationkey AS node_id FROM nation),
kn AS (SELECT way_id, r.lon, r.lat, node_id FROM wn JOIN ring r ON r.vertex = wn.node_id),
ok AS (SELECT way_id FROM kn GROUP BY way_id HAVING count(*) >= 2)
SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY node_id) - 1 AS INTEGER) AS pos,
       lon, lat FROM kn WHERE way_id IN (SELECT way_id FROM ok)""")
def q_polylines_from_osm(spark, sf_dir):
    """A8 + E7: ways assembled from node ids (unknown ids skipped), one row per vertex."""
    lines = polylines_from_osm(osm_elements(spark, sf_dir))
    return lines.select("way_id", F.posexplode("coords").alias("pos", "p")).select(
        "way_id", "pos", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


@query("read_ring_geojson", sql=oracle_with("ring") + """
SELECT seg_id, lon1, lat1, lon2, lat2 FROM ring_seg""")
def q_read_ring_geojson(spark, sf_dir):
    """A10 then A9: the ring (derived from nation) written as GeoJSON into the shared
    checkpoint folder and read back as segments."""
    v = X.ring_vertices(spark, sf_dir)
    closed = v.unionByName(v.where("vertex = 0").withColumn("vertex", F.lit(24)))
    line = closed.agg(F.array_sort(F.collect_list(F.struct("vertex", "lon", "lat"))).alias("c")) \
        .select(F.lit(0).alias("way_id"),
                F.transform("c", lambda p: F.struct(p["lon"].alias("lon"),
                                                    p["lat"].alias("lat"))).alias("coords"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"geojson-{uuid.uuid4().hex}")
    write_geojson(line, path)
    seg = read_ring_geojson(spark, path, seq=True)
    return seg.select(F.col("seg_id").cast("int").alias("seg_id"), "lon1", "lat1", "lon2", "lat2")


# ------------------------------------------------------------------ nearest neighbour
_E1_SQL = oracle_with("listings", "stations") + f"""
, st AS (SELECT * FROM stations WHERE city_id = 1),
d AS (SELECT l.listing_id, s.metro, s.station_ord, {HAV_LS} AS km FROM listings l, st s
      WHERE l.latitude IS NOT NULL AND l.longitude IS NOT NULL)
SELECT listing_id, metro, round_even(km, 2) AS metro_distance_km,
       CAST(round_even(km * 12, 0) AS INTEGER) AS metro_walk_min
FROM d QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY km, station_ord) = 1"""


def _nearest_station(spark, sf_dir, form):
    st = stations_dim(stations_raw(spark, sf_dir), extra=["station_ord"])
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    nn = nearest_one(l, st, out="_st", dim_ord="station_ord", dim_name="metro", force=form)
    return nn.select("listing_id", F.col("_st")["name"].alias("metro"),
                     rint_dp(F.col("_st")["dist"], 2).alias("metro_distance_km"),
                     G.walk_minutes(F.col("_st")["dist"]).alias("metro_walk_min"))


@query("nearest_one", sql=_E1_SQL)
def q_nearest_one(spark, sf_dir):
    """E1 (array form): nearest station, km (2 dp), walking minutes; ties -> file order."""
    return _nearest_station(spark, sf_dir, "array")


@query("nearest_one_grid", sql=_E1_SQL)
def q_nearest_one_grid(spark, sf_dir):
    """E1 (grid form for unbounded dimensions) - must equal the array form."""
    return _nearest_station(spark, sf_dir, "grid")


_E2_SQL = oracle_with("listings", "poi") + ", d AS (SELECT l.listing_id, p.poi_type, " + \
    HAV_LP + " AS km FROM listings l, poi p) SELECT listing_id, " + ", ".join(
        f"round_even(min(km) FILTER (WHERE poi_type = '{c}'), 2) AS {POI_OUT[c]}"
        for c in POI_TYPES) + " FROM d GROUP BY listing_id"


@query("nearest_per_category", sql=_E2_SQL)
def q_nearest_per_category(spark, sf_dir):
    """Km to the nearest school / kindergarten / clinic / mall (2 dp)."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = nearest_per_category(l, poi_dim(X.poi(spark, sf_dir)), "poi_type", POI_TYPES, POI_OUT)
    return out.select("listing_id", *[rint_dp(F.col(c), 2).alias(c) for c in POI_OUT.values()])


@query("nearest_per_category_grid", sql=_E2_SQL)
def q_nearest_per_category_grid(spark, sf_dir):
    """E2 / E3 through the grid form (index-like blocking instead of a tree)."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = nearest_per_category(l, poi_dim(X.poi(spark, sf_dir)), "poi_type", POI_TYPES,
                               POI_OUT, force="grid")
    return out.select("listing_id", *[rint_dp(F.col(c), 2).alias(c) for c in POI_OUT.values()])


def _ring_sql(proj) -> str:
    px, py = proj("l.latitude", "l.longitude")
    x1, y1 = proj("r.lat1", "r.lon1")
    x2, y2 = proj("r.lat2", "r.lon2")
    return (oracle_with("listings", "ring") +
            f", lp AS (SELECT listing_id, {px} AS px, {py} AS py FROM listings l), "
            f"rs AS (SELECT {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM ring_seg r) "
            f"SELECT listing_id, round_even(min({seg_dist_sql('px', 'py', 'x1', 'y1', 'x2', 'y2')})"
            f" / 1000, 2) AS distance_to_mkad_km FROM lp, rs GROUP BY listing_id")


@query("point_to_polyline", sql=_ring_sql(utm37_sql))
def q_point_to_polyline(spark, sf_dir):
    """Km to the ring road in UTM 37N (2 dp)."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = point_to_polyline(l, X.ring_segments(spark, sf_dir), "_d", crs="utm37")
    return out.select("listing_id", rint_dp(F.col("_d"), 2).alias("distance_to_mkad_km"))


@query("point_to_polyline_v0", sql=_ring_sql(webmercator_sql))
def q_point_to_polyline_v0(spark, sf_dir):
    """E5: the stage-2 variant - Web Mercator metres, first feature only."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = point_to_polyline(l, X.ring_segments(spark, sf_dir), "_d", crs="webmercator",
                            first_feature_only=True)
    return out.select("listing_id", rint_dp(F.col("_d"), 2).alias("distance_to_mkad_km"))


# Points and polylines that are hard for an index, derived from customer and part: one point far
# from all others, several points at one place, a category without points, and two lines of
# thousands of segments with a node at every customer or part.
_CUSTOMER_LAT = "case when c_custkey = 7 then -60e0 else 55.55e0+((c_custkey*7919) % 997)/25e2 end"
_CUSTOMER_LON = "case when c_custkey = 7 then 179.9e0 else 37.35e0+((c_custkey*7919) % 997)/2e3 end"
_CATEGORIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"]
_HARD_SQL = oracle_with("listings") + f"""
, c AS (SELECT c_mktsegment AS kind, c_custkey AS ord, {_CUSTOMER_LAT} AS lat, {_CUSTOMER_LON} AS lon FROM customer),
s AS (SELECT kind, lat, lon, min(ord) AS ord FROM c GROUP BY ALL),
d AS (SELECT l.listing_id, s.kind, s.ord, {HAV_LS} AS km FROM listings l, s)"""


def _hard_points(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment as kind", "c_custkey as ord", "cast(c_custkey as string) as name",
        f"{_CUSTOMER_LAT} as lat", f"{_CUSTOMER_LON} as lon")


@query("nearest_hard_points", sql=_HARD_SQL + """
SELECT listing_id, arg_min(ord, (round(km, 9), ord)) AS nearest, round(min(km), 6) AS km FROM d GROUP BY listing_id""")
def q_nearest_hard_points(spark, sf_dir):
    """E1 / E3 over all customers as points: one far away, several at one place."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    nn = nearest_one(l, _hard_points(spark, sf_dir), out="_n")
    return nn.select("listing_id", F.col("_n")["ord"].alias("nearest"), rnd(F.col("_n")["dist"]).alias("km"))


@query("nearest_hard_categories", sql=_HARD_SQL + " SELECT listing_id, " + ", ".join(
    f"round(min(km) FILTER (WHERE kind = '{c}'), 6) AS km_{c.lower()}" for c in _CATEGORIES) + " FROM d GROUP BY listing_id")
def q_nearest_hard_categories(spark, sf_dir):
    """E2 over the market segments of customers, and a category that has no points."""
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = nearest_per_category(l, _hard_points(spark, sf_dir), "kind", _CATEGORIES,
                               {c: f"km_{c.lower()}" for c in _CATEGORIES}, dim_lat="lat", dim_lon="lon", dim_ord="ord")
    return out.select("listing_id", *[rnd(f"km_{c.lower()}").alias(f"km_{c.lower()}") for c in _CATEGORIES])


def _node(key: str) -> tuple[str, str]:
    """A line that winds around the centre once in 1,500 nodes, ever farther out."""
    turn = f"2e0*pi()*{key}/15e2"
    far = f"(0.05e0+{key}/4e4)"
    return f"round(55.75e0+{far}*cos({turn}),6)", f"round(37.62e0+2e0*{far}*sin({turn}),6)"


_LINES = [("customer", "c_custkey", 0), ("part", "p_partkey", 1)]
_LONG_SQL = oracle_with("listings") + ", nodes AS (" + " UNION ALL ".join(
    f"SELECT {f} AS f, {k} AS k, {_node(k)[0]} AS lat, {_node(k)[1]} AS lon FROM {t}" for t, k, f in _LINES) + f"""),
r AS (SELECT a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM nodes a JOIN nodes b ON a.f = b.f AND b.k = a.k + 1),
lp AS (SELECT listing_id, {_UX} AS px, {_UY} AS py FROM listings),
rs AS (SELECT {utm37_sql("lat1", "lon1")[0]} AS x1, {utm37_sql("lat1", "lon1")[1]} AS y1,
              {utm37_sql("lat2", "lon2")[0]} AS x2, {utm37_sql("lat2", "lon2")[1]} AS y2 FROM r)
SELECT listing_id, round(min({seg_dist_sql('px', 'py', 'x1', 'y1', 'x2', 'y2')}) / 1000, 6) AS km FROM lp, rs GROUP BY listing_id"""


@query("point_to_long_polyline", sql=_LONG_SQL)
def q_point_to_long_polyline(spark, sf_dir):
    """E4 over two winding lines with a node at every customer and part."""
    parts = []
    for t, k, f in _LINES:
        lat, lon = _node(k)
        n = read_table(spark, sf_dir, t).selectExpr(f"{k} as k", f"{lat} as lat", f"{lon} as lon")
        b = n.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        parts.append(n.withColumnsRenamed({"lat": "lat1", "lon": "lon1"}).join(b, "k").withColumn("feature_id", F.lit(f)))
    l = X.listings(spark, sf_dir).select("listing_id", "latitude", "longitude")
    out = point_to_polyline(l, parts[0].unionByName(parts[1]), "_d", crs="utm37")
    return out.select("listing_id", rnd("_d").alias("km"))


# ------------------------------------------------------------------ enrichment stage
def geo_ctes(src: str) -> str:
    """CTE ``geo``: what the enrichment adds to the rows of ``src`` (with coordinates, ids unique)."""
    px, py = utm37_sql("l.latitude", "l.longitude")
    x1, y1 = utm37_sql("r.lat1", "r.lon1")
    x2, y2 = utm37_sql("r.lat2", "r.lon2")
    poi_cols = ", ".join(f"round_even(min({HAV_LP}) FILTER (WHERE p.poi_type = '{c}'), 2) "
                         f"AS {POI_OUT[c]}" for c in POI_TYPES)
    return f"""
geo_st AS (SELECT * FROM stations WHERE city_id = 1),
geo_nn AS (SELECT l.listing_id, s.metro, {HAV_LS} AS km FROM {src} l, geo_st s
       QUALIFY row_number() OVER (PARTITION BY l.listing_id ORDER BY km, s.station_ord) = 1),
geo_lp AS (SELECT listing_id, {px} AS px, {py} AS py FROM {src} l),
geo_rs AS (SELECT {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM ring_seg r),
geo_rd AS (SELECT listing_id, round_even(min({seg_dist_sql('px', 'py', 'x1', 'y1', 'x2', 'y2')}) / 1000, 2)
       AS distance_to_mkad_km FROM geo_lp, geo_rs GROUP BY listing_id),
geo_pd AS (SELECT l.listing_id, {poi_cols} FROM {src} l, poi p GROUP BY l.listing_id),
{GAZETTEER_SQL},
geo AS (
  SELECT l.listing_id, g.gaddr AS address, geo_nn.metro,
         CAST(round_even(geo_nn.km * 12, 0) AS INTEGER) AS metro_walk_min,
         'geo' AS address_source, 'geo_recomputed' AS metro_source,
         round_even(geo_nn.km, 2) AS metro_distance_km,
         round_even({center_sql('l.latitude', 'l.longitude')}, 2) AS distance_to_center_km,
         geo_rd.distance_to_mkad_km, {", ".join(f"geo_pd.{c}" for c in POI_OUT.values())}
  FROM {src} l JOIN geo_nn USING (listing_id) JOIN geo_rd USING (listing_id) JOIN geo_pd USING (listing_id)
       LEFT JOIN g ON g.glat = floor(l.latitude * 1000.0) AND g.glon = floor(l.longitude * 1000.0)
)"""


GEO_COLS = ["address", "metro", "metro_walk_min", "address_source", "metro_source", "metro_distance_km",
            "distance_to_center_km", "distance_to_mkad_km", *POI_OUT.values()]


def _enriched_sql_ctes() -> str:
    return (oracle_with("listings", "stations", "poi", "ring") + ", " + geo_ctes("listings").strip()
            + ", enriched AS (SELECT l.*, geo.* EXCLUDE (listing_id) FROM listings l JOIN geo USING (listing_id))")


@query("enriched_listings", sql=_enriched_sql_ctes() + " SELECT * FROM enriched")
def q_enriched_listings(spark, sf_dir):
    """Stage 2-4: listings + station, centre, ring and POI distances + provenance."""
    return enriched(spark, sf_dir)


@query("enriched_cluster_summary", sql=_enriched_sql_ctes() + ", " + clean_ctes(
    "enriched", enriched=True).strip() + f"""
, cc AS (SELECT *, {CLUSTER_EXPR} AS geo_generation_cluster FROM cleaned)
SELECT geo_generation_cluster, count(*) AS count,
       round({exact_avg_sql("latitude", 1e4)}, 6) AS mean_latitude,
       round({exact_avg_sql("longitude", 1e4)}, 6) AS mean_longitude,
       round(quantile_cont(price, 0.5), 6) AS median_price,
       round(quantile_cont(price_per_m2, 0.5), 6) AS median_price_per_m2,
       round({exact_avg_sql("distance_to_center_km", 100.0)}, 6) AS mean_center_km,
       round({exact_avg_sql("distance_to_mkad_km", 100.0)}, 6) AS mean_mkad_km,
       CAST(sum(has_metro_near) AS BIGINT) AS near_metro
FROM cc GROUP BY geo_generation_cluster""")
def q_enriched_cluster_summary(spark, sf_dir):
    """Flagship: enrich -> clean -> spatial cluster -> per-cluster summary. The enriched rows are stored:
    cleaning reads them more than once, and its filters on distances would otherwise be pushed below the
    projections that compute them, where each use of a projected coordinate is written out in full."""
    cl = clean_listings(stored(enriched(spark, sf_dir))).withColumn(
        "geo_generation_cluster", F.expr(CLUSTER_EXPR))
    s = cluster_summary(cl)
    extra = cl.groupBy("geo_generation_cluster").agg(
        exact_avg("distance_to_center_km", 100.0).alias("mean_center_km"),
        exact_avg("distance_to_mkad_km", 100.0).alias("mean_mkad_km"),
        F.sum("has_metro_near").cast("bigint").alias("near_metro"))
    out = s.join(extra, "geo_generation_cluster")
    return out.select("geo_generation_cluster", "count", "near_metro",
                      *[rnd(c).alias(c) for c in ["mean_latitude", "mean_longitude",
                                                  "median_price", "median_price_per_m2",
                                                  "mean_center_km", "mean_mkad_km"]])
