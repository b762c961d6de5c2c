"""OpenStreetMap / GeoJSON readers and writers.

OSM elements arrive as JSON (``spark.read.json`` with the schema below) with
``type, id, lat, lon, center{lat,lon}, tags map, nodes array``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import cumulative_counts
from ..session import bounded_row_count, cut_lineage

ELEMENT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()),
                                          T.StructField("lon", T.DoubleType())])),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("nodes", T.ArrayType(T.LongType())),
])
OVERPASS_SCHEMA = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT_SCHEMA))])


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Overpass JSON documents -> one row per element."""
    doc = spark.read.option("multiLine", True).schema(OVERPASS_SCHEMA).json(path)
    return doc.select(F.explode("elements").alias("e")).select("e.*")


def poi_from_osm(elements: DataFrame) -> DataFrame:
    """Own lat/lon, else the centre's (both from the centre when either is missing);
    ordered tag rules -> school / kindergarten / clinic / mall; unclassified and
    coordinate-less elements dropped; dedup on (poi_type, latitude, longitude)."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    lat = F.when(own, F.col("lat")).otherwise(F.col("center.lat"))
    lon = F.when(own, F.col("lon")).otherwise(F.col("center.lon"))
    tag = lambda k: F.col("tags").getItem(k)
    clinic = F.lit(["clinic", "hospital"])
    poi_type = (F.when(tag("amenity") == "school", "school")
                .when(tag("amenity") == "kindergarten", "kindergarten")
                .when(F.array_contains(clinic, tag("amenity"))
                      | F.array_contains(clinic, tag("healthcare")), "clinic")
                .when((tag("shop") == "mall") | (tag("building") == "retail"), "mall"))
    out = elements.select(poi_type.alias("poi_type"), tag("name").alias("name"),
                          lat.alias("latitude"), lon.alias("longitude"), F.col("id"))
    out = out.where(F.col("poi_type").isNotNull() & F.col("latitude").isNotNull()
                    & F.col("longitude").isNotNull())
    # first occurrence (smallest element id) survives, aggregated so hot keys combine map-side
    return (out.groupBy("poi_type", "latitude", "longitude")
            .agg(F.min_by("name", "id").alias("name"), F.min("id").alias("osm_id"))
            .select("poi_type", "name", "latitude", "longitude", "osm_id"))


def polylines_from_osm(elements: DataFrame) -> DataFrame:
    """Ways -> ordered coordinate lists; unknown node ids are skipped, ways with
    fewer than 2 known points dropped. One row per way: (way_id, coords array<struct>)."""
    nodes = elements.where(F.col("type") == "node").select(
        F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    ways = elements.where(F.col("type") == "way").select(
        F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id"))
    # a way has at most 2,000 nodes in OSM: the per-way list is bounded
    joined = ways.join(nodes, "node_id")
    lines = joined.groupBy("way_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))
    lines = lines.where(F.size("pts") >= 2)
    return lines.select("way_id", F.transform("pts", lambda p: F.struct(
        p["x"].alias("lon"), p["y"].alias("lat"))).alias("coords"))


def polylines_to_segments(lines: DataFrame, id_col: str = "way_id",
                          part_col: str | None = None) -> DataFrame:
    """(feature_id, seg_id, lon1, lat1, lon2, lat2) for consecutive vertex pairs; with
    ``part_col`` also ``part``, and vertices pair within a part only."""
    ids = ["feature_id", "part"] if part_col else ["feature_id"]
    named = [F.col(c).alias(n) for c, n in zip([id_col, part_col], ids)]
    e = lines.select(*named, F.posexplode("coords").alias("i", "p"))
    nxt = e.select(*ids, (F.col("i") - 1).alias("i"), F.col("p").alias("q"))
    return (e.join(nxt, [*ids, "i"])
            .select(*ids, F.col("i").alias("seg_id"),
                    F.col("p.lon").alias("lon1"), F.col("p.lat").alias("lat1"),
                    F.col("q.lon").alias("lon2"), F.col("q.lat").alias("lat2")))


def to_geojson_features(lines: DataFrame, id_col: str = "way_id",
                        name: str = "MKAD") -> DataFrame:
    """A10: one GeoJSON Feature (LineString) per row, as a JSON string column."""
    geom = F.struct(F.lit("LineString").alias("type"),
                    F.transform("coords", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    feat = F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"),
                    F.struct(F.lit(name).alias("name"), F.col(id_col).alias("id")).alias("properties"))
    return lines.select(F.to_json(feat).alias("value"))


def write_geojson(lines: DataFrame, path: str, id_col: str = "way_id") -> None:
    """A10: GeoJSON text sequence (one Feature per line, RFC 8142), written in parallel -
    no task ever holds the whole collection. ``read_ring_geojson(seq=True)`` reads it."""
    to_geojson_features(lines, id_col).write.mode("overwrite").text(path)


FEATURE_SCHEMA = T.StructType([
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType())])),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a line file with ``path`` and ``start`` of their split, numbered from 0 by path, split
    and place in the split: the same numbers however the files are split. Only one row per split is
    ordered; the rows are written once to the checkpoint folder, so both passes see the same ones."""
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    splits = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    splits = cut_lineage(splits.select(F.struct("path", "start").alias("split"), "n", "_first"))
    before = cumulative_counts(splits, [], "split", {"rows": F.col("n")}).select(
        F.col("split").alias("_split"), (F.col("cum_rows") - F.col("rows")).alias("_before"))
    before = before.join(splits, F.col("_split") == F.col("split")).select("_split", "_before", "_first")
    small = bounded_row_count(before) is not None
    joined = rows.join(F.broadcast(before) if small else before, F.struct("path", "start") == F.col("_split"))
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(
        name, *[c for c in rows.columns if c != "_at"])


def read_ring_geojson(spark: SparkSession, path: str, seq: bool = False) -> DataFrame:
    """FeatureCollection (or a GeoJSON text sequence with ``seq=True``) of LineString /
    MultiLineString features -> segments (feature_id, part, seg_id, lon1, lat1, lon2, lat2);
    features are numbered in file order, files by path.
    Raises if the file holds no features."""
    if seq:
        feats = in_file_order(spark.read.schema(FEATURE_SCHEMA).json(path).select(
            F.struct("*").alias("f"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start")), "feature_id").drop("path", "start")
    else:
        schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE_SCHEMA))])
        doc = spark.read.option("multiLine", True).schema(schema).json(path)
        feats = doc.select(F.posexplode("features").alias("feature_id", "f"))
    if feats.limit(1).count() == 0:
        raise ValueError(f"{path}: no features")
    line_t = T.ArrayType(T.ArrayType(T.DoubleType()))
    multi_t = T.ArrayType(line_t)
    lines = feats.select(
        "feature_id",
        F.when(F.col("f.geometry.type") == "MultiLineString",
               F.from_json("f.geometry.coordinates", multi_t))
        .otherwise(F.array(F.from_json("f.geometry.coordinates", line_t))).alias("parts"))
    parts = lines.select("feature_id", F.posexplode("parts").alias("part", "coords"))
    pts = parts.select("feature_id", "part",
                       F.transform("coords", lambda c: F.struct(c[0].alias("lon"),
                                                                c[1].alias("lat"))).alias("coords"))
    return polylines_to_segments(pts, "feature_id", "part")
