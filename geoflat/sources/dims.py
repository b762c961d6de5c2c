"""Dimension sources (A4, A5, A7, A11, A12): search groups, stations, POI, links."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import require_columns

# Accepted source column names of the stations file.
STATION_NAME_ALIASES = ["name", "station_name"]
STATION_LAT_ALIASES = ["lat", "latitude"]
STATION_LON_ALIASES = ["lon", "lng", "longitude"]


def search_groups(df: DataFrame, order_col: str) -> DataFrame:
    """A4: require (source_group, url), drop NULLs, trim, one url per group - the last
    row (largest ``order_col``) wins, as when a dict is filled in file order."""
    require_columns(df, ["source_group", "url"], "search groups")
    d = df.na.drop(subset=["source_group", "url"]).select(
        F.trim(F.col("source_group").cast("string")).alias("source_group"),
        F.trim(F.col("url").cast("string")).alias("url"), F.col(order_col).alias("_o"))
    return d.groupBy("source_group").agg(F.max_by("url", "_o").alias("url"))


def _last_alias(cols: list[str], aliases: list[str]) -> str | None:
    found = None
    for c in cols:
        if c in aliases:
            found = c
    return found


def stations_dim(raw: DataFrame, extra: list[str] = ()) -> DataFrame:
    """A5: filter city_id == 1 if present, resolve name/lat/lon by alias (the last
    matching column wins), project to (metro, lat, lon), drop NULL coordinates."""
    cols = raw.columns
    name = _last_alias(cols, STATION_NAME_ALIASES)
    lat = _last_alias(cols, STATION_LAT_ALIASES)
    lon = _last_alias(cols, STATION_LON_ALIASES)
    if name is None or lat is None or lon is None:
        raise ValueError("cannot resolve station columns name / lat / lon")
    d = raw.where(F.col("city_id") == 1) if "city_id" in cols else raw
    d = d.select(F.col(name).alias("metro"), F.col(lat).cast("double").alias("lat"),
                 F.col(lon).cast("double").alias("lon"), *extra)
    return d.na.drop(subset=["lat", "lon"])


def poi_dim(raw: DataFrame) -> DataFrame:
    """Required columns present, rows with NULL type/coordinates dropped."""
    require_columns(raw, ["poi_type", "latitude", "longitude"], "poi")
    return raw.na.drop(subset=["poi_type", "latitude", "longitude"])


def known_links(df: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Distinct non-NULL links already stored; empty when the table or the column is
    absent."""
    if df is None or "link" not in df.columns:
        assert spark is not None
        return spark.createDataFrame([], T.StructType([T.StructField("link", T.StringType())]))
    return df.select("link").na.drop().distinct()


LINKS_SCHEMA = T.StructType([T.StructField("source_group", T.StringType()),
                             T.StructField("link", T.StringType())])


def load_links(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The stored (source_group, link) table, or an empty one if it does not exist."""
    try:
        if fmt == "csv":
            return spark.read.option("header", True).schema(LINKS_SCHEMA).csv(path)
        df = spark.read.format(fmt).load(path)
        df.schema  # noqa: B018 - resolves the path now
        return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], LINKS_SCHEMA)
        raise


def save_links(df: DataFrame, path: str) -> None:
    df.select("source_group", "link").write.mode("overwrite").parquet(path)
