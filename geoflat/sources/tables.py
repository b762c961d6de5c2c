"""Table sources and sinks: parquet driver tables, header CSV stage files (A1, A2, A3)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


# The 23-column card schema, in the stage file's column order.
RESULT_SCHEMA = T.StructType([
    T.StructField("source_group", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("area_total", T.DoubleType()),
    T.StructField("rooms", T.IntegerType()),
    T.StructField("floor", T.IntegerType()),
    T.StructField("floors_total", T.IntegerType()),
    T.StructField("address", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("metro", T.StringType()),
    T.StructField("metro_walk_min", T.IntegerType()),
    T.StructField("kitchen_area", T.DoubleType()),
    T.StructField("renovation", T.StringType()),
    T.StructField("walls", T.StringType()),
    T.StructField("build_year", T.IntegerType()),
    T.StructField("ceiling_height", T.DoubleType()),
    T.StructField("floor_position", T.StringType()),
    T.StructField("elevator", T.StringType()),
    T.StructField("house_number", T.StringType()),
    T.StructField("yard", T.StringType()),
    T.StructField("parking", T.StringType()),
    T.StructField("playground", T.StringType()),
    T.StructField("link", T.StringType()),
])
RESULT_COLS = [f.name for f in RESULT_SCHEMA.fields]


def scan_listings_csv(spark: SparkSession, path: str,
                      schema: T.StructType | None = None) -> DataFrame:
    """A1: header CSV with declared types (inference only when no schema is given); an
    empty field is NULL - quoted or not - as in pandas; a BOM is stripped by Spark."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in strings}) if strings else df


def write_stage(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """A2: overwrite one stage table (parquet by default; CSV with header at the edges)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def append_cards(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A3: append rows in the fixed card column order; the first write creates the table."""
    cols = [c for c in RESULT_COLS if c in df.columns]
    w = df.select(*cols).write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
