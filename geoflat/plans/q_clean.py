"""Registered queries: cleaning core, projection/schema operators, filters, scalar casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators.ranks import column_quantiles
from ..sources import fixtures as X
from ..sources.fixtures import CLUSTER_EXPR
from .catalog import exact_avg, exact_avg_sql, query, rnd
from .clean import clean_listings
from .oracle_sql import with_cleaned


def cleaned_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_listings(X.listings(spark, sf_dir))


def clustered_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_listings(spark, sf_dir).withColumn("geo_generation_cluster",
                                                      F.expr(CLUSTER_EXPR))


def cluster_summary(df: DataFrame, cluster: str = "geo_generation_cluster") -> DataFrame:
    """per cluster size, mean lat/lon, exact median price and price per m2."""
    base = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("count"),
                                   F.avg("latitude").alias("mean_latitude"),
                                   F.avg("longitude").alias("mean_longitude"))
    med = column_quantiles(df, [cluster], ["price", "price_per_m2"], {"_m": 0.5}, cheap=True)
    wide = med.groupBy(cluster).agg(
        F.max(F.when(F.col("_feature") == "price", F.col("_m"))).alias("median_price"),
        F.max(F.when(F.col("_feature") == "price_per_m2", F.col("_m"))).alias("median_price_per_m2"))
    return base.join(wide, cluster, "left")


@query("dataset_clean", sql=with_cleaned() + "SELECT * FROM cleaned")
def q_dataset_clean(spark, sf_dir):
    return cleaned_listings(spark, sf_dir)


@query("cluster_summary", sql=with_cleaned() + """
SELECT geo_generation_cluster, count(*) AS count,
       round(avg(latitude), 6) AS mean_latitude,
       round(avg(longitude), 6) AS mean_longitude,
       round(quantile_cont(price, 0.5), 6) AS median_price,
       round(quantile_cont(price_per_m2, 0.5), 6) AS median_price_per_m2
FROM clustered_clean GROUP BY geo_generation_cluster""")
def q_cluster_summary(spark, sf_dir):
    s = cluster_summary(clustered_clean(spark, sf_dir))
    return s.select("geo_generation_cluster", "count",
                    *[rnd(c).alias(c) for c in ["mean_latitude", "mean_longitude",
                                                "median_price", "median_price_per_m2"]])
