"""Session construction and cluster-safe helpers (checkpoint directory, sizing)."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Broadcast only what has a proven bound: dimension tables are checked against this
# row limit before they are shipped to every executor.
BROADCAST_ROW_LIMIT = 20_000

# HotSpot never compiles a method of more bytecode than this. Spark's own limit is far higher, so wide
# expressions fused into one generated method would be interpreted for the whole run.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000


def build_session(master: str | None = None, app: str = "geoflat",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the engine: AQE on, UI off, UTC, Arrow on. ``master`` and the number
    of shuffle partitions are set only when given or when no cluster configured a master, so
    ``spark-submit`` settings stay as they are."""
    builder = SparkSession.builder.appName(app)
    local = master or ("" if os.environ.get("SPARK_ENV_LOADED") or os.environ.get("MASTER")
                       else f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    parts = shuffle_partitions or os.environ.get("GEOFLAT_SHUFFLE_PARTITIONS") or (
        8 if local.startswith("local") else None)
    if local:
        builder = builder.master(local)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GEOFLAT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    limit_method_size(spark)
    ensure_checkpoint_dir(spark)
    return spark


def limit_method_size(spark: SparkSession) -> None:
    """Fuse only what the JVM compiles; a setting below Spark's default is left alone."""
    if int(spark.conf.get(HUGE_METHOD, "65535")) >= 65535:
        spark.conf.set(HUGE_METHOD, str(COMPILED_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only invent one when unset
    (local tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="geoflat-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, for tables that are read again by column: compressed Parquet in a fresh
    folder under the shared checkpoint folder, of which later steps read only the columns they use.
    Partitions and the order of rows are not kept."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_row_count(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> int | None:
    """Row count if it is at most ``limit``, else None. Reads at most limit+1 rows."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark context, as ``--py-files``
    would, so that functions run inside tasks can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_geoflat_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="geoflat-py-"), "geoflat_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    sc._geoflat_shipped = True
