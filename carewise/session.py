"""Helpers around the session: durable intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="carewise-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; all of one application lie together,
    so that a cluster can expire them when it has ended."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/carewise/{app}/{name}-{uuid.uuid4().hex}"


def shuffle_tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the user has set, for steps whose work is not in
    proportion to their bytes and which should keep that number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files; else they stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str, scratch: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table and read it back, which cuts its lineage.

    It gets a new folder in the shared one, or replaces the table of that name in ``scratch``.
    """
    path = new_folder(df.sparkSession, name) if scratch is None else f"{scratch.rstrip('/')}/{name}"
    with shuffles_freed(df.sparkSession):
        df.write.mode("error" if scratch is None else "overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are expensive to compute, without computing them twice.

    Catalyst pushes a filter below the projection that made its columns and repeats their
    expressions there, once per use. A partition id in the projection keeps the filter above.
    """
    kept = df.withColumn("_task", F.spark_partition_id())
    return kept.filter((F.col("_task") >= 0) & condition).drop("_task")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> tuple[DataFrame, bool]:
    """Mark a stored table for broadcast when its measured size is within ``limit``.

    Returns the table and whether it is marked; beyond the limit the join stays a shuffle join.
    """
    width = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif kind == "array":
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 16 + 16
        else:
            width = width + 16
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return (F.broadcast(df), True) if size <= limit else (df, False)
