"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a Parquet table instead of keeping blocks on one executor,
so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is absent, a temporary folder in local mode, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="papyrine-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/papyrine-{os.getpid()}-{uuid.uuid4().hex[:12]}-{label}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table made by ``materialize`` that a later one replaces; nothing may read it any more."""
    path = table.__dict__.pop("_written_to", None)
    if path:
        _remove(table.sparkSession, path)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The written table and its number of rows, observed while it is written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return table, seen.get["n"]


def tidy(spark: SparkSession) -> None:
    """Between rounds of an iteration: let the driver forget earlier plans, so that their shuffle files are removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_keys(df: DataFrame, key: str, over: int, slots: int = 1 << 16) -> DataFrame:
    """Keys that occur in more than ``over`` rows, with their row count, as ``(key, rows)``.

    Two passes keep the shuffle small: counts per hash slot first (at most ``slots`` rows leave each map task),
    then exact counts for the rows of slots that can hold a hot key. A slot counts at least as much as each of
    its keys, so no hot key is missed.
    """
    slot: Column = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot")
    full = df.select(slot).groupBy("slot").count().where(F.col("count") > over).select("slot")
    return (
        df.select(key, slot).join(F.broadcast(full), "slot", "left_semi")  # at most ``slots`` integers
        .groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > over)
    )
