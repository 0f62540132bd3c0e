"""File sources and sinks of the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.articles import decode


def stem(path, suffix: str):
    """File name without folder and suffix."""
    return F.regexp_extract(path, rf"([^/]+?){suffix.replace('.', '[.]')}$", 1)


def xml_files(spark: SparkSession, folder: str, target: str | None = None, limit: int | None = None) -> DataFrame:
    """``(pmcid, xml)`` of the folder's XML files, in the order of their names where a limit applies."""
    glob = f"{target}.xml" if target else "*.xml"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    df = raw.select(stem(F.col("path"), ".xml").alias("pmcid"), decode("content").alias("xml"))
    return df.orderBy("pmcid").limit(limit) if limit else df


def json_documents(spark: SparkSession, folder: str, schema: str, key: str = "pmcid", target: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents stored as one JSON file each."""
    df = spark.read.schema(schema).option("multiLine", "true").json(folder)
    if target:
        df = df.where(F.col(key) == target)
    return df.orderBy(key).limit(limit) if limit else df


def stage_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a stage, or None if it was not written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p)):
        return None
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
