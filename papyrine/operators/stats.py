"""Run and corpus statistics as aggregates; partial results per document merge into totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.schemas import CHUNK_TYPES


def document_stats(chunks: DataFrame, rejected: str | None = None) -> DataFrame:
    """Per document: chunks, rejected ones, chunks by type, largest, smallest and summed token counts."""
    kinds = [F.count_if(F.col("chunk_type") == k).alias(f"{k.lower()}_chunks") for k in CHUNK_TYPES]
    tokens = F.coalesce("token_count", F.lit(0))
    lost = F.count_if(F.col(rejected)) if rejected else F.lit(0).cast("bigint")
    return chunks.groupBy("pmcid").agg(
        F.count("*").alias("total_chunks"), lost.alias("rejected_chunks"), *kinds,
        F.max(tokens).alias("largest_chunk"), F.min(tokens).alias("smallest_chunk"), F.sum(tokens).alias("total_tokens"),
    )


def corpus_stats(per_document: DataFrame) -> DataFrame:
    """One row over all documents; a smallest chunk of 0 stands for a document without chunks and is passed over."""
    kinds = [F.coalesce(F.sum(f"{k.lower()}_chunks"), F.lit(0)).alias(f"{k.lower()}_chunks") for k in CHUNK_TYPES]
    out = per_document.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("rejected_chunks"), F.lit(0)).alias("rejected_chunks"), *kinds, F.coalesce(F.max("largest_chunk"), F.lit(0)).alias("largest_chunk"),
        F.coalesce(F.min(F.nullif("smallest_chunk", F.lit(0))), F.lit(0)).alias("smallest_chunk"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )
    return out.withColumn("average_tokens", F.when(F.col("total_chunks") > 0, F.round(F.col("total_tokens") / F.col("total_chunks"), 2)).otherwise(0.0))


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n"))


def embedding_stats(vectors: DataFrame, norm_col: str, seconds: float | None = None) -> DataFrame:
    """Vectors, documents, average norm, and throughput if the time is known."""
    out = vectors.agg(F.count("*").alias("vectors"), F.count_distinct("metadata.pmcid").alias("documents"), F.round(F.avg(norm_col), 6).alias("average_norm"))
    return out if seconds is None else out.withColumn("vectors_per_second", F.round(F.col("vectors") / F.lit(max(seconds, 1e-9)), 2))


def cumulative(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sums of two statistics tables of the same counters."""
    both = previous.unionByName(current, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])
