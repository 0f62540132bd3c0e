"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import abuse, leakage, mixing, names, neardup, neighbours, sentences
from papyrine.llm.sql import ORACLES
from papyrine.llm.mixing import source_name
from papyrine.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.knn(table(spark, folder, "embedded_chunks"), "vec_id", "embedding", k=5)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Search form: every vector whose id is divisible by 100, against all vectors."""
    near = neighbours.knn(table(spark, folder, "embedded_chunks"), "vec_id", "embedding", k=5, ask=lambda c: c % 100 == 0)
    return near.select(F.col("id").alias("vec_id"), "neighbour", "rank", F.round("cosine", 4).alias("cosine"))


def _spellings(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers")
    authors = papers.select(F.lit("author").alias("kind"), F.explode("authors").alias("name"))
    return authors.unionByName(papers.select(F.lit("journal").alias("kind"), F.col("journal").alias("name")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(_spellings(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling under each person, group or journal it may name."""
    return names.classes(_spellings(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    ends = sentences.sentence_ends([
        ("section", table(spark, folder, "sections"), "section_id", "content"), ("abstract", table(spark, folder, "canonical_docs"), "canon_id", "abstract"),
    ])
    return ends.select(F.col("kind").alias("unit_kind"), F.col("id").alias("unit_id"), "end_pos")


def _near_texts(spark: SparkSession, folder: str):
    return neardup.near_duplicates([
        (table(spark, folder, "chunks"), "row_id", "content"), (table(spark, folder, "canonical_docs"), "canon_id", "abstract"),
    ])


def _kind():
    return F.when(F.col("kind") == 0, "chunk").otherwise("abstract").alias("kind")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.all_pairs(*_near_texts(spark, folder))
    return found.select(_kind(), F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per linked text: its group of near-duplicates (smallest key) and its number of links to other texts."""
    pairs, members = _near_texts(spark, folder)
    return neardup.classes(pairs, members).select(_kind(), F.col("id").alias("key"), "class_id", "links")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Report per leaked test item: texts that hold it and the largest part found."""
    found = leakage.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("texts"), F.round(F.max("covered"), 3).alias("largest_part"))


def _mix(spark: SparkSession, folder: str):
    return mixing.prepare(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    counts, planned = _mix(spark, folder)
    return mixing.mixture(counts, planned).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    counts, planned = _mix(spark, folder)
    return mixing.shares(planned, mixing.mixture(counts, planned))


def p7_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every named source of every mix: its target, whether the share reached is within a fiftieth and the sampling error of
    it (which falls with the root of the texts), and whether no text is repeated too often."""
    counts, planned = _mix(spark, folder)
    got = mixing.shares(planned, mixing.mixture(counts, planned))
    near = F.abs(F.col("reached_share") - F.col("target_share")) <= 0.02 + 2 * F.col("target_share") / F.sqrt(F.greatest("docs", F.lit(1)))
    return got.join(planned.select("mix_id", "source", "docs"), ["mix_id", "source"]).select(
        "mix_id", "source", "target_share", "repeats", "docs", near.alias("on_target"), (F.col("most_copies") <= F.col("repeats")).alias("within_repeats")
    )


def _abuse_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "review_labels"), "doc_id", "flagged")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder).where("flagged").select(F.col("id").alias("doc_id"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder).select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "flagged")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged texts and their part per source, under one spelling per source."""
    docs = table(spark, folder, "documents").select("doc_id", source_name("source").alias("source"))
    scored = _abuse_scores(spark, folder).select(F.col("id").alias("doc_id"), F.col("flagged").cast("int").alias("f"))
    return (
        docs.join(scored, "doc_id").groupBy("source")
        .agg(F.count("*").alias("texts"), F.sum("f").alias("flagged"), F.round(F.avg("f"), 6).alias("rate"))
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
