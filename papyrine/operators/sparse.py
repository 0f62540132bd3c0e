"""Sparse index: postings in long form, document frequencies, and BM25 scores as one join and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"(?U)[^\p{L}\p{N}]+"


def terms(c: str | Column) -> Column:
    """Words of letters and digits in small letters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORDS), lambda w: w != "")


def postings(df: DataFrame, key: str, text: str = "content") -> DataFrame:
    """``(key, term, tf, dl)``: occurrences per text and term, and the length of the text."""
    t = df.select(key, terms(text).alias("terms")).withColumn("dl", F.size("terms"))
    return t.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def document_frequency(post: DataFrame, key: str, total: DataFrame) -> DataFrame:
    """``(term, df, idf)``; ``total`` is one row with the number of texts ``n``."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total.select("n"))).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def corpus_size(df: DataFrame, text: str = "content") -> DataFrame:
    """One row: texts ``n`` and average length ``avgdl`` over all of them."""
    return df.select(F.size(terms(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, key: str, queries: DataFrame, query_key: str, text: str = "content", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query, key, score)`` of every text that shares a term with a query.

    Only postings of query terms are formed (a semi join by term before anything is counted); statistics still cover
    all texts. Repeated words of a query count once.
    """
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(terms(query_text))).alias("term"))
    wanted = asked.select("term").distinct()
    size = corpus_size(docs, text)
    flat = docs.select(F.col(key).alias("key"), terms(text).alias("terms")).withColumn("dl", F.size("terms"))
    post = (
        flat.select("key", "dl", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
        .groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))
    )
    idf = document_frequency(post, "key", size)
    weighted = post.join(idf, "term").crossJoin(F.broadcast(size.select("avgdl")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighted.select("key", "term", part.alias("part"))
    return asked.join(scored, "term").groupBy("query", "key").agg(F.sum("part").alias("score"))


def sparse_vectors(post: DataFrame, key: str) -> DataFrame:
    """``(key, sparse)`` with term numbers and frequencies, sorted by number."""
    return post.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("i"), F.col("tf").cast("float").alias("v")))).alias("p")).select(
        key, F.struct(F.col("p.i").alias("indices"), F.col("p.v").alias("values")).alias("sparse")
    )
