"""Dense, sparse and hybrid retrieval, reranking, context assembly and its metrics.

Every ranking orders by the rounded score, then by id, so that ties have one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clean_text
from papyrine.functions.vectors import batches_of, matrix
from papyrine.operators.sparse import bm25, terms


def prepare_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """Query texts cleaned like the corpus; blank ones are dropped."""
    return queries.withColumn(text, clean_text(text)).where(F.col(text) != "")


def top(df: DataFrame, by: str, key: str, k: int, query: str = "query") -> DataFrame:
    """Rank per query; the group limit runs before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(by).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(corpus: DataFrame, key: str, vec: str, queries: DataFrame, query_key: str, query_vec: str, dim: int, k: int = 20, digits: int = 6, block_queries: int = 4096, exclude_self: bool = True) -> DataFrame:
    """``(query, key, score, rank)``: exact cosine search of a stated query set against all vectors.

    Queries are taken in blocks of at most ``block_queries`` (that many vectors are sent to the executors); each task
    scores its batches by one matrix product and passes on its k best rows per query. Vectors of another dimension,
    with null, NaN or infinite entries, or of length zero are neither searched nor found. ``exclude_self`` is for query
    ids that are ids of the corpus: a query then does not find itself.
    """
    spark = corpus.sparkSession
    asked = queries.select(F.col(query_key).cast("bigint").alias("q"), F.col(query_vec).alias("v")).where("q is not null")
    n = asked.count()
    rows = corpus.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("v")).where("key is not null")
    out = None
    parts = max(1, -(-n // block_queries))
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        t = mine.toArrow()
        at, x = matrix(t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float32())), dim)
        ids = t.column("q").to_numpy()[at]
        size = np.linalg.norm(x, axis=1)
        sent = spark.sparkContext.broadcast((ids[size > 0], x[size > 0] / size[size > 0, None]))  # at most about block_queries vectors
        found = rows.mapInArrow(_score(sent, dim, k, digits, exclude_self), "query bigint, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, "score", "key", k)


class _Best:
    """The k best rows per query that a task has met, by score and then by key."""

    def __init__(self, k: int):
        self.k = k
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        q, c, s = (np.concatenate(p) for p in zip(self.rows, (query, key, score)))
        order = np.lexsort((c, -s, q))
        q = q[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
        keep = order[rank < self.k]
        self.rows = (q[rank < self.k], c[keep], s[keep])

    def floor(self, queries: int) -> np.ndarray:
        """The score that a row must reach to be among the k best of its query."""
        q, _, s = self.rows
        n = np.bincount(q, minlength=queries)
        out = np.full(queries, -np.inf)
        if len(q):
            some = n > 0
            lowest = np.minimum.reduceat(s, (np.cumsum(n) - n)[some])
            out[some] = np.where(n[some] == self.k, lowest, -np.inf)
        return out

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        q, c, s = self.rows
        return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query", "key", "score"])


def _score(sent, dim: int, k: int, digits: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = _Best(k)
        for b in batches_of(batches, 2048):
            at, x = matrix(b.column(1), dim)
            size = np.linalg.norm(x, axis=1)
            at, x, size = at[size > 0], x[size > 0], size[size > 0]
            if not len(at) or not len(ids):
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)[at]
            s = np.round(q @ (x / size[:, None]).T, digits)
            if exclude_self:
                s[ids[:, None] == keys[None, :]] = -9
            cut = best.floor(len(ids))
            if s.shape[1] > k:
                cut = np.maximum(cut, -np.partition(-s, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero((s >= cut[:, None]) & (s > -9))
            best.add(row, keys[col], s[row, col])
        yield best.batch(ids)

    return run


def bm25_topk(docs: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 20, digits: int = 6, text: str = "content", query_text: str = "text", k1: float = 1.5, b: float = 0.75, most_terms: int = 1_000_000) -> DataFrame:
    """``(query, key, score, rank)``: the texts with the highest BM25 score.

    The terms of the queries are sent to all tasks where they are at most ``most_terms``: one scan counts texts, their length
    and the texts per term, a second one scores its batches and passes on k rows per query and task, whatever the size of the
    corpus. More terms are joined instead (``sparse.bm25``); the result is the same.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_key).cast("bigint").alias("query"), F.explode(F.array_distinct(terms(query_text))).alias("term")).where("query is not null").distinct()
    n = asked.limit(most_terms + 1).count()
    if n > most_terms:
        return top(bm25(docs, key, queries, query_key, text, query_text, k1, b).withColumn("score", F.round("score", digits)), "score", "key", k)
    t = asked.orderBy("query", "term").toArrow()
    ids, who = np.unique(t.column("query").to_numpy(), return_inverse=True)
    words, what = np.unique(np.array(t.column("term").to_pylist(), dtype=object), return_inverse=True)
    words = pa.array(list(words), pa.string())
    rows = docs.select(F.col(key).cast("bigint").alias("key"), terms(text).alias("terms"))

    def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of each text; row and number of each of its words that a query has."""
        lists = batch.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = pc.index_in(lists.flatten(), value_set=sent.value[0])
        known = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        return size, np.repeat(np.arange(len(size)), size)[known], number.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(sent.value[0])
        texts, length, df = 0, 0, np.zeros(m, np.int64)
        for batch in batches_of(batches, 2048):
            size, row, term = tokens(batch)
            texts, length = texts + len(size), length + int(size.sum())
            df += np.bincount(np.unique(row * m + term) % m, minlength=m) if len(row) else 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some], pa.int64()), pa.array([texts, length, *df[some]], pa.int64())], ["term", "n"])

    sent = spark.sparkContext.broadcast((words, who, what))  # at most most_terms terms
    seen = {r["term"]: r["n"] for r in rows.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per term
    texts, average = seen.get(-2, 0), seen.get(-1, 0) / max(1, seen.get(-2, 0))
    df = np.array([seen.get(i, 0) for i in range(len(words))], float)
    idf = np.log1p((texts - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, who, what = sent.value
        m, best = len(idf), _Best(k)
        by = np.argsort(what, kind="stable")  # the queries of each term
        start = np.searchsorted(what[by], np.arange(m + 1))
        for batch in batches_of(batches, 1024):
            size, row, term = tokens(batch)
            if not len(row):
                continue
            at, tf = np.unique(row * m + term, return_counts=True)
            row, term = at // m, at % m
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / average))
            many = start[term + 1] - start[term]
            query = who[by[np.repeat(start[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())]]
            pair = query * len(size) + np.repeat(row, many)
            if len(ids) * len(size) <= 8_000_000:  # one number per query and text of the batch
                total = np.bincount(pair, np.repeat(part, many), len(ids) * len(size))
                low = best.floor(len(ids))
                pair = np.flatnonzero(total >= np.repeat(np.maximum(low - 10.0**-digits, 1e-300), len(size)))
                total = np.round(total[pair], digits)
            else:
                pair, inverse = np.unique(pair, return_inverse=True)
                total = np.round(np.bincount(inverse, np.repeat(part, many)), digits)
            keys = batch.column(0).to_numpy(zero_copy_only=False)[pair % len(size)]
            known = ~np.isnan(keys) if keys.dtype.kind == "f" else slice(None)
            best.add(pair[known] // len(size), keys[known].astype(np.int64), total[known])
        yield best.batch(ids)

    return top(rows.mapInArrow(score, "query bigint, key bigint, score double"), "score", "key", k)


def rrf(ranked: list[DataFrame], k: int = 60, final: int = 20, digits: int = 9) -> DataFrame:
    """``(query, key, score, rank)`` by reciprocal rank fusion of rankings ``(query, key, rank)``."""
    parts = [r.select("query", "key", (1.0 / (F.col("rank") + k)).alias("s")) for r in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("query", "key").agg(F.round(F.sum("s"), digits).alias("score")), "score", "key", final)


def rerank(candidates: DataFrame, query_text: str = "query_text", text: str = "content", final: int = 5, digits: int = 6) -> DataFrame:
    """Reorder candidates by lexical overlap: the part of the query's words that the text holds."""
    q, t = F.array_distinct(terms(query_text)), F.array_distinct(terms(text))
    share = F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), digits)).otherwise(0.0)
    return top(candidates.drop("rank").withColumn("score", share), "score", "key", final)


def context(ranked: DataFrame, tokens: str = "token_count", budget: int = 6000) -> DataFrame:
    """The best ranked rows whose token counts together stay within the budget."""
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used_tokens", F.sum(F.coalesce(tokens, F.lit(0))).over(w)).where(F.col("used_tokens") <= budget)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 20) -> DataFrame:
    """Per query of ``relevant(query, key)``: recall at k, reciprocal rank and nDCG at k, with binary relevance."""
    rel = relevant.select("query", "key").distinct()
    total = rel.groupBy("query").agg(F.count("*").alias("relevant"))
    hit = ranked.where(F.col("rank") <= k).join(rel, ["query", "key"]).groupBy("query").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return total.join(hit, "query", "left").select(
        "query", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def citations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, pos, cited)``: bracketed numbers and PMC ids cited in a text."""
    c = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[(\d+)\]|\b(PMC\d+)\b"), F.lit(0))
    return answers.select(key, F.posexplode(c).alias("pos", "cited"))


def search(chunks: DataFrame, key: str, vec: str, queries: DataFrame, dim: int, k: int = 20, final: int = 5, where=None) -> DataFrame:
    """Hybrid search for ``queries(query, text, embedding)``, with texts cleaned like the corpus: filtered dense and sparse
    rankings, fused and reranked."""
    pool = chunks if where is None else chunks.where(where)
    q = prepare_queries(queries.withColumn("query", F.col("query").cast("bigint")))
    dense = dense_topk(pool, key, vec, q, "query", "embedding", dim, k, digits=5, exclude_self=False)
    sparse = bm25_topk(pool, key, q, "query", k, digits=5)
    fused = rrf([dense, sparse], final=k)
    wide = fused.join(pool.select(F.col(key).alias("key"), "content", "token_count"), "key").join(q.select("query", F.col("text").alias("query_text")), "query")
    return rerank(wide, final=final)
