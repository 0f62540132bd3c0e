"""Queries over vectors, the sparse index, retrieval and the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import registry
from papyrine.functions.vectors import norm
from papyrine.operators import embedding, index, retrieval, sparse, stats, validate
from papyrine.plans.text_queries import BLANK, _point, _slug, _strip, _words, _ws
from papyrine.tables import table

DIM = 128


def embed_norms(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's length, or why it has none."""
    v = table(spark, d, "embedded_chunks").select("vec_id", F.coalesce(F.size("embedding"), F.lit(0)) <= 0, norm("embedding").alias("n")).toDF("vec_id", "none", "n")
    state = F.when(F.col("none"), "empty").when(F.col("n").isNull() | F.isnan("n"), "not_a_number").when(F.col("n") >= 1e30, "out_of_range").otherwise("ok")
    v = v.withColumn("state", state)
    return v.select("vec_id", F.when(F.col("state") == "ok", F.round("n", 5)).alias("norm"), "state")


def embed_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_chunks").select("vec_id", F.array_join(validate.vector_reasons("embedding", DIM), ",").alias("reasons"))


def embed_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(table(spark, d, "embedded_chunks"), validate.vector_reasons("embedding", DIM))


def embed_stats(spark: SparkSession, d: str) -> DataFrame:
    good, _ = validate.split(table(spark, d, "embedded_chunks"), validate.vector_reasons("embedding", DIM))
    return stats.embedding_stats(good.withColumn("n", norm("embedding")), "n").withColumn("average_norm", F.round("average_norm", 4))


def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the vectors that are not zero."""
    e = embedding.embed(table(spark, d, "chunks"), dim=256)
    return e.select("chunk_id", "embedding_model", "embedding_dimension", F.posexplode("embedding").alias("entry", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 4))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Query set: vectors whose id is divisible by 100, against all."""
    v = table(spark, d, "embedded_chunks")
    out = retrieval.dense_topk(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", DIM, k=20, digits=5)
    return out.select("query", F.col("key").alias("vec_id"), "score", "rank")


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embedded_chunks")
    pool = v.where("metadata.pub_year between 2015 and 2020 and metadata.chunk_type = 'TEXT'")
    out = retrieval.dense_topk(pool, "vec_id", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", DIM, k=5, digits=5)
    return out.select("query", F.col("key").alias("vec_id"), "score", "rank")


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.postings(table(spark, d, "chunks"), "row_id")


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return sparse.document_frequency(sparse.postings(c, "row_id"), "row_id", sparse.corpus_size(c)).withColumn("idf", F.round("idf", 6))


def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = sparse.sparse_vectors(sparse.postings(table(spark, d, "chunks"), "row_id"), "row_id")
    return v.select("row_id", F.size("sparse.indices").alias("terms"), F.aggregate("sparse.values", F.lit(0.0), lambda a, x: a + x).alias("words"), F.array_join(F.transform(F.array_sort("sparse.values"), lambda x: x.cast("int").cast("string")), ",").alias("counts"), (F.size(F.array_distinct("sparse.indices")) == F.size("sparse.indices")).alias("no_index_twice"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.bm25_topk(table(spark, d, "chunks"), "row_id", table(spark, d, "eval_items"), "item_id", k=20, digits=5)
    return out.select("query", F.col("key").alias("row_id"), "score", "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Each eval item asks the sparse index; each hundredth vector asks the dense one under the same number."""
    v = table(spark, d, "embedded_chunks")
    first = v.where("embedding is not null").groupBy("chunk_id").agg(F.min("vec_id").alias("vec_id"))
    chunks = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("row_id").alias("row_id"))
    place = first.join(chunks, "chunk_id").select("vec_id", "row_id")
    items = table(spark, d, "eval_items").select((F.col("item_id") - 1000).alias("q"), "text")
    queries = v.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("bigint").alias("q"), "embedding")
    dense = retrieval.dense_topk(v, "vec_id", "embedding", queries, "q", "embedding", DIM, k=20, digits=5, exclude_self=False)
    dense = dense.join(place.withColumnRenamed("vec_id", "key"), "key").select("query", F.col("row_id").alias("key"), "rank")
    dense = dense.groupBy("query", "key").agg(F.min("rank").alias("rank"))
    lexical = retrieval.bm25_topk(table(spark, d, "chunks"), "row_id", items.join(queries.select("q"), "q"), "q", k=20, digits=5)
    return retrieval.rrf([dense, lexical], k=60, final=20)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query", F.col("key").alias("row_id"), F.round("score", 8).alias("score"), "rank")


def _ranked_text(spark: SparkSession, d: str, k: int) -> DataFrame:
    found = retrieval.bm25_topk(table(spark, d, "chunks"), "row_id", table(spark, d, "eval_items"), "item_id", k=k, digits=5)
    wide = found.join(table(spark, d, "chunks").select(F.col("row_id").alias("key"), "content", "token_count"), "key")
    return wide.join(table(spark, d, "eval_items").select(F.col("item_id").alias("query"), F.col("text").alias("query_text")), "query")


def rerank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_ranked_text(spark, d, 20), final=5).select("query", F.col("key").alias("row_id"), "score", "rank")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.context(_ranked_text(spark, d, 20), budget=600)
    return out.select("query", F.col("key").alias("row_id"), "rank", "used_tokens")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Relevant to a vector: vectors of the same chunk or document section; judged on the exact dense ranking."""
    v = table(spark, d, "embedded_chunks")
    ranked = retrieval.dense_topk(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", DIM, k=20, digits=5)
    mine = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "chunk_id")
    rel = mine.join(v.select(F.col("vec_id").alias("key"), "chunk_id"), "chunk_id").where("query <> key").select("query", "key")
    return retrieval.metrics(ranked, rel, k=20)


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.citations(table(spark, d, "sections"), "section_id", "content")


def payload_build(spark: SparkSession, d: str) -> DataFrame:
    p = index.build_points(table(spark, d, "embedded_chunks"), table(spark, d, "chunks"))
    return p.select("id", "chunk_id", "pmcid", "title", "journal", "pub_year", "section", "subsection", "chunk_type", "token_count", "metadata_header", "content")


def payload_missing(spark: SparkSession, d: str) -> DataFrame:
    p = index.build_points(table(spark, d, "embedded_chunks"), table(spark, d, "chunks"))
    why = validate.payload_missing()
    return p.select("id", F.array_join(why, ",").alias("missing")).where("missing <> ''")


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is embedded is the collection, the chunks are the new batch; of each the last row per chunk id."""
    old = table(spark, d, "embedded_chunks").where("chunk_id <> ''").select("chunk_id", F.col("vec_id").alias("ref"), F.col("generated_at").alias("at"), F.lit("vector").alias("origin"))
    new = table(spark, d, "chunks").where("chunk_id <> ''").select("chunk_id", F.col("row_id").alias("ref"), F.col("created_at").alias("at"), F.lit("chunk").alias("origin"))
    old, new = (index.latest(x, "chunk_id", "at", "ref").select("chunk_id", "ref", "origin") for x in (old, new))
    return old, new


def index_new_only(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return index.only_new(new, old, "chunk_id")


def index_existing(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return index.only_existing(new, old, "chunk_id")


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return index.upserted(old, new, "chunk_id")


def index_upsert_force(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return index.upserted(old, new, "chunk_id", force=True)


def index_dedup(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(table(spark, d, "chunks").select("chunk_id", "row_id", "created_at"), "chunk_id", "created_at", "row_id").select("chunk_id", "row_id")


def index_validate(spark: SparkSession, d: str) -> DataFrame:
    p = index.build_points(table(spark, d, "embedded_chunks"), table(spark, d, "chunks"))
    return validate.index_report(p, table(spark, d, "embedded_chunks").count(), DIM)


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have chunks but no vectors yet."""
    done = table(spark, d, "embedded_chunks").select("metadata.pmcid")
    return index.only_new(table(spark, d, "chunks").select("pmcid").distinct(), done, "pmcid")


def index_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred points by id, for a look at a collection."""
    p = index.build_points(table(spark, d, "embedded_chunks"), table(spark, d, "chunks"))
    return index.first_points(p.select("id", "chunk_id"), 100)


def payload_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of vectors stripped of their own title, journal and year, which the last record of the paper gives."""
    bare = F.struct("metadata.pmcid", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("journal"), F.lit(None).cast("int").alias("pub_year"), *[f"metadata.{c}" for c in ("section", "subsection", "section_path", "chunk_type", "token_count")])
    papers = index.latest(table(spark, d, "papers"), "pmcid", "ingested_at", "record_id")
    p = index.build_points(table(spark, d, "embedded_chunks").withColumn("metadata", bare), table(spark, d, "chunks"), papers)
    return p.select("id", "chunk_id", "pmcid", "title", "journal", "pub_year", "article_type", "license", F.array_join(validate.payload_missing(zero_is_missing=True), ",").alias("missing"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 vectors in the order of their ids."""
    return embedding.batch_numbers(table(spark, d, "embedded_chunks").select("vec_id"), 32, "vec_id").select("vec_id", F.col("position").cast("bigint").alias("position"), F.col("batch").cast("bigint").alias("batch"))


def embed_memory(spark: SparkSession, d: str) -> DataFrame:
    """Megabytes of a batch of 32 rows of each type, by the longest of them."""
    longest = table(spark, d, "chunks").groupBy("chunk_type").agg(F.max(F.coalesce("token_count", F.lit(0))).alias("longest"))
    return longest.select("chunk_type", "longest", F.round(embedding.memory_estimate_mb(32, F.col("longest"), 768), 4).alias("megabytes"))


def sparse_points(spark: SparkSession, d: str) -> DataFrame:
    """Points with their dense and sparse vectors: entries of the one, terms of the other."""
    p = index.with_sparse(index.build_points(table(spark, d, "embedded_chunks"), table(spark, d, "chunks")))
    words = F.coalesce(F.aggregate("sparse.values", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return p.select("id", "chunk_id", F.size("embedding").alias("entries"), F.coalesce(F.size("sparse.indices"), F.lit(0)).alias("terms"), words.alias("words"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Filtered hybrid search: every hundredth vector asks with its own direction and the text of its chunk."""
    text = table(spark, d, "chunks").groupBy("chunk_id").agg(F.max_by("content", "row_id").alias("content"))
    pool = table(spark, d, "embedded_chunks").where("metadata.pub_year >= 2010").join(text, "chunk_id").select("vec_id", "embedding", "content", F.col("metadata.token_count").alias("token_count"))
    asked = table(spark, d, "embedded_chunks").where("vec_id % 100 = 0").join(text, "chunk_id").select(F.col("vec_id").alias("query"), F.col("content").alias("text"), "embedding")
    out = retrieval.search(pool, "vec_id", "embedding", asked, DIM)
    return out.select("query", F.col("key").alias("vec_id"), "score", "rank")


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.prepare_queries(table(spark, d, "eval_items")).select("item_id", "text")


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions registered for SQL users."""
    registry.register(spark)
    table(spark, d, "chunks").createOrReplaceTempView("papyrine_chunks")
    return spark.sql(
        "select row_id, normalize_whitespace(content) flat, slugify(metadata.title) slug, point_id(chunk_id) point, round(rrf(cast(row_id % 50 as int), 60), 9) fused, "
        "round(bm25(cast(token_count as double), 3D, 1000D, cast(length(content) as double), 80D), 6) weight from papyrine_chunks where chunk_id <> ''"
    )


def statistics_merged(spark: SparkSession, d: str) -> DataFrame:
    """Counters of two runs, over rows with even and with odd numbers, merged into totals."""
    c = table(spark, d, "chunks").groupBy((F.col("row_id") % 2 == 0).alias("first")).agg(F.count("*").alias("chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    return stats.cumulative(c.where("first").drop("first"), c.where("not first").drop("first"))


_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_POST = f"select row_id, term, count(*) tf, dl from (select row_id, len(t)::INT dl, unnest(t) term from (select row_id, {_TERMS.format('content')} t from chunks)) group by row_id, term, dl"
_IDF = f"select term, count(*) df, ln(1 + ((select count(*) from chunks) - count(*) + 0.5) / (count(*) + 0.5)) idf from ({_POST}) group by term"
_USABLE = "list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)) = [] and len(embedding) = 128 and list_max(list_transform(embedding, lambda x: abs(x))) > 0"
_NORMED = f"select vec_id, metadata, chunk_id, list_transform(embedding, lambda x: x::DOUBLE) e from embedded_chunks where embedding is not null and {_USABLE}"
_DENSE = f"""with v as ({_NORMED}), s as (select q.vec_id query, k.vec_id, round(list_cosine_similarity(q.e, k.e), 5) score from v q join v k on q.vec_id <> k.vec_id and q.vec_id % 100 = 0 {{}}),
 r as (select *, row_number() over (partition by query order by score desc, vec_id)::INT "rank" from s)"""
_BM25 = f"""with post as ({_POST}), idf as ({_IDF}), n as (select avg(len({_TERMS.format('content')})) avgdl from chunks),
 q as (select distinct item_id query, unnest({_TERMS.format('text')}) term from eval_items),
 s as (select query, row_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 5) score from q join post using (term) join idf using (term), n group by query, row_id),
 r as (select *, row_number() over (partition by query order by score desc, row_id)::INT "rank" from s)"""
_VREASON = """case when embedding is null or len(embedding) = 0 then 'empty_embedding' else concat_ws(',', case when len(embedding) <> 128 then 'wrong_dimension' end,
 case when nan then 'contains_nan' end, case when inf then 'contains_inf' end, case when not nan and not inf and abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-3 then 'non_unit_norm' end) end"""
_VROWS = "select *, coalesce(len(list_filter(embedding, lambda x: x is null or isnan(x))) > 0, false) nan, coalesce(len(list_filter(embedding, lambda x: isinf(x))) > 0, false) inf from embedded_chunks"
_POINTS = f"""select {_point('v.chunk_id')} id, v.chunk_id, coalesce(v.metadata.pmcid, '') pmcid, coalesce(v.metadata.title, '') title, coalesce(v.metadata.journal, '') journal, v.metadata.pub_year pub_year,
 coalesce(v.metadata.section, '') section, coalesce(v.metadata.subsection, '') subsection, coalesce(v.metadata.chunk_type, '') chunk_type, coalesce(v.metadata.token_count, 0) token_count,
 coalesce(v.metadata_header, '') metadata_header, coalesce(c.content, '') content, v.embedding from embedded_chunks v left join (select chunk_id, max_by(content, row_id) content from chunks where content is not null group by 1) c using (chunk_id)
 where coalesce(v.chunk_id, '') <> '' and coalesce(len(v.embedding), 0) > 0"""
_MISSING = "concat_ws(',', " + ", ".join(f"case when {f} is null or {f}::VARCHAR = '' then '{f}' end" for f in validate.REQUIRED_WITH_CONTENT) + ")"
_LAST = "select chunk_id, {0} from (select chunk_id, {0}, row_number() over (partition by chunk_id order by {1} desc nulls last, {0} desc) n from {2} where chunk_id is not null) where n = 1"
_OLD = "select chunk_id, vec_id ref, 'vector' origin from (" + _LAST.format("vec_id", "generated_at", "embedded_chunks") + ") where chunk_id <> ''"
_NEW = "select chunk_id, row_id ref, 'chunk' origin from (" + _LAST.format("row_id", "created_at", "chunks") + ") where chunk_id <> ''"

ORACLES = {
    "embed_norms": """select vec_id, case when state = 'ok' then round(n, 5) end norm, state from (select vec_id, n, case when coalesce(len(embedding), 0) = 0 then 'empty' when bad or isnan(n) then 'not_a_number' when n >= 1e30 then 'out_of_range' else 'ok' end state
 from (select vec_id, embedding, coalesce(len(list_filter(embedding, lambda x: x is null)) > 0, false) bad, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) n from embedded_chunks))""",
    "embed_validate": f"select vec_id, {_VREASON} reasons from ({_VROWS})",
    "embed_report": f"select reason, count(*) n from (select unnest(string_split({_VREASON}, ',')) reason from ({_VROWS})) where reason <> '' group by 1 union all select case when r = '' then 'valid' else 'rejected' end, count(*) from (select {_VREASON} r from ({_VROWS})) group by 1",
    "embed_stats": f"select count(*) vectors, count(distinct metadata.pmcid) documents, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) average_norm from ({_VROWS}) where {_VREASON} = ''",
    "embed_chunks": f"""with t as (select row_id, chunk_id, case when coalesce(metadata_header, '') <> '' then metadata_header || chr(10) || chr(10) || coalesce(content, '') else coalesce(content, '') end t from chunks where not {BLANK('metadata_header')} or not {BLANK('content')}),
 w as (select row_id, chunk_id, unnest({_words('lower(t)')}) w from t), h as (select row_id, chunk_id, ('0x' || left(md5(w), 8))::UBIGINT h from w),
 e as (select row_id, chunk_id, (h % 256)::INT entry, sum(case when h >= 2147483648 then 1 else -1 end)::DOUBLE x from h group by all),
 n as (select row_id, sqrt(sum(x * x)) size from e group by 1)
 select chunk_id, 'hashing-256' embedding_model, 256 embedding_dimension, entry, round(x / size, 4) "value" from e join n using (row_id) where x <> 0""",
    "dense_topk": _DENSE.format("") + ' select query, vec_id, score, "rank" from r where "rank" <= 20',
    "dense_topk_filtered": _DENSE.format("and k.metadata.pub_year between 2015 and 2020 and k.metadata.chunk_type = 'TEXT'") + ' select query, vec_id, score, "rank" from r where "rank" <= 5',
    "term_freq": _POST,
    "doc_freq_idf": f"select term, df, round(idf, 6) idf from ({_IDF})",
    "sparse_vectors": f"select row_id, count(*)::INT terms, sum(tf)::DOUBLE words, string_agg(tf::VARCHAR, ',' order by tf) counts, true no_index_twice from ({_POST}) group by row_id",
    "bm25_topk": _BM25 + ' select query, row_id, score, "rank" from r where "rank" <= 20',
    "hybrid_rrf": f"""select query, row_id, round(score, 8) score, "rank" from (select *, row_number() over (partition by query order by score desc, row_id)::INT "rank" from (
 select query, row_id, round(sum(s), 9) score from (
  select query, row_id, 1.0 / (60 + min("rank")) s from (select d.query // 100 query, place.row_id, d."rank" from ({_DENSE.format('').replace('q.vec_id <> k.vec_id and ', '')} select * from r where "rank" <= 20) d
   join (select min(vec_id) vec_id, chunk_id from embedded_chunks where embedding is not null group by chunk_id) f using (vec_id) join (select chunk_id, min(row_id) row_id from chunks group by 1) place using (chunk_id)) group by query, row_id
  union all select query - 1000, row_id, 1.0 / (60 + "rank") from ({_BM25} select * from r where "rank" <= 20) where (query - 1000) * 100 in (select vec_id from embedded_chunks)
 ) group by query, row_id)) where "rank" <= 20""",
    "rerank": _BM25 + f""", t as (select r.query, r.row_id, {_TERMS.format('i.text')} q, {_TERMS.format('c.content')} t from r join eval_items i on i.item_id = r.query join chunks c using (row_id) where "rank" <= 20),
 s2 as (select query, row_id, case when len(list_distinct(q)) > 0 then round(len(list_intersect(list_distinct(q), list_distinct(t))) / len(list_distinct(q)), 6) else 0.0 end score from t),
 r2 as (select *, row_number() over (partition by query order by score desc, row_id)::INT "rank" from s2) select query, row_id, score, "rank" from r2 where "rank" <= 5""",
    "context_budget": _BM25 + """ select * from (select query, row_id, "rank", sum(coalesce(token_count, 0)) over (partition by query order by "rank")::BIGINT used_tokens from r join chunks using (row_id) where "rank" <= 20) where used_tokens <= 600""",
    "retrieval_metrics": _DENSE.format("") + """, rel as (select a.vec_id query, b.vec_id from embedded_chunks a join embedded_chunks b using (chunk_id) where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 t as (select query, count(*) relevant from rel group by 1), h as (select query, count(*) hits, min("rank") f, sum(1 / log2("rank" + 1.0)) dcg from rel join (select * from r where "rank" <= 20) using (query, vec_id) group by 1)
 select query, relevant, coalesce(hits, 0) hits, round(coalesce(hits / relevant, 0.0), 6) recall, round(coalesce(1 / f, 0.0), 6) reciprocal_rank,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 20) + 1), lambda i: 1 / log2(i + 1.0))), 0.0), 6) ndcg from t left join h using (query)""",
    "citation_extract": r"select section_id, (p - 1)::INT pos, l[p] cited from (select section_id, l, unnest(range(1, len(l) + 1)) p from (select section_id, regexp_extract_all(coalesce(content, ''), '\[(\d+)\]|\b(PMC\d+)\b') l from sections))",
    "payload_build": f"select id, chunk_id, pmcid, title, journal, pub_year, section, subsection, chunk_type, token_count, metadata_header, content from ({_POINTS})",
    "payload_missing": f"select id, {_MISSING} missing from ({_POINTS}) where {_MISSING} <> ''",
    "index_new_only": f"select * from ({_NEW}) where chunk_id not in (select chunk_id from ({_OLD}))",
    "index_existing": f"select * from ({_NEW}) where chunk_id in (select chunk_id from ({_OLD}))",
    "index_upsert": f"select * from ({_OLD}) union all select * from ({_NEW}) where chunk_id not in (select chunk_id from ({_OLD}))",
    "index_upsert_force": f"select * from ({_NEW}) union all select * from ({_OLD}) where chunk_id not in (select chunk_id from ({_NEW}))",
    "index_dedup": _LAST.format("row_id", "created_at", "chunks"),
    "index_validate": f"select count(*) total_points, count(*) filter (len(embedding) <> 128) dimension_errors, count(*) filter ({_MISSING} <> '') payload_errors, (select count(*) from embedded_chunks) expected_points, count(*) = (select count(*) from embedded_chunks) and count(*) filter (len(embedding) <> 128) = 0 and count(*) filter ({_MISSING} <> '') = 0 is_valid from ({_POINTS})",
    "index_sample": f"select id, chunk_id from ({_POINTS}) order by id limit 100",
    "payload_fallback": f"""with pp as (select * from (select *, row_number() over (partition by pmcid order by ingested_at desc nulls last, record_id desc) n from papers) where n = 1),
 q as (select p.id, p.chunk_id, p.pmcid, coalesce(pp.title, '') title, coalesce(pp.journal, '') journal, pp.pub_year pub_year, coalesce(pp.article_type, '') article_type, coalesce(pp.license, '') license, p.section, p.chunk_type, p.token_count, p.content
  from ({_POINTS}) p left join pp on pp.pmcid = nullif(p.pmcid, ''))
 select id, chunk_id, pmcid, title, journal, pub_year, article_type, license, concat_ws(',', {', '.join("case when " + f + " is null or " + f + "::VARCHAR = '' then '" + f + "' end" if f != "token_count" else "case when token_count = 0 then 'token_count' end" for f in validate.REQUIRED_WITH_CONTENT)}) missing from q""",
    "embed_batches": "select vec_id, row_number() over (order by vec_id) \"position\", (row_number() over (order by vec_id) - 1) // 32 batch from embedded_chunks",
    "embed_memory": "select chunk_type, longest, round((32 * longest * 8 + 32 * longest * 768 * 4 + 32 * 768 * 4) / 1048576, 4) megabytes from (select chunk_type, max(coalesce(token_count, 0)) longest from chunks group by 1)",
    "sparse_points": f"select id, chunk_id, len(embedding)::INT entries, len(list_distinct({_TERMS.format('content')}))::INT terms, len({_TERMS.format('content')})::DOUBLE words from ({_POINTS})",
    "hybrid_search": f"""with texts as (select chunk_id, max_by(content, row_id) content from chunks where content is not null group by 1 union all select chunk_id, null from chunks group by 1 having count(content) = 0),
 pool as (select v.*, t.content text from embedded_chunks v join texts t using (chunk_id) where v.metadata.pub_year >= 2010),
 chunks as (select vec_id row_id, text content from pool), eval_items as (select * from (select vec_id item_id, {_strip('nfc_normalize(t.content)')} "text", embedding from embedded_chunks v join texts t using (chunk_id) where vec_id % 100 = 0) where "text" <> ''),
 {_BM25.removeprefix('with ').replace('r as', 'lexical as', 1)},
 v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) e from pool where embedding is not null and {_USABLE}),
 w as (select item_id query, list_transform(embedding, lambda x: x::DOUBLE) e from eval_items where embedding is not null and {_USABLE}),
 near as (select *, row_number() over (partition by query order by score desc, row_id)::INT "rank" from (select query, v.vec_id row_id, round(list_cosine_similarity(w.e, v.e), 5) score from w, v)),
 fused as (select query, row_id, round(sum(1.0 / (60 + "rank")), 9) score from (select query, row_id, "rank" from near where "rank" <= 20 union all select query, row_id, "rank" from lexical where "rank" <= 20) group by all),
 best as (select *, row_number() over (partition by query order by score desc, row_id) n from fused),
 t as (select query, row_id, {_TERMS.format('i.text')} q, {_TERMS.format('c.content')} t from best join eval_items i on i.item_id = query join chunks c using (row_id) where n <= 20),
 s2 as (select query, row_id, case when len(list_distinct(q)) > 0 then round(len(list_intersect(list_distinct(q), list_distinct(t))) / len(list_distinct(q)), 6) else 0.0 end score from t),
 r2 as (select *, row_number() over (partition by query order by score desc, row_id)::INT "rank" from s2) select query, row_id vec_id, score, "rank" from r2 where "rank" <= 5""",
    "query_texts": f"select * from (select item_id, {_strip('nfc_normalize(text)')} \"text\" from eval_items) where \"text\" <> ''",
    "sql_functions": f"""select row_id, {_ws('content')} flat, {_slug('metadata.title')} slug, {_point('chunk_id')} point, round(1.0 / (60 + row_id % 50), 9) fused,
 round(ln(1 + 997.5 / 3.5) * token_count * 2.5 / (token_count + 1.5 * (0.25 + 0.75 * length(content) / 80)), 6) weight from chunks where chunk_id <> ''""",
    "statistics_merged": "select count(*)::BIGINT chunks, sum(coalesce(token_count, 0))::BIGINT tokens from chunks",
    "resume_pending": "select distinct pmcid from chunks where pmcid not in (select metadata.pmcid from embedded_chunks where metadata.pmcid is not null)",
}

QUERIES = {
    f.__name__: f
    for f in (
        embed_norms, embed_validate, embed_report, embed_stats, embed_chunks, dense_topk, dense_topk_filtered, term_freq, doc_freq_idf, sparse_vectors,
        bm25_topk, hybrid_rrf, rerank, context_budget, retrieval_metrics, citation_extract, payload_build, payload_missing, index_new_only,
        index_existing, index_upsert, index_upsert_force, index_dedup, index_validate, resume_pending, index_sample, payload_fallback, embed_batches,
        embed_memory, sparse_points, hybrid_search, query_texts, sql_functions, statistics_merged,
    )
}
