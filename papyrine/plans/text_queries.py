"""Queries over texts, chunks and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.config import Settings
from papyrine.functions import text as T
from papyrine.functions.tokens import Whitespace
from papyrine.operators import chunking, nested, stats, validate
from papyrine.operators.index import latest
from papyrine.plans.nested_queries import _NODES
from papyrine.tables import table

#: Blanks of all scripts as one RE2 class.
SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ws(x: str) -> str:
    return rf"coalesce(trim(regexp_replace({x}, '{SP}+', ' ', 'g')), '')"


def _strip(x: str) -> str:
    bare = rf"regexp_replace({x}, '(?:\[[\p{{Nd}}\t-\r\x1c-\x20\x{{a0}},\-]+\])|(?:\({SP}*[A-Za-z]+.*?(?:19|20)\p{{Nd}}{{2}}{SP}*\))', '', 'g')"
    return _ws(rf"regexp_replace({bare}, '{SP}+([.,;:!?])', '\1', 'g')")


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda w: w <> '')"


def _slug(x: str) -> str:
    return rf"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled')"


def _point(x: str) -> str:
    return f"((('0x' || sha256({x})[:16])::UBIGINT) & 9223372036854775807)::BIGINT"


def _header(m: str) -> str:
    return (
        f"concat_ws(chr(10), case when coalesce({m}.pmcid,'')<>'' then 'PMCID: '||{m}.pmcid end, case when coalesce({m}.title,'')<>'' then 'Title: '||{m}.title end, "
        f"case when coalesce({m}.journal,'')<>'' then 'Journal: '||{m}.journal end, 'Year: '||{m}.pub_year, "
        f"case when coalesce({m}.section,'')<>'' then 'Section: '||{m}.section end, case when coalesce({m}.subsection,'')<>'' then 'Subsection: '||{m}.subsection end)"
    )


BLANK = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{SP}+', ' ', 'g')) = ''"


def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", T.clean_text("content").alias("clean"))


def text_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", T.normalize_whitespace("content").alias("flat"))


def text_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_unicode("text").alias("composed"))


def citation_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row_id", T.strip_citations("content").alias("bare"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", F.posexplode(T.split_sentences("content")).alias("pos", "sentence"))
    return s.select("section_id", F.col("pos").cast("int").alias("pos"), "sentence")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row_id", Whitespace().count("content").alias("words"), Whitespace().truncate("content", 12).alias("head"))


def chunk_hard_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", F.posexplode(chunking.hard_split("content", 40)).alias("part", "words"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    s = Settings(chunk_target_tokens=64, chunk_max_tokens=80, chunk_overlap_tokens=10)
    p = table(spark, d, "sections").select("section_id", F.explode(chunking.packed("content", s=s)).alias("p"))
    return p.select("section_id", "p.seq", "p.text", "p.tokens")


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = latest(table(spark, d, "canonical_docs"), "pmcid", "parsed_at", "canon_id")
    docs = c.select("pmcid", "metadata.title", "metadata.journal", "metadata.pub_year", "abstract", "doc_tables", "figures")
    return docs, table(spark, d, "sections").select("pmcid", "ord", "section_path", "content")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, sections = _documents(spark, d)
    out = chunking.chunk_documents(docs, sections, s=Settings(chunk_target_tokens=64, chunk_max_tokens=80, chunk_overlap_tokens=10))
    return out.select("chunk_id", "chunk_type", "content", "token_count", "pmcid", "metadata_header", "branch", "ord", "seq")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("section_id", T.chunk_id("pmcid", "title", "ord").alias("chunk_id"), T.slugify("title").alias("slug"))


def chunk_id_collisions(spark: SparkSession, d: str) -> DataFrame:
    return chunking.id_collisions(chunk_documents(spark, d))


def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    m = "metadata."
    return table(spark, d, "chunks").select("row_id", T.metadata_header(*(m + c for c in ("pmcid", "title", "journal", "pub_year", "section", "subsection"))).alias("header"))


def section_metadata(spark: SparkSession, d: str) -> DataFrame:
    section, sub = chunking.section_metadata("section_path")
    return table(spark, d, "sections").select("section_id", section.alias("section"), sub.alias("subsection"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_id <> ''").select("row_id", T.point_id("chunk_id").alias("point_id"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row_id", T.embedding_text("metadata_header", "content").alias("t"))


def chunk_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row_id", F.array_join(validate.chunk_reasons(50), ",").alias("reasons"))


def chunk_validate(spark: SparkSession, d: str) -> DataFrame:
    good, _ = validate.split(table(spark, d, "chunks"), validate.chunk_reasons(50))
    return good.select("row_id", "chunk_id", "token_count")


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(table(spark, d, "chunks"), validate.chunk_reasons(50))


def document_validate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_docs")
    some = nested.emit(c, payload=False).where("tag = 'section'").select(F.col("id").alias("canon_id"), F.lit(True).alias("some")).distinct()
    c = c.join(some, "canon_id", "left")
    why = validate.document_reasons("metadata.pmcid", "metadata.title", "abstract", F.coalesce("some", F.lit(False)))
    return c.select("canon_id", F.array_join(why, ",").alias("reasons"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").withColumn("lost", F.size(validate.chunk_reasons(50)) > 0)
    return stats.document_stats(c, "lost")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(doc_stats(spark, d))


def chunk_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "chunks").groupBy("chunk_type")
        .agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"), F.count_distinct("pmcid").alias("documents"))
    )


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.size("authors").isNull() | (F.size("authors") == 0), "invalid").when(F.coalesce("doi", F.lit("")) == "", "failed").otherwise("downloaded")
    return stats.status_counts(table(spark, d, "papers").withColumn("status", status))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("record_id", T.search_term("title", "pub_year", "journal").alias("term"))


_SPLIT = rf"list_filter(list_transform(string_split(regexp_replace(coalesce(content, ''), '([.!?]){SP}+', '\1' || chr(57344), 'g'), chr(57344)), lambda s: regexp_replace(s, '^{SP}+|{SP}+$', '', 'g')), lambda s: s <> '')"


def _pack(source: str, target: int = 64, most: int = 80, overlap: int = 10) -> str:
    """Tables up to ``packed(k, seq, txt)``: the chunks of ``source(k, content)``, one step of a recursion per sentence.

    ``j`` is the first sentence held; a step closes the chunk ``a..b``, or cuts the sentence ``h``."""
    return f"""sents as (select k, {_SPLIT} s from ({source})), sized as (select k, s, list_transform(s, lambda x: len({_words('x')})) n from sents where len(s) > 0),
 pre as (select k, s, n, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT)) p from sized),
 steps as (select k, 1::BIGINT i, 1::BIGINT j, 0::BIGINT a, 0::BIGINT b, 0::BIGINT h from pre union all
  select k, i + 1, case when i > len(n) then j when n[i] > {most} then i + 1 when p[i + 1] - p[j] <= {target} or j = i then j else list_min(list_filter(range(j, i + 1), lambda x: p[i] - p[x] <= {overlap})) end,
   case when j < i and (i > len(n) or n[i] > {most} or p[i + 1] - p[j] > {target}) then j else 0 end, i - 1, case when i <= len(n) and n[i] > {most} then i else 0 end
  from steps join pre using (k) where i <= len(n) + 1),
 cut as (select k, i, {_words('s[h]')} w from steps join pre using (k) where h > 0),
 parts as (select k, i, 0::BIGINT part, array_to_string(s[a:b], ' ') txt from steps join pre using (k) where a > 0
  union all select k, i, 1 + q, array_to_string(w[q * {target} + 1 : q * {target} + {target}], ' ') from (select k, i, w, unnest(range(0, (len(w) + {target - 1}) // {target})) q from cut)),
 packed as (select k, (row_number() over (partition by k order by i, part) - 1)::INT seq, txt from parts)"""


_DOCS = "(select * from (select *, row_number() over (partition by pmcid order by parsed_at desc nulls last, canon_id desc nulls last) rn from canonical_docs) where rn = 1)"
_ROWS = f"""docs as (select pmcid, metadata.title title, metadata.journal journal, metadata.pub_year pub_year, abstract, doc_tables, figures from {_DOCS}),
 body as (select s.pmcid, docs.title, docs.journal, docs.pub_year, ord, section_path, section_id, content from sections s left join docs on s.pmcid = docs.pmcid where not {{blank_content}}),
 heads as (select 'a' || pmcid k, abstract content from docs where not {{blank_abstract}} union all select 's' || section_id, content from body),
 {{packed}},
 made as (select 'ABSTRACT' kind, pmcid, title, journal, pub_year, 0 branch, 0 ord, seq, txt, ['Abstract'] path, 'abstract' slug from packed join docs on k = 'a' || pmcid
  union all select 'TEXT', pmcid, title, journal, pub_year, 1, ord, seq, txt, section_path, coalesce(section_path[-1], '') from packed join body on k = 's' || section_id
  union all select 'TABLE', pmcid, title, journal, pub_year, 2, p - 1, p - 1, concat_ws(chr(10) || chr(10), nullif(trim(doc_tables[p].caption), ''), doc_tables[p].markdown),
   [coalesce(nullif(doc_tables[p].section, ''), 'Tables')], coalesce(doc_tables[p].id, 'table_' || (p - 1)) from (select *, unnest(range(1, len(doc_tables) + 1)) p from docs) where trim(coalesce(doc_tables[p].markdown, '')) <> ''
  union all select 'FIGURE_CAPTION', pmcid, title, journal, pub_year, 3, p - 1, p - 1, trim(figures[p].caption), ['Figures'], coalesce(figures[p].id, 'fig_' || (p - 1)) from (select *, unnest(range(1, len(figures) + 1)) p from docs) where trim(coalesce(figures[p].caption, '')) <> ''),
 filed as (select *, coalesce(path[1], '') section, case when len(path) > 1 then coalesce(path[-1], '') else '' end subsection from made),
 chunked as (select format('{{{{}}}}_{{{{}}}}_{{{{:03d}}}}', pmcid, {{slug}}, seq::INT) chunk_id, kind chunk_type, txt content, len({{words}})::INT token_count, pmcid, {{header}} metadata_header, branch::INT branch, ord::INT ord, seq::INT seq from filed)"""
_CHUNKED = "with recursive " + _ROWS.format(
    blank_content=BLANK("content"), blank_abstract=BLANK("abstract"), packed=_pack("select k, content from heads"), slug=_slug("slug"), words=_words("txt"), header=_header("filed")
)
_REASONS = (
    f"concat_ws(',', case when {BLANK('content')} then 'empty_content' end, case when coalesce(token_count, 0) < 50 then 'below_min_tokens' end, "
    f"case when {BLANK('metadata.pmcid')} then 'missing_pmcid' end, case when {BLANK('metadata.section')} and {BLANK('metadata.chunk_type')} then 'missing_section_and_type' end, "
    f"case when {BLANK('metadata.chunk_type')} then 'missing_chunk_type' end)"
)
_DOC_STATS = f"""select pmcid, count(*) total_chunks, count(*) filter ({_REASONS} <> '') rejected_chunks,
 count(*) filter (chunk_type = 'TEXT') text_chunks, count(*) filter (chunk_type = 'TABLE') table_chunks, count(*) filter (chunk_type = 'ABSTRACT') abstract_chunks,
 count(*) filter (chunk_type = 'FIGURE_CAPTION') figure_caption_chunks, max(coalesce(token_count, 0)) largest_chunk, min(coalesce(token_count, 0)) smallest_chunk,
 sum(coalesce(token_count, 0))::BIGINT total_tokens from chunks group by pmcid"""

ORACLES = {
    "text_clean": f"select section_id, {_strip('nfc_normalize(content)')} clean from sections",
    "text_whitespace": f"select section_id, {_ws('content')} flat from sections",
    "text_nfc": "select doc_id, coalesce(nfc_normalize(text), '') composed from documents",
    "citation_strip": f"select row_id, {_strip('content')} bare from chunks",
    "sentence_split": f"select section_id, (p - 1)::INT pos, l[p] sentence from (select section_id, l, unnest(range(1, len(l) + 1)) p from (select section_id, {_SPLIT} l from sections))",
    "token_counts": f"select row_id, len({_words('content')})::INT words, array_to_string(({_words('content')})[1:12], ' ') head from chunks",
    "chunk_hard_split": f"select section_id, p::INT part, array_to_string(w[p * 40 + 1 : p * 40 + 40], ' ') words from (select section_id, w, unnest(range(0, (len(w) + 39) // 40)) p from (select section_id, {_words('content')} w from sections))",
    "chunk_pack": f"with recursive {_pack('select section_id k, content from sections')} select k section_id, seq, txt \"text\", len({_words('txt')})::INT tokens from packed",
    "chunk_documents": _CHUNKED + " select * from chunked",
    "chunk_ids": f"select section_id, format('{{}}_{{}}_{{:03d}}', pmcid, {_slug('title')}, ord) chunk_id, {_slug('title')} slug from sections",
    "chunk_id_collisions": _CHUNKED + ' select chunk_id, count(distinct content) contents, count(*) "rows" from chunked group by chunk_id having count(distinct content) > 1',
    "chunk_headers": f"select row_id, {_header('metadata')} header from chunks",
    "section_metadata": "select section_id, coalesce(section_path[1], '') section, case when len(section_path) > 1 then coalesce(section_path[-1], '') else '' end subsection from sections",
    "point_ids": f"select row_id, {_point('chunk_id')} point_id from chunks where chunk_id <> ''",
    "embedding_texts": "select row_id, case when coalesce(metadata_header, '') <> '' then metadata_header || chr(10) || chr(10) || coalesce(content, '') else coalesce(content, '') end t from chunks",
    "chunk_reject_reasons": f"select row_id, {_REASONS} reasons from chunks",
    "chunk_validate": f"select row_id, chunk_id, token_count from chunks where {_REASONS} = ''",
    "chunk_report": f"select reason, count(*) n from (select unnest(string_split({_REASONS}, ',')) reason from chunks) where reason <> '' group by 1 union all select case when r = '' then 'valid' else 'rejected' end, count(*) from (select {_REASONS} r from chunks) group by 1",
    "document_validate": _NODES + f""" select canon_id, concat_ws(',', case when {BLANK('metadata.pmcid')} then 'missing_pmcid' end, case when {BLANK('metadata.title')} then 'missing_title' end,
 case when canon_id not in (select canon_id from n) and {BLANK('abstract')} then 'missing_sections_and_abstract' end) reasons from canonical_docs""",
    "doc_stats": _DOC_STATS,
    "corpus_stats": f"""select count(*) documents, sum(total_chunks)::BIGINT total_chunks, sum(rejected_chunks)::BIGINT rejected_chunks, sum(text_chunks)::BIGINT text_chunks, sum(table_chunks)::BIGINT table_chunks,
 sum(abstract_chunks)::BIGINT abstract_chunks, sum(figure_caption_chunks)::BIGINT figure_caption_chunks, max(largest_chunk) largest_chunk, min(nullif(smallest_chunk, 0)) smallest_chunk, sum(total_tokens)::BIGINT total_tokens,
 round(sum(total_tokens) / sum(total_chunks), 2) average_tokens from ({_DOC_STATS})""",
    "chunk_type_stats": "select chunk_type, count(*) n, sum(token_count)::BIGINT tokens, max(token_count) largest, count(distinct pmcid) documents from chunks group by 1",
    "status_counts": "select case when authors is null or len(authors) = 0 then 'invalid' when coalesce(doi, '') = '' then 'failed' else 'downloaded' end status, count(*) n from papers group by 1",
    "search_terms": "select record_id, concat_ws(' AND ', nullif(trim(title), ''), 'open access[filter]', pub_year || '[pdat]', case when coalesce(journal, '') <> '' then '\"' || journal || '\"[journal]' end) term from papers",
}

QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_whitespace, text_nfc, citation_strip, sentence_split, token_counts, chunk_hard_split, chunk_pack, chunk_documents, chunk_ids,
        chunk_id_collisions, chunk_headers, section_metadata, point_ids, embedding_texts, chunk_reject_reasons, chunk_validate, chunk_report,
        document_validate, doc_stats, corpus_stats, chunk_type_stats, status_counts, search_terms,
    )
}
