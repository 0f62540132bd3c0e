"""Queries over article XML. The tables hold no XML, so it is composed from papers and documents first; the expected
result is then plain SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.config import Settings
from papyrine.operators import articles
from papyrine.operators.index import Collection, latest
from papyrine.plans.pipelines import Run
from papyrine.plans.text_queries import _strip, _words
from papyrine.scratch import new_path
from papyrine.sources.files import stage_table
from papyrine.tables import table


def _escaped(c) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, c, attr: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attr}>"), _escaped(c), F.lit(f"</{name}>"))


def jats(spark: SparkSession, d: str) -> DataFrame:
    """``(key, pmcid, xml)`` of every paper. Every 7th lacks its id, every 11th its abstract, every 13th is cut short,
    every 17th has a document type, every 19th is empty."""
    p = table(spark, d, "papers")
    a = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda n: F.concat(
        F.lit('<contrib contrib-type="author"><name>'), _tag("surname", F.regexp_extract(F.coalesce(n, F.lit("")), r"(\S*)\s*$", 1)),
        _tag("given-names", F.regexp_extract(F.coalesce(n, F.lit("")), r"^(.*?)\s*\S*\s*$", 1)), F.lit("</name></contrib>"))), "")
    k = F.array_join(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: _tag("kwd", w)), "")
    rid = F.col("record_id")
    sec = F.concat(F.lit("<sec><title>Methods</title>"), _tag("p", "title"), F.lit("<sec><title>Data</title>"), _tag("p", "journal"), F.lit('<table-wrap id="T1"><caption>'), _tag("p", "title"), F.lit("</caption><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>"), rid.cast("string"), F.lit("</td><td>x|y</td></tr></tbody></table></table-wrap></sec><fig"), F.when(rid % 2 == 0, F.concat(F.lit(' id="F'), rid.cast("string"), F.lit('"'))).otherwise(""), F.lit("><caption>"), _tag("p", "journal"), F.lit("</caption></fig></sec>"))
    xml = F.concat(
        F.when(rid % 17 == 0, '<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//NLM//DTD" "JATS.dtd">').otherwise(""),
        F.lit('<article article-type="'), _escaped("article_type"), F.lit('"><front><journal-meta>'), _tag("journal-title", "journal"), F.lit("</journal-meta><article-meta>"),
        F.when(rid % 7 == 0, "").otherwise(_tag("article-id", F.replace("pmcid", F.lit("PMC"), F.lit("")), ' pub-id-type="pmc"')),
        _tag("article-id", "doi", ' pub-id-type="doi"'), F.lit("<title-group>"), _tag("article-title", "title"), F.lit("</title-group><contrib-group>"), a,
        F.lit('</contrib-group><pub-date pub-type="ppub"><year>n.d.</year></pub-date>'),
        F.when(F.col("pub_year").isNull(), "").otherwise(F.concat(F.lit('<pub-date pub-type="epub"><year>'), F.col("pub_year").cast("string"), F.lit("</year></pub-date>"))),
        F.lit('<permissions><license xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="'), _escaped("license"), F.lit('"/></permissions>'),
        F.when(rid % 11 == 0, "").otherwise(F.concat(F.lit("<abstract>"), _tag("p", "title"), F.lit("</abstract>"))),
        F.lit("<kwd-group>"), k, F.lit("</kwd-group></article-meta></front><body>"), sec, F.lit("</body><back><ref-list>"), _tag("ref", "doi"), F.lit("</ref-list></back></article>"),
    )
    xml = F.when(rid % 19 == 0, "").when(rid % 13 == 0, F.left(xml, F.length(xml) - 40)).otherwise(xml)
    return p.select(F.concat_ws("/", "pmcid", rid.cast("string")).alias("key"), "pmcid", "record_id", xml.alias("xml"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return articles.parse(jats(spark, d), keep=("record_id",))


def xml_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _parsed(spark, d).where("metadata is not null")
    return m.select("record_id", "metadata.doi", "metadata.title", F.array_join("metadata.authors", "; ").alias("authors"), "metadata.journal", "metadata.pub_year", F.array_join("metadata.keywords", "; ").alias("keywords"), "metadata.article_type", "metadata.license")


def xml_sections(spark: SparkSession, d: str) -> DataFrame:
    s = _parsed(spark, d).select("record_id", F.explode("sections").alias("s"))
    return s.select("record_id", "s.ord", "s.depth", F.array_join("s.section_path", " > ").alias("path"), "s.title", "s.content")


def xml_tables_markdown(spark: SparkSession, d: str) -> DataFrame:
    t = _parsed(spark, d).select("record_id", F.explode("doc_tables").alias("t"))
    return t.select("record_id", "t.id", "t.section", "t.markdown")


def xml_validate(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings per record."""
    return _parsed(spark, d).select("record_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def xml_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Abstract, references and well-formedness of every record that can be read."""
    return _parsed(spark, d).where("metadata is not null").select("record_id", "metadata.pmcid", "abstract", F.array_join("refs", " | ").alias("refs"), "well_formed")


def xml_figures(spark: SparkSession, d: str) -> DataFrame:
    f = _parsed(spark, d).select("record_id", F.posexplode("figures").alias("pos", "f"))
    return f.select("record_id", "pos", "f.id", "f.caption")


def bytes_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored as UTF-8, every second one that allows it as Latin-1, read back from their bytes."""
    latin = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x00-\xff]*$")
    b = table(spark, d, "documents").where("text is not null").withColumn("content", F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")))
    return b.select("doc_id", articles.decode("content").alias("text"))


def stages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every stage and of its quarantine after a full run over the last record of each paper, with words as tokens."""
    raw = latest(jats(spark, d).join(table(spark, d, "papers").select("record_id", "ingested_at"), "record_id"), "pmcid", "ingested_at", "record_id")
    run = Run(spark, Settings(data_dir=new_path(spark, "stages"), chunk_min_tokens=3, embedding_dim=64))
    run.ingest(raw.select("pmcid"), raw.select("pmcid", "xml"))
    run.parse()
    run.chunk()
    run.embed()
    run.index()
    out = None
    for stage in ("raw", "quarantine/raw", "canonical", "quarantine/canonical", "chunks", "quarantine/chunks", "embeddings"):
        t = stage_table(spark, run.path(stage))
        n = spark.range(1).select(F.lit(stage).alias("stage"), F.lit(0).cast("bigint").alias("n")) if t is None else t.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    points = Collection(spark, run.path("index"), run.settings.collection_name, 64).points()
    return out.unionByName(points.agg(F.count("*").alias("n")).select(F.lit("index").alias("stage"), "n"))


def xml_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Records that no document can be made of."""
    _, bad = articles.route(_parsed(spark, d))
    return bad.select("record_id")


_FULL = "record_id % 19 <> 0"
_T = r"trim(regexp_replace(coalesce({}, ''), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"
_C = {c: _strip(f"nfc_normalize({c})") for c in ("title", "journal")}
_ERRORS = f"concat_ws(',', case when record_id % 7 = 0 then 'missing_pmcid' end, case when {_T.format('title')} = '' then 'missing_title' end)"
_LAST = "(select * from (select *, row_number() over (partition by pmcid order by ingested_at desc nulls last, record_id desc) n from papers) where n = 1)"

ORACLES = {
    "xml_metadata": f"""select record_id, {_T.format('doi')} doi, {_T.format('title')} title, array_to_string(list_filter(list_transform(authors, lambda n: {_T.format('n')}), lambda n: n <> ''), '; ') authors,
 {_T.format('journal')} journal, pub_year, array_to_string(list_filter(list_transform(coalesce(keywords, []), lambda n: {_T.format('n')}), lambda n: n <> ''), '; ') keywords, coalesce(article_type, '') article_type, coalesce(license, '') license
 from (select * replace (coalesce(authors, []) as authors) from papers) where {_FULL}""",
    "xml_sections": f"""select record_id, o::INT ord, o::INT depth, case when o = 0 then 'Methods' else 'Methods > Data' end path, case when o = 0 then 'Methods' else 'Data' end title, case when o = 0 then {_C["title"]} else {_C["journal"]} end content
 from papers, (select unnest([0, 1]) o) where {_FULL} and ({_C["journal"]} <> '' or o = 0 and {_C["title"]} <> '')""",
    "xml_tables_markdown": f"select record_id, 'T1' id, 'Data' section, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || record_id || ' | x\\|y |' markdown from papers where {_FULL}",
    "xml_validate": f"""select record_id, case when not {_FULL} then 'empty_file' else concat_ws(',', case when record_id % 7 = 0 then 'missing_pmcid' end, case when {_T.format('title')} = '' then 'missing_title' end) end errors,
 case when {_FULL} and (record_id % 11 = 0 or {_T.format('title')} = '') then 'missing_abstract' else '' end warnings from papers""",
    "xml_abstracts": f"""select record_id, pmcid, case when record_id % 11 = 0 then '' else {_C["title"]} end abstract, case when record_id % 13 = 0 then left({_T.format('doi')}, greatest(len({_T.format('doi')}) - 6, 0)) else {_T.format('doi')} end refs, record_id % 13 <> 0 well_formed from papers where {_FULL}""",
    "xml_figures": f"select record_id, 0 pos, case when record_id % 2 = 0 then 'F' || record_id else 'fig_0' end id, {_C["journal"]} caption from papers where {_FULL}",
    "bytes_decoded": "select doc_id, text from documents where text is not null",
    "stages": f"""with p as (select record_id, {_FULL} and {_ERRORS} = '' good, {_FULL} readable, case when record_id % 11 = 0 then '' else {_C["title"]} end abstract, {_C["title"]} title, {_C["journal"]} journal from {_LAST}),
 ok as (select * from p where good), c as (select record_id, abstract content from ok union all select record_id, title from ok union all select record_id, journal from ok
  union all select record_id, title || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || record_id || ' | x\\|y |' from ok union all select record_id, journal from ok),
 n as (select count(*) filter (content <> '' and len({_words('content')}) >= 3) kept, count(*) filter (content <> '' and len({_words('content')}) < 3) lost from c)
 select 'raw' stage, count(*) n from ok union all select 'quarantine/raw', count(*) from p where not good union all select 'canonical', count(*) from ok union all select 'quarantine/canonical', 0
 union all select 'chunks', kept from n union all select 'quarantine/chunks', lost from n union all select 'embeddings', kept from n union all select 'index', kept from n""",
    "xml_quarantine": f"select record_id from papers where not ({_FULL}) or {_T.format('title')} = ''",
}

QUERIES = {f.__name__: f for f in (xml_metadata, xml_sections, xml_tables_markdown, xml_validate, xml_quarantine, xml_abstracts, xml_figures, bytes_decoded, stages)}
