"""Chunks of articles: greedy packing of sentences under a token budget, tables and figures as blocks of their own.

A section never shares a chunk with another one. Sentences are added while the budget holds; a full chunk is emitted
and the next one begins with the trailing sentences of the last that fit the overlap; a sentence above the hard limit
is flushed and cut into parts of the target size. Null and blank texts give no chunks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.config import Settings
from papyrine.functions import text as T
from papyrine.functions.tokens import Whitespace

GAP = re.compile(r"(?<=[.!?])\s+")
PACKED = "array<struct<seq:int,text:string,tokens:int>>"


def hard_parts(pieces: list, target: int) -> list[list]:
    return [pieces[i : i + target] for i in range(0, len(pieces), target)]


def pack(text: str | None, counter, target: int, most: int, overlap: int) -> list[tuple[int, str, int]]:
    """``(seq, text, tokens)`` of one block."""
    sentences = [s for s in (p.strip() for p in GAP.split(text or "")) if s]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    size = 0  # sum of the sentences' tokens; behind an overlap, the tokens of the joined text

    def flush() -> None:
        if held:
            out.append(" ".join(s for s, _ in held))

    for s in sentences:
        pieces = counter.split(s)
        n = len(pieces)
        if n > most:
            flush()
            held, size = [], 0
            out += [p for p in (counter.join(part) for part in hard_parts(pieces, target)) if p]
        elif size + n <= target or not held:
            held.append((s, n))
            size += n
        else:
            flush()
            tail: list[tuple[str, int]] = []
            room = overlap
            for item in reversed(held):
                if item[1] > room:
                    break
                tail.insert(0, item)
                room -= item[1]
            held = [*tail, (s, n)]
            size = len(counter.split(" ".join(t for t, _ in held)))
    flush()
    return [(i, t, len(counter.split(t))) for i, t in enumerate(out)]


def packed(c: str | Column, counter=None, s: Settings = Settings()) -> Column:
    """Chunks of a text column, by one Arrow call per batch."""
    counter = counter or Whitespace()
    target, most, overlap = s.chunk_target_tokens, s.chunk_max_tokens, s.chunk_overlap_tokens

    @F.pandas_udf(PACKED)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"seq": a, "text": b, "tokens": n} for a, b, n in pack(t, counter, target, most, overlap)])

    return run(T._c(c))


def hard_split(c: str | Column, size: int) -> Column:
    """Consecutive parts of ``size`` words, inside the JVM."""
    words = Whitespace()._words(c)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / size) - 1, F.lit(0)).cast("int"))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i * size + 1, size), " ")), lambda p: p != "")


def section_metadata(path: str | Column = "section_path") -> tuple[Column, Column]:
    """First and last name of a section path; no subsection for a path of one."""
    p = T._c(path)
    first = F.when(F.size(p) > 0, p[0]).otherwise("")
    last = F.when(F.size(p) > 1, F.element_at(p, -1)).otherwise("")
    return F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))


def _finish(df: DataFrame, kind: str, path: Column, slug: Column, counter) -> DataFrame:
    """Rows ``(pmcid, title, journal, pub_year, branch, ord, seq, content, tokens)`` to chunk rows."""
    section, sub = section_metadata(path)
    d = df.withColumn("section_path", path).withColumn("section", section).withColumn("subsection", sub)
    header = T.metadata_header("pmcid", "title", "journal", "pub_year", "section", "subsection")
    meta = F.struct("pmcid", "title", "journal", "pub_year", "section", "subsection", "section_path", F.lit(kind).alias("chunk_type"), F.col("tokens").alias("token_count"))
    return d.select(
        T.chunk_id("pmcid", slug, "seq").alias("chunk_id"), F.lit(kind).alias("chunk_type"), "content", F.col("tokens").alias("token_count"),
        "pmcid", meta.alias("metadata"), header.alias("metadata_header"), "branch", "ord", "seq",
    )


def chunk_documents(docs: DataFrame, sections: DataFrame, counter=None, s: Settings = Settings(), disambiguate: bool = False) -> DataFrame:
    """All chunks of ``docs(pmcid, title, journal, pub_year, abstract, doc_tables, figures)`` and
    ``sections(pmcid, ord, section_path, content)``: abstract, sections, tables and figures in this order.

    Sections that carry title, journal and year themselves are not joined. A section without a document is kept, with an
    empty header but its pmcid. ``docs`` has one row per pmcid.

    Chunk ids follow the section's own title, so equal titles collide; ``disambiguate`` adds the section's position.
    """
    counter = counter or Whitespace()
    doc = ["pmcid", "title", "journal", "pub_year"]

    def blocks(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("p", F.explode(packed(text, counter, s))).withColumns({"seq": F.col("p.seq"), "content": F.col("p.text"), "tokens": F.col("p.tokens")})

    d = docs.select(*doc, "abstract").where(F.coalesce(T.normalize_whitespace("abstract"), F.lit("")) != "")
    abstract = blocks(d, "abstract").withColumn("branch", F.lit(0)).withColumn("ord", F.lit(0))
    body = sections.where(F.coalesce(T.normalize_whitespace("content"), F.lit("")) != "").withColumnRenamed("content", "body")
    if not set(doc) <= set(sections.columns):
        body = body.select("pmcid", "ord", "section_path", "body").join(docs.select(*doc), "pmcid", "left")
    body = blocks(body, "body").withColumn("branch", F.lit(1))
    name = F.coalesce(F.element_at("section_path", -1), F.lit(""))
    slug = F.concat_ws("_", name, F.col("ord").cast("string")) if disambiguate else name
    tables = docs.select(*doc, F.posexplode("doc_tables").alias("ord", "t")).where(F.trim(F.coalesce("t.markdown", F.lit(""))) != "")
    content = F.concat_ws("\n\n", F.nullif(F.trim("t.caption"), F.lit("")), F.col("t.markdown"))
    tables = tables.withColumns({"seq": F.col("ord"), "content": content, "branch": F.lit(2)}).withColumn("tokens", counter.count("content"))
    figures = docs.select(*doc, F.posexplode("figures").alias("ord", "f")).where(F.trim(F.coalesce("f.caption", F.lit(""))) != "")
    figures = figures.withColumns({"seq": F.col("ord"), "content": F.trim("f.caption"), "branch": F.lit(3)}).withColumn("tokens", counter.count("content"))
    in_section = F.when(F.coalesce("t.section", F.lit("")) != "", F.array("t.section")).otherwise(F.array(F.lit("Tables")))
    parts = [
        _finish(abstract, "ABSTRACT", F.array(F.lit("Abstract")), F.lit("abstract"), counter),
        _finish(body, "TEXT", F.col("section_path"), slug, counter),
        _finish(tables, "TABLE", in_section, F.coalesce("t.id", F.concat(F.lit("table_"), F.col("ord"))), counter),
        _finish(figures, "FIGURE_CAPTION", F.array(F.lit("Figures")), F.coalesce("f.id", F.concat(F.lit("fig_"), F.col("ord"))), counter),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def id_collisions(chunks: DataFrame) -> DataFrame:
    """Chunk ids given to different contents."""
    return chunks.groupBy("chunk_id").agg(F.count_distinct("content").alias("contents"), F.count("*").alias("rows")).where("contents > 1")


