"""Queries that turn nested records into related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import nested
from papyrine.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = nested.flatten(table(spark, folder, "canonical_docs"))
    return nodes.select(F.col("id").alias("canon_id"), F.col("tag").alias("node_kind"), F.col("path").alias("node_path"), F.col("parent").alias("parent_path"))


def p3_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.section_rows(nested.flatten(table(spark, folder, "canonical_docs")))
    return rows.select(F.col("id").alias("canon_id"), F.col("path").alias("node_path"), F.col("parent").alias("parent_path"), "title", "content", "depth")


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.table_rows(nested.flatten(table(spark, folder, "canonical_docs")))
    return rows.withColumnRenamed("id", "canon_id").withColumnRenamed("parent", "parent_path")


QUERIES = {f.__name__: f for f in (p3_found, p3_sections, p3_tables)}



def _list(x: str) -> str:
    text = f"({x} ->> '$')"
    return (
        f"case json_type({x}) when 'ARRAY' then {x} when 'OBJECT' then json_array({x}) when 'VARCHAR' then case when not json_valid({text}) then '[]'::JSON "
        f"when json_type({text}::JSON) = 'ARRAY' then {text}::JSON when json_type({text}::JSON) = 'OBJECT' then json_array({text}::JSON) else '[]'::JSON end else '[]'::JSON end"
    )


_CHILDREN = "coalesce(obj -> '$.subsections', obj -> '$.Subsections', obj -> '$.subSections', obj -> '$.sub_sections')"
_NODES = f"""with recursive doc as (select canon_id, sections::JSON j from canonical_docs where sections is not null and json_valid(sections)),
 bare as (select canon_id, case when json_type(j) = 'OBJECT' and (j -> '$.sections') is not null and coalesce(j -> '$.title', j -> '$.content', j -> '$.subsections') is null then j -> '$.sections' else j end j from doc),
 top as (select canon_id, {_list('j')} l from bare),
 n as (select canon_id, p::VARCHAR node_path, '' parent_path, json_extract(l, '$[' || p || ']') obj, 1 depth from (select canon_id, l, unnest(range(json_array_length(l)::BIGINT)) p from top) where json_type(json_extract(l, '$[' || p || ']')) = 'OBJECT'
  union all select canon_id, parent || '.' || p, parent, json_extract(l, '$[' || p || ']'), depth + 1 from (select canon_id, node_path parent, depth, l, unnest(range(json_array_length(l)::BIGINT)) p from (select canon_id, node_path, depth, {_list(_CHILDREN)} l from n)) where json_type(json_extract(l, '$[' || p || ']')) = 'OBJECT')"""
_TABLES = """ts as (select canon_id, p - 1 pos, doc_tables[p] t from (select canon_id, doc_tables, unnest(range(1, len(doc_tables) + 1)) p from canonical_docs) where doc_tables[p] is not null),
 named as (select canon_id, lower(trim(obj ->> '$.title')) title, min(node_path) node_path, count(*) n from n where json_type(obj -> '$.title') = 'VARCHAR' group by all),
 placed as (select ts.canon_id, pos, t, coalesce(case when n = 1 then node_path end, '') parent_path from ts left join named on ts.canon_id = named.canon_id and lower(trim(t.section)) = title and title <> '')"""
ORACLES = {
    "p3_found": _NODES + ", " + _TABLES + " select canon_id, 'section' node_kind, node_path, parent_path from n union all select canon_id, 'table', pos::VARCHAR, parent_path from placed",
    "p3_sections": _NODES + " select canon_id, node_path, parent_path, obj ->> '$.title' title, obj ->> '$.content' content, depth from n",
    "p3_tables": _NODES + ", " + _TABLES + " select canon_id, pos::INT \"position\", parent_path, t.id table_id, t.caption caption, t.markdown markdown, t.section \"section\" from placed",
}
