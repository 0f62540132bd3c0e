"""Validators that return data, not exceptions: each row gets its list of reasons, empty if valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.vectors import norm

# Fields a payload must have, without and with its content.
REQUIRED = ("chunk_id", "pmcid", "title", "section", "chunk_type", "token_count")
REQUIRED_WITH_CONTENT = (*REQUIRED, "content")


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")) == ""


def reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))


def chunk_reasons(min_tokens: int, content="content", tokens="token_count", pmcid="metadata.pmcid", section="metadata.section", kind="metadata.chunk_type") -> Column:
    """Why a chunk is rejected, in fixed order. A null token count counts as 0."""
    return reasons(
        (_blank(content), "empty_content"),
        (F.coalesce(F.col(tokens), F.lit(0)) < min_tokens, "below_min_tokens"),
        (_blank(pmcid), "missing_pmcid"),
        (_blank(section) & _blank(kind), "missing_section_and_type"),
        (_blank(kind), "missing_chunk_type"),
    )


def vector_reasons(vec: str, dim: int, tolerance: float = 1e-3) -> Column:
    """Why a vector is no unit vector of ``dim`` finite entries. An empty or null one has only that reason."""
    v = F.col(vec)
    bad = lambda test: F.coalesce(F.exists(v, test), F.lit(False))
    nan = bad(lambda x: F.isnan(x) | x.isNull())
    inf = bad(lambda x: F.abs(x) == float("inf"))
    empty = v.isNull() | (F.size(v) == 0)
    length = norm(vec)
    return F.when(empty, F.array(F.lit("empty_embedding"))).otherwise(reasons(
        (F.size(v) != dim, "wrong_dimension"), (nan, "contains_nan"), (inf, "contains_inf"),
        (~nan & ~inf & (F.abs(length - 1) > tolerance), "non_unit_norm"),
    ))


def document_reasons(pmcid="pmcid", title="title", abstract="abstract", sections: Column | None = None) -> Column:
    """A document needs an id, a title, and sections or an abstract."""
    has_sections = F.lit(False) if sections is None else sections
    return reasons((_blank(pmcid), "missing_pmcid"), (_blank(title), "missing_title"), (~has_sections & _blank(abstract), "missing_sections_and_abstract"))


def payload_missing(fields: tuple[str, ...] = REQUIRED_WITH_CONTENT, zero_is_missing: bool = False) -> Column:
    """Names of required fields that are null or '' (or 0 with ``zero_is_missing``)."""
    checks = []
    for f in fields:
        lost = F.col(f).isNull() | (F.col(f).cast("string") == "")
        if zero_is_missing and f == "token_count":
            lost = lost | (F.col(f) == 0)
        checks.append((lost, f))
    return reasons(*checks)


def split(df: DataFrame, why: Column, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons."""
    checked = df.withColumn(name, why)
    return checked.where(F.size(name) == 0).drop(name), checked.where(F.size(name) > 0)


def report(df: DataFrame, why: Column) -> DataFrame:
    """Rows per reason, and the totals under the reasons 'valid' and 'rejected'."""
    flat = df.select(why.alias("r"))
    each = flat.select(F.explode("r").alias("reason"))
    totals = flat.select(F.when(F.size("r") == 0, "valid").otherwise("rejected").alias("reason"))
    return each.unionByName(totals).groupBy("reason").agg(F.count("*").alias("n"))


def index_report(points: DataFrame, expected: int | None, dim: int) -> DataFrame:
    """One row: points, expected points, wrong dimensions, incomplete payloads, and whether all is well. The whole
    collection is scanned, not a sample."""
    missing = payload_missing()
    out = points.agg(
        F.count("*").alias("total_points"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) != dim).alias("dimension_errors"), F.count_if(F.size(missing) > 0).alias("payload_errors"),
    ).withColumn("expected_points", F.lit(expected).cast("bigint"))
    ok = (F.coalesce(F.col("expected_points"), F.col("total_points")) == F.col("total_points")) & (F.col("dimension_errors") == 0) & (F.col("payload_errors") == 0)
    return out.withColumn("is_valid", ok)
