"""Text functions as column expressions.

All but Unicode normalisation stay inside the JVM. Null and empty text give '' wherever a text is returned.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of blanks, inline citations and slugs.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
CITATION = r"(?Ud)(?:\[[\d\s\x1c-\x1f,\-]+\])|(?:\([\s\x1c-\x1f]*[A-Za-z]+.*?(?:19|20)\d{2}[\s\x1c-\x1f]*\))"
CITATION_STRICT = r"(?Ud)(?:\[[\d\s\x1c-\x1f,\-]+\])|(?:\([\s\x1c-\x1f]*[A-Za-z]+[^()]*?(?:19|20)\d{2}[\s\x1c-\x1f]*\))"
BEFORE_PUNCTUATION = r"(?U)[\s\x1c-\x1f]+([.,;:!?])"
SENTENCE_GAP = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(_c(c), BLANKS, " ")), F.lit(""))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_unicode(c: str | Column) -> Column:
    """Canonical composition. Spark has no built-in for it, so this is one Arrow call per batch."""
    return F.coalesce(_nfc(_c(c)), F.lit(""))


def strip_citations(c: str | Column, strict: bool = False) -> Column:
    """Without inline citations. ``strict`` keeps text between two brackets that the usual pattern swallows."""
    bare = F.regexp_replace(_c(c), CITATION_STRICT if strict else CITATION, "")
    return normalize_whitespace(F.regexp_replace(bare, BEFORE_PUNCTUATION, "$1"))


def clean_text(c: str | Column, strict: bool = False) -> Column:
    return normalize_whitespace(strip_citations(normalize_unicode(c), strict))


def split_sentences(c: str | Column) -> Column:
    """Pieces between sentence marks and blanks, trimmed, without blank ones."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), SENTENCE_GAP), lambda s: F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.filter(parts, lambda s: s != "")


def slugify(c: str | Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled"))


def chunk_id(pmcid: str | Column, title: str | Column, seq: str | Column) -> Column:
    return F.format_string("%s_%s_%03d", _c(pmcid), slugify(title), _c(seq))


def point_id(c: str | Column) -> Column:
    """63 bits of the SHA-256 of an id; an empty or null id is an error."""
    key = _c(c)
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("bigint").bitwiseAND(F.lit(9223372036854775807))
    return F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("a point needs a chunk id")).cast("bigint")).otherwise(number)


def metadata_header(pmcid, title, journal, year, section, subsection) -> Column:
    """Lines with what is known of a chunk; empty entries are left out, the year only if null."""
    line = lambda name, c: F.when(F.coalesce(_c(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), _c(c)))
    return F.concat_ws(
        "\n", line("PMCID", pmcid), line("Title", title), line("Journal", journal),
        F.when(_c(year).isNotNull(), F.concat(F.lit("Year: "), _c(year).cast("string"))), line("Section", section), line("Subsection", subsection),
    )


def embedding_text(header: str | Column, content: str | Column) -> Column:
    h, t = F.coalesce(_c(header), F.lit("")), F.coalesce(_c(content), F.lit(""))
    return F.when(h != "", F.concat(h, F.lit("\n\n"), t)).otherwise(t)


def strip_suffix(c: str | Column, suffix: str) -> Column:
    """File stems without the stage's suffix, only at the end."""
    return F.regexp_replace(_c(c), f"{suffix}$", "")


def search_term(query, year=None, journal=None) -> Column:
    """Search expression with its filters; missing parts are left out."""
    q = F.nullif(F.trim(_c(query)), F.lit(""))
    return F.concat_ws(
        " AND ", q, F.lit("open access[filter]"),
        F.lit(None) if year is None else F.concat(_c(year).cast("string"), F.lit("[pdat]")),
        F.lit(None) if journal is None else F.when(F.coalesce(_c(journal), F.lit("")) != "", F.concat(F.lit('"'), _c(journal), F.lit('"[journal]'))),
    )
