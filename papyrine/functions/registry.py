"""The text functions under their SQL names, for ``spark.sql`` users."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL = {
    "normalize_whitespace(t string) returns string": r"coalesce(trim(regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+', ' ')), '')",
    "slugify(t string) returns string": r"coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_'), '^_+|_+$', ''), ''), 'untitled')",
    "point_id(id string) returns bigint": "cast(conv(substr(sha2(id, 256), 1, 16), 16, -10) as bigint) & 9223372036854775807L",
    "rrf(rnk int, k int) returns double": "1.0D / (k + rnk)",
    "bm25(tf double, df double, n double, dl double, avgdl double) returns double": (
        "ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * dl / avgdl))"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session and return their names."""
    for head, body in SQL.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [h.partition("(")[0] for h in SQL]
