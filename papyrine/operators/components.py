"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from papyrine.scratch import materialize, tidy


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and checksum observed while they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["s"])


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that occurs in ``links``; the component is its smallest node.

    Minima are combined on the map side, so a node with very many links costs one row per map task; the join that
    hands the minimum back is split by adaptive skew handling. Each round is written to the shared folder. Links with
    a null end are ignored; self links make a component of one node; an empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges, before = _written(edges.where("u <> v").distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, after = _written(small.where("u <> v").distinct())
        if after == before:
            break
        before = after
        tidy(edges.sparkSession)
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
