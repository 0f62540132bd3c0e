"""Mixtures of sources with target shares of all tokens, by systematic sampling.

The total of a mix is the largest one that every usable source can supply within its repeats, so that every source
reaches its share (or a given total). Within a source each text has the same expected number of copies, its source's
share of the total over the source's tokens. Expected copies are summed along the source, one random offset is added,
and a text is emitted once per integer that its interval crosses. Texts run in the order of their length class, so the
shares hit the targets closely, and of a hash inside it.

Prefix sums are taken in two levels: texts are counted per source and slot (a length class and a hash), slots are summed
over a table of bounded size, and positions inside a slot come from a window over that slot alone. A source with most of
all rows is thereby spread over all its slots.

Defined results
* Sources are compared under one spelling (lower case, blanks trimmed, '-' and ' ' as '_'); texts without a source,
  null texts and texts without tokens are in no mix.
* A null weight counts as 0 and takes no part; a null or non-positive max_repeats counts as 1. Targets are relative to
  the sum of the weights of the sources that have texts; sources without texts are reported with target and nothing
  reached. Repeated rows of one mix and source: weights are summed, the larger max_repeats holds.
* No text is emitted more often than max_repeats; copies under another id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.tokens import _encoding
from papyrine.scratch import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[- ]+", "_"), F.lit(""))


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["id", "source", "tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)`` of texts with a source."""
    import public_tokenizers

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), source_name(source).alias("source"), F.col(text).alias("t"))
    rows = rows.where("id is not null and source is not null and t is not null")
    return rows.mapInArrow(_count(tokenizer, public_tokenizers.PATTERN), "id bigint, source string, tokens bigint").where("tokens > 0")


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(mix_id, source, target, repeats, docs, tokens, copies_each, total)``: one row per mix and named source."""
    t = (
        targets.select("mix_id", source_name("source").alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), "max_repeats")
        .where("mix_id is not null and source is not null")
        .groupBy("mix_id", "source").agg(F.sum("w").alias("w"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("repeats"))
        .where("w > 0")
    )
    sizes = counts.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    w = Window.partitionBy("mix_id")
    p = t.join(sizes, "source", "left").withColumn("usable", F.when(F.col("tokens").isNotNull(), F.col("w")))
    p = p.withColumn("target", F.coalesce(F.try_divide("usable", F.sum("usable").over(w)), F.lit(0.0)))
    most = F.min(F.try_divide(F.col("repeats") * F.col("tokens"), F.nullif("target", F.lit(0.0)))).over(w)
    p = p.withColumn("total", most if total_tokens is None else F.lit(float(total_tokens)))
    each = F.least(F.try_divide(F.col("total") * F.col("target"), "tokens"), F.col("repeats").cast("double"))
    return p.select("mix_id", "source", "w", "target", "repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(each, F.lit(0.0)).alias("copies_each"), "total")


def _offset(seed: int) -> Column:
    """One number in [0, 1) per mix and source."""
    return F.pmod(F.xxhash64("mix_id", "source", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0


def mixture(counts: DataFrame, planned: DataFrame, seed: int = 17, slots: int | None = None, slot_rows: int = 50_000) -> DataFrame:
    """``(mix_id, id, source, tokens, copies)`` of the texts that a mix holds.

    A slot is a range of hash values; there are so many of them that it holds about ``slot_rows`` texts even where one
    source and length class has all of them. The order, and so the result, does not depend on their number.
    """
    slots = slots or max(64, counts.count() // slot_rows)
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 34)  # 30 bits
    place = F.floor(hashed * F.lit(slots) / (1 << 30))
    placed = counts.withColumn("hashed", hashed).withColumn("slot", (F.floor(F.log2(F.col("tokens") + 1)) * slots + place).cast("bigint"))
    per_slot = placed.groupBy("source", "slot").agg(F.count("*").alias("n"))  # length classes times slots rows per source
    before = per_slot.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("source", "slot").orderBy("hashed", "id"))
    at = placed.join(before.select("source", "slot", F.coalesce("before", F.lit(0)).alias("before")), ["source", "slot"]).withColumn("nth", nth + F.col("before"))
    use = planned.where("copies_each > 0").select("mix_id", "source", "copies_each", "repeats", _offset(seed).alias("u"))
    rows = at.join(F.broadcast(use), "source")  # one row per mix and named source
    upto = lambda n: F.floor(n * F.col("copies_each") + F.col("u") + 1e-9)
    copies = F.least(upto(F.col("nth")) - upto(F.col("nth") - 1), F.col("repeats")).cast("int")
    return rows.select("mix_id", "id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and reached share of every named source of every mix."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    out = planned.join(got, ["mix_id", "source"], "left")
    reached = F.coalesce("reached_tokens", F.lit(0))
    return out.select(
        "mix_id", "source", F.round("target", 6).alias("target_share"), reached.alias("reached_tokens"),
        F.round(F.coalesce(F.try_divide(reached, F.sum(reached).over(Window.partitionBy("mix_id"))), F.lit(0.0)), 6).alias("reached_share"),
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "repeats",
    )


def prepare(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Token counts, written once, and the plan."""
    counts = materialize(token_counts(docs, doc_id, text, source, tokenizer), "tokens")
    return counts, plan(counts, targets, total_tokens)
