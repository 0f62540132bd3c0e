"""Embedding of chunk rows through pluggable models.

A model is loaded once per worker and called batch by batch on Arrow data; chunk rows are never grouped into documents,
so a document of any size is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import text as T


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words, scaled to unit length: deterministic and without a model file."""

    def __init__(self, dim: int = 768):
        self.name, self.dim = f"hashing-{dim}", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        known = {w: i for i, w in enumerate({w for ws in words for w in ws})}  # each word is hashed once
        h = np.array([int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for w in known], np.int64)
        at = np.array([known[w] for ws in words for w in ws], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        out = np.bincount(row * self.dim + h[at] % self.dim, np.where(h[at] >> 31, 1.0, -1.0), len(texts) * self.dim).reshape(len(texts), self.dim) if len(at) else np.zeros((len(texts), self.dim))
        size = np.linalg.norm(out, axis=1)
        out[size == 0, 0] = 1.0
        size[size == 0] = 1.0
        return (out / size[:, None]).astype(np.float32)


MODELS: dict[str, Callable[[int], Embedder]] = {"hashing": HashingEmbedder}


def embed(chunks: DataFrame, model: str = "hashing", dim: int = 768, batch: int = 32, on: str | None = None) -> DataFrame:
    """``(chunk_id, embedding, metadata, metadata_header, content, embedding_model, embedding_dimension, generated_at)``.

    Models with a method ``to`` are put on the device ``on``, or the one that Spark has assigned. Chunks whose text is blank
    are skipped. The content is carried along for the sparse index.
    """
    if batch <= 0:
        raise ValueError("the batch size must be positive")
    rows = chunks.select("chunk_id", "metadata", "metadata_header", "content", T.embedding_text("metadata_header", "content").alias("t"))
    rows = rows.where(T.normalize_whitespace("t") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = MODELS[model](dim)
        if hasattr(m, "to"):
            m.to(device(on))
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                b = whole.slice(s, batch)
                x = m.encode(b.column(4).to_pylist())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.dim)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*b.schema.names[:4], "embedding"])

    kept = rows.schema["metadata"].dataType.simpleString()
    out = rows.mapInArrow(run, f"chunk_id string, metadata {kept}, metadata_header string, content string, embedding array<float>")
    return out.withColumn("embedding_model", F.lit(MODELS[model](dim).name)).withColumn("embedding_dimension", F.lit(dim)).withColumn("generated_at", F.current_timestamp())


def batch_numbers(df: DataFrame, size: int, order: str) -> DataFrame:
    """Fixed-size batches in the order of a unique column. Positions come from counts per range, not from one sort."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    from papyrine.operators.ordering import global_position

    return global_position(df, order, "position").withColumn("batch", F.floor((F.col("position") - 1) / size))


def memory_estimate_mb(batch: int, length: int, dim: int) -> float:
    """Megabytes of one batch: token ids, hidden states and pooled vectors."""
    return (batch * length * 8 + batch * length * dim * 4 + batch * dim * 4) / 2**20


def device(preferred: str | None = None) -> str:
    """The device a model would run on: the preferred one, else a GPU that Spark has assigned, else the CPU."""
    if preferred:
        return preferred
    try:
        from pyspark import TaskContext

        context = TaskContext.get()
        return "cuda:" + context.resources()["gpu"].addresses[0] if context and "gpu" in context.resources() else "cpu"
    except Exception:
        return "cpu"
