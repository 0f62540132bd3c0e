"""Settings with environment overrides (``PAPYRINE_<NAME>``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Defaults of chunk sizes, retrieval depth, fusion and scoring constants."""

    chunk_target_tokens: int = 512
    chunk_min_tokens: int = 50
    chunk_max_tokens: int = 600
    chunk_overlap_tokens: int = 75
    embedding_batch_size: int = 32
    embedding_dim: int = 768
    indexing_batch_size: int = 256
    collection_name: str = "articles"
    dense_vector_name: str = "dense"
    sparse_vector_name: str = "sparse-bm25"
    top_k: int = 20
    final_k: int = 5
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    max_context_tokens: int = 6000
    max_downloads: int = 1000
    request_delay: float = 0.3
    max_retries: int = 3
    timeout: int = 20
    data_dir: str = "data"
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            if (raw := env.get(f"PAPYRINE_{f.name.upper()}")) is not None:
                given[f.name] = type(f.default)(raw)
        return cls(**given)

    def stage_dir(self, stage: str) -> str:
        return f"{self.data_dir}/{stage}"

    def make_dirs(self, spark=None) -> list[str]:
        """The folders of all stages; through the session's file systems where the data folder names one."""
        made = [self.stage_dir(stage) for stage in ("raw", "metadata", "canonical", "chunks", "embeddings", "index", "stats", "quarantine")]
        for folder in made:
            if "://" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
            else:
                Path(folder).mkdir(parents=True, exist_ok=True)
        return made
