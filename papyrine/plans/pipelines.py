"""The stages from raw articles to a searchable collection, each a plan over the stage before.

Every stage skips what it has done (an anti join by key), unless forced, and appends its rows, so a stopped run goes on
where it was. A run always leaves one statistics row, also when there was nothing to do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.config import Settings
from papyrine.functions.vectors import norm
from papyrine.operators import articles, chunking, embedding, index, stats, validate
from papyrine.sources import fetch, files, search


@dataclass
class Run:
    spark: SparkSession
    settings: Settings = Settings()
    counter: object | None = None

    def path(self, stage: str) -> str:
        return self.settings.stage_dir(stage)

    def _pending(self, df: DataFrame, stage: str, key: str, force: bool, limit: int | None) -> tuple[DataFrame, DataFrame | None]:
        done = None if force else files.stage_table(self.spark, self.path(stage))
        todo = df if done is None else index.only_new(df, done, key)
        return (todo.orderBy(key).limit(limit) if limit else todo), done

    def _statistics(self, stage: str, rows: DataFrame, began: float) -> DataFrame:
        out = rows.withColumn("stage", F.lit(stage)).withColumn("elapsed", F.lit(round(time.time() - began, 3)))
        files.write_json(out, f"{self.path('stats')}/{stage}")
        return self.spark.read.json(f"{self.path('stats')}/{stage}")

    def _write(self, df: DataFrame, stage: str, force: bool, partition_by: tuple[str, ...] = ()) -> None:
        if force:
            w = df.write.mode("overwrite")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(stage))
        else:
            files.append(df, self.path(stage), partition_by)

    def search(self, query: str = "", year: int | None = None, journal: str | None = None, limit: int | None = None, **where) -> DataFrame:
        """``(pmcid, rank)`` of a search; ``where`` names the service (``url``) or the folder of records (``path``)."""
        search.register(self.spark)
        s = self.settings
        asked = {"query": query, "year": year, "journal": journal, "limit": limit or s.max_downloads, "delay": s.request_delay if "url" in where else 0, "retries": s.max_retries, "timeout": s.timeout, **where}
        return self.spark.read.format("article_search").options(**{k: str(v) for k, v in asked.items() if v is not None}).load()

    def fetch(self, found: DataFrame, opener, tasks: int = 1, delay: float | None = None) -> DataFrame:
        """Texts of search results, under the settings' rate limit and retries."""
        s = self.settings
        return fetch.fetch(found, opener, s.request_delay if delay is None else delay, s.max_retries, tasks=tasks)

    def ingest(self, found: DataFrame, fetched: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
        """Search results ``found(pmcid)`` with texts ``fetched(pmcid, xml)`` to the raw stage and the quarantine.

        Status per article: skipped, failed (no text), invalid (errors), success. Nothing raises."""
        began = time.time()
        todo, done = self._pending(found.select("pmcid").distinct(), "raw", "pmcid", force, limit)
        got = todo.join(fetched.select("pmcid", "xml"), "pmcid", "left")
        parsed = articles.parse(got.where("xml is not null"))
        status = F.when(F.size("errors") > 0, "invalid").otherwise("success")
        rows = got.join(parsed.select("pmcid", "metadata", "errors", "warnings", status.alias("s")), "pmcid", "left").withColumn("status", F.coalesce("s", F.lit("failed")))
        rows = rows.select("pmcid", "xml", "status", "metadata", "errors", "warnings").persist()
        self._write(rows.where("status = 'success'").select("pmcid", "xml", "metadata", "warnings"), "raw", force)
        files.append(rows.where("status = 'invalid'").select("pmcid", "xml", "errors"), f"{self.path('quarantine')}/raw")
        skipped = found.select("pmcid").distinct().count() - todo.count() if done is not None and not limit else 0
        counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "invalid")])
        out = self._statistics("ingest", counts.withColumn("skipped", F.lit(skipped)), began)
        rows.unpersist()
        return out

    def parse(self, force: bool = False, target: str | None = None, limit: int | None = None) -> DataFrame:
        began = time.time()
        raw = files.stage_table(self.spark, self.path("raw"))
        if raw is None:
            return self._statistics("parse", self.spark.createDataFrame([(0, 0)], "parsed int, invalid int"), began)
        raw = raw.where(F.col("pmcid") == target) if target else raw
        todo, _ = self._pending(raw.select("pmcid", "xml"), "canonical", "pmcid", force, limit)
        parsed = articles.parse(todo).persist()
        good, bad = articles.route(parsed)
        self._write(good, "canonical", force)
        files.append(bad.select("pmcid", "errors", "warnings"), f"{self.path('quarantine')}/canonical")
        counts = parsed.agg(F.count("*").alias("seen")).crossJoin(good.agg(F.count("*").alias("parsed"))).withColumn("invalid", F.col("seen") - F.col("parsed"))
        out = self._statistics("parse", counts, began)
        parsed.unpersist()
        return out

    def chunk(self, force: bool = False, target: str | None = None, limit: int | None = None) -> DataFrame:
        began = time.time()
        docs = files.stage_table(self.spark, self.path("canonical"))
        empty = "documents int, total_chunks int, rejected_chunks int"
        if docs is None:
            return self._statistics("chunk", self.spark.createDataFrame([(0, 0, 0)], empty), began)
        docs = docs.where(F.col("pmcid") == target) if target else docs
        todo, _ = self._pending(docs, "chunks", "pmcid", force, limit)
        flat = todo.select("pmcid", "metadata.title", "metadata.journal", "metadata.pub_year", "abstract", "doc_tables", "figures")
        about = ("pmcid", "title", "journal", "pub_year")  # carried along, so that nothing is joined back
        sections = todo.select("pmcid", "metadata.title", "metadata.journal", "metadata.pub_year", F.explode("sections").alias("s")).select(*about, "s.ord", "s.section_path", "s.content")
        made = chunking.chunk_documents(flat, sections, self.counter, self.settings)
        why = validate.chunk_reasons(self.settings.chunk_min_tokens)
        checked = made.withColumn("reasons", why).persist()
        self._write(checked.where(F.size("reasons") == 0).drop("reasons", "branch", "ord", "seq"), "chunks", force, ("chunk_type",))
        files.append(checked.where(F.size("reasons") > 0).select("pmcid", "chunk_id", "reasons"), f"{self.path('quarantine')}/chunks")
        out = self._statistics("chunk", stats.corpus_stats(stats.document_stats(checked.withColumn("lost", F.size("reasons") > 0), "lost")), began)
        checked.unpersist()
        return out

    def embed(self, force: bool = False, model: str = "hashing", target: str | None = None, limit: int | None = None, device: str | None = None) -> DataFrame:
        began = time.time()
        chunks = files.stage_table(self.spark, self.path("chunks"))
        if chunks is None:
            return self._statistics("embed", self.spark.createDataFrame([(0,)], "vectors int"), began)
        chunks = chunks.where(F.col("pmcid") == target) if target else chunks
        todo, _ = self._pending(chunks, "embeddings", "chunk_id", force, limit)
        made = embedding.embed(todo, model, self.settings.embedding_dim, self.settings.embedding_batch_size, device).persist()
        good, bad = validate.split(made, validate.vector_reasons("embedding", self.settings.embedding_dim))
        self._write(good, "embeddings", force)
        files.append(bad.select("chunk_id", "reasons"), f"{self.path('quarantine')}/embeddings")
        out = self._statistics("embed", stats.embedding_stats(good.withColumn("n", norm("embedding")), "n", time.time() - began), began)
        made.unpersist()
        return out

    def index(self, force: bool = False, recreate: bool = False, target: str | None = None, limit: int | None = None) -> DataFrame:
        began = time.time()
        collection = index.Collection(self.spark, self.path("index"), self.settings.collection_name, self.settings.embedding_dim)
        if recreate:
            collection.recreate()
        collection.create()
        vectors, chunks = files.stage_table(self.spark, self.path("embeddings")), files.stage_table(self.spark, self.path("chunks"))
        if vectors is None or chunks is None:
            return self._statistics("index", self.spark.createDataFrame([(0, 0)], "indexed int, skipped int"), began)
        vectors = vectors.where(F.col("metadata.pmcid") == target) if target else vectors
        vectors = vectors.orderBy("chunk_id").limit(limit) if limit else vectors
        points = index.build_points(vectors, chunks).persist()
        before = collection.points()
        seen = 0 if before is None else index.only_existing(points, before, "id").count()
        total = points.count()
        collection.upsert(points, force=force)
        report = validate.index_report(collection.points(), None, self.settings.embedding_dim)
        indexed, took = (total if force else total - seen), max(time.time() - began, 1e-9)
        counts = report.withColumns({
            "indexed": F.lit(indexed), "skipped": F.lit(0 if force else seen), "batches": F.lit(-(-indexed // self.settings.indexing_batch_size)),
            "points_per_second": F.lit(round(indexed / took, 2)), "seconds_per_batch": F.lit(round(took / max(1, -(-indexed // self.settings.indexing_batch_size)), 4)),
        })
        out = self._statistics("index", counts, began)
        points.unpersist()
        return out
