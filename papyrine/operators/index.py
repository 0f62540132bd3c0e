"""A keyed collection of points as Parquet segments: create, upsert, skip existing, validate.

An upsert writes a segment with its own rows only and then a manifest, a small file under the next number that lists all
segments. Readers take the newest complete manifest, so they see either version, and an interrupted upsert leaves the old
one. Of several rows of a key the one of the newest segment counts. Eight neighbouring segments of a size class are merged
into one, so a row is rewritten as often as the logarithm of the collection. Rows are kept apart by type and sorted by
journal and year inside files, which lets filters skip partitions and row groups.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.operators import sparse


def build_points(vectors: DataFrame, chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Points ``(id, embedding, payload fields)``: vectors joined to their chunk's text, and to document metadata as
    fallback. Vectors without a chunk id or without entries are left out."""
    v = vectors.where((F.coalesce("chunk_id", F.lit("")) != "") & (F.coalesce(F.size("embedding"), F.lit(0)) > 0))
    text = chunks.groupBy("chunk_id").agg(F.max_by("content", "row_id").alias("content")) if "row_id" in chunks.columns else chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    p = v.select("chunk_id", "embedding", F.col("metadata").alias("m"), "metadata_header").join(text, "chunk_id", "left")
    if docs is not None:
        d = docs.select(F.col("pmcid").alias("d_pmcid"), F.col("title").alias("d_title"), F.col("journal").alias("d_journal"), F.col("pub_year").alias("d_year"), "article_type", "license")
        d = d.groupBy("d_pmcid").agg(F.max(F.struct("d_title", "d_journal", "d_year", "article_type", "license")).alias("d")).select("d_pmcid", "d.*")  # one row per document
        p = p.join(d, F.col("m.pmcid") == F.col("d_pmcid"), "left")
    else:
        p = p.withColumns({c: F.lit(None).cast(t) for c, t in (("d_title", "string"), ("d_journal", "string"), ("d_year", "int"), ("article_type", "string"), ("license", "string"))})
    text_or = lambda *c: F.coalesce(*c, F.lit(""))
    return p.select(
        T.point_id("chunk_id").alias("id"), "embedding", "chunk_id", text_or("m.pmcid").alias("pmcid"), text_or("m.title", "d_title").alias("title"),
        text_or("m.journal", "d_journal").alias("journal"), F.coalesce("m.pub_year", "d_year").alias("pub_year"), text_or("m.section").alias("section"),
        text_or("m.subsection").alias("subsection"), F.coalesce("m.section_path", F.array().cast("array<string>")).alias("section_path"),
        text_or("m.chunk_type").alias("chunk_type"), F.coalesce("m.token_count", F.lit(0)).alias("token_count"), text_or("metadata_header").alias("metadata_header"),
        text_or("article_type").alias("article_type"), text_or("license").alias("license"), text_or("content").alias("content"),
    )


def with_sparse(points: DataFrame) -> DataFrame:
    """Points with a sparse vector of the words of their content beside the dense one; null where there are none."""
    texts = points.select("chunk_id", "content").distinct()
    return points.join(sparse.sparse_vectors(sparse.postings(texts, "chunk_id"), "chunk_id"), "chunk_id", "left")


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """One row per key, the last by ``order``; the group limit runs before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def only_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_anti")


def only_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_semi")


def upserted(existing: DataFrame, new: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The collection after an upsert: with ``force`` new rows replace old ones, else old rows stay."""
    if force:
        return only_new(existing, new, key).unionByName(new)
    return existing.unionByName(only_new(new, existing, key))


def first_points(points: DataFrame, n: int = 100) -> DataFrame:
    """The first points by id, for a look at a collection."""
    return points.orderBy("id").limit(n)


class Collection:
    """One collection in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, name: str, dim: int = 768, distance: str = "cosine", key: str = "id"):
        self.spark, self.path, self.name, self.key = spark, f"{root.rstrip('/')}/{name}", name, key
        self.properties = {"name": name, "dim": dim, "distance": distance, "sparse_modifier": "idf"}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _read(self, name: str) -> dict | None:
        fs, path = self._fs()
        p = path(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            jvm = self.spark.sparkContext._jvm
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # cut off while it was written
            return None
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        """A new file that appears as a whole; one of that name must not be there."""
        fs, path = self._fs()
        tmp, final = path(f"{self.path}/.{name}.{uuid.uuid4().hex[:8]}"), path(f"{self.path}/{name}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise FileExistsError(f"{name} was written by another run")

    def _manifests(self) -> list[str]:
        """Names of the manifests, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path(self.path)))
        return sorted(n for n in names if n.startswith("manifest-"))

    def _segments(self) -> tuple[int, list[dict]]:
        """Number and segments of the newest complete manifest; 0 and none at the start."""
        for name in reversed(self._manifests()):
            if (found := self._read(name)) is not None:
                return int(name[9:-5]), found["segments"]
        return 0, []

    def exists(self) -> bool:
        return self._read("properties.json") is not None

    def create(self) -> bool:
        """True if the collection was created, False if it was there."""
        if self.exists():
            return False
        self._write("properties.json", self.properties)
        return True

    def delete(self) -> bool:
        if not self.exists():
            return False
        fs, path = self._fs()
        return bool(fs.delete(path(self.path), True))

    def recreate(self) -> None:
        self.delete()
        self.create()

    def _rows(self, segments: list[dict], key: str = "id") -> DataFrame | None:
        """The rows of some segments, of each key the newest."""
        if not segments:
            return None
        if not any(s["replaces"] for s in segments[1:]):  # without replacements no key is twice there
            return functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{s['name']}") for s in segments])
        parts = [self.spark.read.parquet(f"{self.path}/{s['name']}").withColumn("_segment", F.lit(n)) for n, s in enumerate(segments)]
        return latest(functools.reduce(DataFrame.unionByName, parts), key, "_segment").drop("_segment")

    def points(self) -> DataFrame | None:
        return self._rows(self._segments()[1], self.key)

    def info(self) -> dict:
        """Name, status and number of points; empty if there is no collection."""
        if not self.exists():
            return {}
        p = self.points()
        return {"name": self.name, "status": "green", "points_count": p.count() if p is not None else 0}

    def _segment(self, rows: DataFrame, replaces: bool) -> dict:
        name = f"s-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        sort = [c for c in ("chunk_type", "journal", "pub_year") if c in rows.columns]
        writer = (rows.sortWithinPartitions(*sort) if sort else rows).write.option("parquet.bloom.filter.enabled#pmcid", "true")
        if "chunk_type" in rows.columns:
            writer = writer.partitionBy("chunk_type")
        writer.parquet(f"{self.path}/{name}")
        return {"name": name, "rows": seen.get["n"], "replaces": replaces}

    def upsert(self, points: DataFrame, force: bool = False, order: tuple[str, ...] = ()) -> None:
        """Add points; those whose key is there are skipped, or replace it with ``force``.

        Of several new rows of a key the last by ``order`` counts, without an order the greatest one."""
        if order:
            new = latest(points, self.key, *order)
        else:
            rest = [c for c in points.columns if c != self.key]
            new = points.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("r")).select(self.key, "r.*").select(points.columns)
        number, segments = self._segments()
        old = self._rows(segments, self.key)
        if old is not None and not force:
            new = only_new(new, old, self.key)
        made = self._segment(new, force and old is not None)
        if made["rows"] or not segments:
            segments = [*segments, made]
        while len(segments) >= MERGED and len({_size_class(s) for s in segments[-MERGED:]}) == 1:
            tail = segments[-MERGED:]
            segments = [*segments[:-MERGED], self._segment(self._rows(tail, self.key), any(s["replaces"] for s in tail) and len(segments) > MERGED)]
        self._write(f"manifest-{number + 1:010d}.json", {"segments": segments})
        self._clean()

    def _clean(self, keep: int = 2) -> None:
        """Remove manifests but the newest ones, and segments that none of those lists."""
        fs, path = self._fs()
        names = self._manifests()
        kept = [m for m in names[-keep:] if self._read(m) is not None]
        used = {s["name"] for m in kept for s in self._read(m)["segments"]}
        if not kept:
            return
        for m in names[:-keep]:
            older = {s["name"] for s in (self._read(m) or {"segments": []})["segments"]}
            for s in older - used:
                fs.delete(path(f"{self.path}/{s}"), True)
            fs.delete(path(f"{self.path}/{m}"), False)


MERGED = 8


def _size_class(segment: dict) -> int:
    """Segments of up to 10,000 rows are of class 0, each further class holds eight times as many."""
    n, size = segment["rows"], 0
    while n > 10_000:
        n, size = n // MERGED, size + 1
    return size
