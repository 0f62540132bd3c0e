"""The k most similar vectors of every vector, by balanced posting lists.

A bounded sample is split by balanced k-means, level by level, until every leaf holds about as many sample points as
stand for one posting list. Each vector is stored in the list of its nearest centroid and, when it lies on a boundary,
in further lists whose centroid is hardly farther away. A query searches the centroids along an in-memory neighbour
graph and probes only lists whose centroid distance is within a ratio of the nearest one. Lists are searched by one
matrix product each; partial answers are merged per vector. Beyond ``max_lists`` the lists are coarse ones, and tasks split
each of them again in the same way.

Defined results
* A vector is usable if it is not null, has exactly ``dim`` entries, all finite, not all zero. Other rows, and rows
  with a null id, are no queries and no neighbours.
* Only direction counts. Vectors with the same direction (as half-precision unit vectors) are collapsed before the
  search and expanded afterwards, so any number of copies costs one search; copies are each other's first neighbours,
  smallest ids first.
* Ties are ordered by id. Fewer than k usable vectors give fewer neighbours; an empty table gives no rows.
* Only the two named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.scratch import materialize


@dataclass(frozen=True)
class Lists:
    """Parameters of the index.

    sample_rows bounds the rows that the centroids are fitted on; every row is indexed. max_lists bounds the centroid
    table that each executor holds (128 floats and 24 links each); where more lists are needed, each is split again.
    ask_rows and part_rows bound the rows of one task that probe a list, or stand in one part of a coarse list.
    """

    list_rows: int = 256
    sample_rows: int = 65_536
    max_lists: int = 16_384
    replicas: int = 2
    replica_ratio: float = 1.05
    probes: int = 4
    inner_probes: int = 3
    probe_ratio: float = 1.18
    block_rows: int = 4_096
    ask_rows: int = 16_384
    part_rows: int = 65_536
    links: int = 16
    beam: int = 16


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    big = np.abs(x).max(axis=1)
    good = np.isfinite(big) & (big > 0)
    x = x[good] / big[good, None]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return at[good], x.astype(np.float32)


def _normalise(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b.column(1), dim)
            half = np.ascontiguousarray(x.astype(np.float16))
            data = pa.Array.from_buffers(
                pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (2 * dim)), pa.py_buffer(half)]
            )
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), data], ["id", "v"])

    return run


def _vectors(values: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float16).reshape(-1, dim).astype(np.float32)


def _split(x: np.ndarray, ways: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means whose assignment is charged for crowded clusters, so that sizes stay even."""
    c = x[rng.choice(len(x), ways, replace=False)]
    size = np.full(ways, len(x) / ways)
    for _ in range(rounds):
        a = (x @ c.T - 0.1 * (size * ways / len(x) - 1)).argmax(axis=1)
        size = np.bincount(a, minlength=ways).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c, (x @ c.T).argmax(axis=1)


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Leaf centroids of a hierarchical balanced clustering, and the share of the sample in each leaf."""
    rng = np.random.default_rng(seed)
    leaf = max(1.0, len(sample) / lists)
    todo, centroids, shares = [np.arange(len(sample))], [], []
    while todo:
        at = todo.pop()
        x = sample[at]
        ways = int(min(8, np.ceil(len(at) / leaf), len(at)))
        if ways > 1 and len(at) > 1.5 * leaf:
            _, a = _split(x, ways, rng)
            parts = [at[a == j] for j in range(ways)]
            parts = [p for p in parts if len(p)]
            if len(parts) > 1:
                todo += parts
                continue
        mean = x.sum(axis=0)
        norm = np.linalg.norm(mean)
        centroids.append(mean / norm if norm > 1e-6 else x[0])
        shares.append(len(at) / len(sample))
    return np.stack(centroids).astype(np.float32), np.array(shares)


class CentroidGraph:
    """Neighbour graph over the centroids, searched best-first for many queries at once.

    A search starts from the nearest of the entry points (every ``per_entry``-th centroid, more where they are few), keeps the ``beam`` best centroids
    met, and opens the ``width`` best of them that are not open yet, until none of those is among the 2 * ``top`` best.
    """

    def __init__(self, centroids: np.ndarray, links: int, per_entry: int = 8, seed: int = 11):
        k = len(centroids)
        self.c = centroids
        deg = min(links, k - 1)
        near = np.empty((k, deg), np.int32)
        for s in range(0, k, 2048):
            sims = centroids[s : s + 2048] @ centroids.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
            near[s : s + 2048] = np.argpartition(-sims, deg - 1, axis=1)[:, :deg] if deg else 0
        # an edge is walked in both directions as far as there is room; a centroid fills its empty places itself
        back = links // 2
        self.linked = np.tile(np.arange(k, dtype=np.int32)[:, None], (1, deg + back))
        self.linked[:, :deg] = near
        to, by = near.ravel(), np.repeat(np.arange(k, dtype=np.int32), deg)
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        rank = np.arange(len(to)) - np.searchsorted(to, np.arange(k))[to]
        self.linked[to[rank < back], deg + rank[rank < back]] = by[rank < back]
        self.entries = np.random.default_rng(seed).permutation(k).astype(np.int32)[: min(k, int(max(16 * np.sqrt(k), k / per_entry)) + 1)]

    def search(self, q: np.ndarray, top: int, beam: int, width: int = 2, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of about the ``top`` nearest centroids, nearest first."""
        top = min(top, len(self.entries))
        beam = min(max(beam, top, width), len(self.entries))
        reach = min(beam, 2 * top)
        s = q @ self.c[self.entries].T
        at = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        ids, s = self.entries[at], np.take_along_axis(s, at, axis=1)
        opened = np.zeros(s.shape, bool)
        live = np.arange(len(q))
        for _ in range(steps):
            now = np.where(opened[live], -9, s[live])
            pick = np.argpartition(-now, min(width, beam) - 1, axis=1)[:, :width]
            best = np.take_along_axis(now, pick, axis=1).max(axis=1)
            go = (best > -9) & (best >= -np.partition(-s[live], reach - 1, axis=1)[:, reach - 1])
            live, pick = live[go], pick[go]
            if not len(live):
                break
            mine = opened[live]
            np.put_along_axis(mine, pick, True, axis=1)
            near = self.linked[np.take_along_axis(ids[live], pick, axis=1)].reshape(len(live), -1)
            sims = np.matmul(self.c[near], q[live][:, :, None])[:, :, 0]
            ids2, s2 = np.concatenate([ids[live], near], axis=1), np.concatenate([s[live], sims], axis=1)
            open2 = np.concatenate([mine, np.zeros(near.shape, bool)], axis=1)
            order = np.argsort(ids2 * 2 + ~open2, axis=1, kind="stable")  # of one centroid the open entry stays
            ids2, s2, open2 = (np.take_along_axis(x, order, axis=1) for x in (ids2, s2, open2))
            s2[:, 1:][ids2[:, 1:] == ids2[:, :-1]] = -9
            keep = np.argpartition(-s2, beam - 1, axis=1)[:, :beam]
            ids[live], s[live], opened[live] = (np.take_along_axis(x, keep, axis=1) for x in (ids2, s2, open2))
        first = np.argsort(-s, axis=1, kind="stable")[:, :top]
        return np.take_along_axis(ids, first, axis=1), np.take_along_axis(s, first, axis=1)


ROUTED = "list int, block int, part int, id bigint, v binary, member boolean, asks boolean"


def _placed(f: pd.DataFrame, lists: np.ndarray, sims: np.ndarray, blocks: np.ndarray, parts: np.ndarray, p: Lists, probes: int) -> pd.DataFrame:
    """Rows of ``ROUTED``: where each vector is stored and which lists it probes, pruned by the ratio of distances.

    A long list is stored in ``blocks`` and asked in each; where many ask, they stand in ``parts`` and each part holds the block.
    """
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    n = np.arange(lists.shape[1])
    member = (far <= p.replica_ratio * far[:, :1] + 1e-6) & (n < p.replicas) & f["member"].to_numpy()[:, None]
    asks = (far <= p.probe_ratio * far[:, :1] + 1e-6) & (n < probes) & f["asks"].to_numpy()[:, None]
    ids = f["id"].to_numpy()
    out = []
    for mark, own, other in ((member, blocks, parts), (asks, parts, blocks)):
        row, col = np.nonzero(mark)
        lst = lists[row, col]
        many = other[lst]
        at = np.repeat(np.arange(len(row)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append((row[at], lst[at], (ids[row] % own[lst])[at], nth))
    (row, lst, block, part), (row2, lst2, part2, block2) = out
    both = pd.DataFrame({
        "list": np.concatenate([lst, lst2]).astype(np.int32), "block": np.concatenate([block, block2]).astype(np.int32), "part": np.concatenate([part, part2]).astype(np.int32),
        "row": np.concatenate([row, row2]), "member": np.repeat([True, False], [len(row), len(row2)]), "asks": np.repeat([False, True], [len(row), len(row2)]),
    })
    both = both.groupby(["list", "block", "part", "row"], sort=False, as_index=False).max()  # stored and asked at once: one row
    return pd.DataFrame({"list": both["list"], "block": both["block"], "part": both["part"], "id": ids[both["row"]], "v": f["v"].to_numpy()[both["row"]], "member": both["member"], "asks": both["asks"]})


def _route(graph, sizes, p: Lists, dim: int):
    """Vectors to the lists of the graph's centroids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, (blocks, parts) = graph.value, sizes.value
        for whole in frames:
            for s in range(0, len(whole), 1024):
                f = whole.iloc[s : s + 1024]
                lists, sims = g.search(_vectors(f["v"], dim), max(p.replicas, p.probes), p.beam)
                yield _placed(f.assign(member=True), lists, sims, blocks, parts, p, p.probes)

    return run


def _fit_list(rows: float, p: Lists, dim: int):
    """Centroids of the lists inside one coarse list, from a sample of its members; about ``rows`` are members in all."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(_vectors(f["v"], dim), axis=0)
        c, shares = fit_centroids(x, int(min(max(1, round(rows * len(f) / p.list_rows)), len(x))))
        return pd.DataFrame({"list": [f["list"].iloc[0]], "c": [c.tobytes()], "share": [(shares * rows * len(f)).astype(np.float64).tobytes()]})

    return run


def _route_inside(p: Lists, dim: int):
    """Rows of one part of a coarse list to the lists inside it."""

    def run(f: pd.DataFrame, cents: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("top", "int32"), ("list", "int32"), ("block", "int32"), ("part", "int32"), ("id", "int64"), ("v", "object"), ("member", "bool"), ("asks", "bool"))})
        if len(cents):
            c, rows = np.frombuffer(cents["c"].iloc[0], np.float32).reshape(-1, dim), np.frombuffer(cents["share"].iloc[0])
        else:  # nobody of this list was in the sample
            c, rows = np.eye(1, dim, dtype=np.float32), np.array([float(len(f))])
        blocks, parts = _sizes(rows, p)
        probes = p.inner_probes
        n = min(len(c), max(p.replicas, probes))
        out = []
        for s in range(0, len(f), 4096):
            b = f.iloc[s : s + 4096].reset_index(drop=True)
            sims = _vectors(b["v"], dim) @ c.T
            lists = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(sims, lists, axis=1)
            order = np.argsort(-near, axis=1, kind="stable")
            out.append(_placed(b, np.take_along_axis(lists, order, axis=1), np.take_along_axis(near, order, axis=1), blocks, parts, p, probes))
        return pd.concat(out).assign(top=f["list"].iloc[0])

    return run


def _sizes(rows: np.ndarray, p: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and parts of lists that hold about so many rows."""
    return np.maximum(1, np.ceil(rows / p.block_rows)).astype(np.int64), np.maximum(1, np.ceil(rows * p.probes / p.ask_rows)).astype(np.int64)


def _routed(reps: DataFrame, sample: np.ndarray, total: int, p: Lists, dim: int) -> DataFrame:
    """Every vector in its lists. Where ``max_lists`` are too few, those are coarse ones, and each of them is split again by
    a task of its own; so lists keep their size whatever the number of vectors."""
    wanted = max(1, round(total / p.list_rows))
    lists = int(min(wanted, p.max_lists, len(sample)))
    centroids, shares = fit_centroids(sample, lists)
    context = reps.sparkSession.sparkContext
    graph = context.broadcast(CentroidGraph(centroids, p.links))  # at most max_lists centroids
    deep = wanted > 2 * lists
    coarse = np.ones(len(centroids), np.int64)
    sizes = context.broadcast((coarse, coarse) if deep else _sizes(shares * total, p))
    routed = reps.mapInPandas(_route(graph, sizes, p, dim), ROUTED).withColumn("top", F.lit(0))
    if not deep:
        return routed
    routed = materialize(routed.select("list", "id", "v", "member", "asks"), "coarse")
    rate = min(1.0, 32.0 / p.list_rows)  # members of the sample per list inside
    some = routed.where("member").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < F.lit(int(1_000_003 * rate) + 1))
    cents = materialize(some.groupBy("list").applyInPandas(_fit_list(1 / rate, p, dim), "list int, c binary, share binary"), "centroids")
    parts = context.broadcast(np.maximum(1, np.ceil(shares * total * (p.replicas + p.probes) / p.part_rows)).astype(np.int64))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(slice=(f["id"].to_numpy() % parts.value[f["list"].to_numpy()]).astype(np.int32))

    def repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            many = parts.value[f["list"].to_numpy()]
            at = np.repeat(np.arange(len(f)), many)
            yield f.iloc[at].assign(slice=(np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32))

    rows = routed.mapInPandas(spread, "list int, id bigint, v binary, member boolean, asks boolean, slice int")
    cents = cents.mapInPandas(repeated, "list int, c binary, share binary, slice int")
    both = rows.groupBy("list", "slice").cogroup(cents.groupBy("list", "slice"))
    return both.applyInPandas(_route_inside(p, dim), "top int, " + ROUTED)


def _search_list(k: int, dim: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, ids = _vectors(f["v"], dim), f["id"].to_numpy()
        members, asks = np.flatnonzero(f["member"]), np.flatnonzero(f["asks"])
        out = []
        for s in range(0, len(asks), 2048):
            q = asks[s : s + 2048]
            if not len(members):
                break
            sims = x[q] @ x[members].T
            sims[ids[q][:, None] == ids[members][None, :]] = -3
            top = min(k, len(members))
            near = np.argpartition(-sims, top - 1, axis=1)[:, :top]
            rows = np.repeat(np.arange(len(q)), top)
            cols = near.ravel()
            keep = sims[rows, cols] > -3
            rows, cols = rows[keep], cols[keep]
            # one pair met in two lists must get the very same value
            exact = np.einsum("ij,ij->i", x[q[rows]].astype(np.float64), x[members[cols]].astype(np.float64))
            out.append(pd.DataFrame({"q": ids[q[rows]], "c": ids[members[cols]], "far": np.round(1 - exact, 7)}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "far": pd.Series(dtype="float64")})

    return run


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 128, ask=None, params: Lists = Lists()) -> DataFrame:
    """``(id, neighbour, rank, cosine)``: for each usable vector (or those whose id meets ``ask``) its k nearest.

    ``ask`` is a function from the id column to a condition; every usable vector is indexed in any case.
    """
    spark = df.sparkSession
    base = materialize(
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("e")).where("id is not null and e is not null")
        .mapInArrow(_normalise(dim), "id bigint, v binary"), "unit",
    )
    asked = (lambda c: F.lit(True)) if ask is None else ask
    keyed = base.select("id", F.xxhash64("v").alias("h"), F.crc32("v").alias("h2"))
    # copies: the first k+1 ids of each direction; the group limit runs before the shuffle, so a hot direction stays small
    from pyspark.sql import Window as W

    first = keyed.withColumn("n", F.row_number().over(W.partitionBy("h", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    copies = first.groupBy("h", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    copies = materialize(copies.withColumn("rep", F.col("ids")[0]), "copies")
    any_copies = copies.limit(1).count() > 0
    reps = base.withColumn("asks", asked(F.col("id")))
    if any_copies:
        reps = base.groupBy("v").agg(F.min("id").alias("id"), F.max(asked(F.col("id"))).alias("asks")).select("id", "v", "asks")

    total = max(1, base.count())
    part = min(1.0, params.sample_rows / total)
    rows = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * part) + 1)).select("v").toPandas()
    sample = np.unique(_vectors(rows["v"], dim), axis=0) if len(rows) else np.eye(1, dim, dtype=np.float32)
    routed = _routed(reps, sample, total, params, dim)
    hits = routed.groupBy("top", "list", "block", "part").applyInPandas(_search_list(k, dim), "q bigint, c bigint, far double")
    near = hits.groupBy("q").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "c"))), 1, k).alias("near"))
    flat = near.select("q", F.explode("near").alias("x")).select("q", F.col("x.far").alias("far"), F.col("x.c").alias("c"))
    if any_copies:
        flat = _expand(flat, keyed, copies, k, asked)
    w = W.partitionBy("q").orderBy("far", "c")
    return (
        flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select(F.col("q").alias("id"), F.col("c").alias("neighbour"), "rank", (1 - F.col("far")).alias("cosine"))
    )


def _expand(flat: DataFrame, keyed: DataFrame, copies: DataFrame, k: int, asked) -> DataFrame:
    """Put copies back: as neighbours of others, and as queries with their own copies first."""
    reps = copies.select(F.col("rep").alias("c"), "ids")
    wide = flat.join(reps, "c", "left").select("q", "far", F.explode(F.coalesce("ids", F.array("c"))).alias("c"))
    own = copies.select(F.col("rep").alias("q"), F.lit(0.0).alias("far"), F.explode("ids").alias("c"))
    near = wide.unionByName(own).groupBy("q").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "c"))), 1, k + 1).alias("near"))
    members = keyed.join(copies.select("h", "h2", "rep"), ["h", "h2"]).select(F.col("rep").alias("q"), F.col("id").alias("member"))
    # a direction with very many copies is split by adaptive execution, which it could not be in an outer join
    many = members.join(near, "q").select(F.col("member").alias("q"), "near")
    lone = near.join(copies.select(F.col("rep").alias("q")), "q", "left_anti").select("q", "near")
    out = many.unionByName(lone).select("q", F.explode("near").alias("x"))
    return out.select("q", F.col("x.far").alias("far"), F.col("x.c").alias("c")).where((F.col("q") != F.col("c")) & asked(F.col("q")))
