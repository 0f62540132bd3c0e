"""Near-duplicate texts, by bit-sliced comparison of sketches within blocks.

The words of a text, each occurrence counted apart, form a set whose Jaccard similarity is exactly the shared part of
the words of both texts. Min-wise hashes of that set give two things: block keys (texts that agree on all hashes of one
band meet in a block) and a sketch of two bits per hash. Within blocks the sketches lie as bit planes: bit i of plane p
is bit p of text i. Comparing every text with the one d places further is then a shifted exclusive-or of planes, 64
pairs a word, summed by carry-save adders into vertical counters. After each group of planes, words whose pairs all
exceed the radius are abandoned. Pairs within the radius are checked exactly on their words.

Defined results
* Texts with fewer than ``min_words`` words, null and blank texts, and rows with a null key take part in nothing.
* Texts with the same words in the same numbers form one class; the search runs over one text per class. Up to
  ``all_pairs_up_to`` exact copies of a text are written with all their pairs; of more copies each one is paired with the
  first only (and links to other texts run from the first), so no text loses its links and the result stays linear in
  the number of copies. Different texts of a class, such as reorderings, are written with all their pairs.
* A block is never cut: blocks of more than ``tile_rows`` texts are compared tile against tile in separate tasks.
* With 24 bands of 4 hashes a pair of similarity 0.7 is missed with probability 0.0014, one of 0.8 with 5e-6.
* Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.scratch import hot_keys, materialize

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Sketch:
    bands: int = 24
    rows: int = 4
    radius: int = 54
    tile_rows: int = 16_384
    chunk_rows: int = 200_000
    all_pairs_up_to: int = 64

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_numbers: dict[str, int] = {}


def elements(texts: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of texts with enough words, the start of each one's elements, and the elements themselves."""
    if len(_numbers) > 2_000_000:
        _numbers.clear()
    at, sizes, flat = [], [], []
    for i, t in enumerate(texts):
        words = WORD.findall(t.lower()) if t else ()
        if len(words) < min_words:
            continue
        at.append(i)
        sizes.append(len(words))
        try:
            numbers = [_numbers[w] for w in words]
        except KeyError:
            for w in words:
                if w not in _numbers:
                    _numbers[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            numbers = [_numbers[w] for w in words]
        flat += numbers
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    sizes = np.array(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = _mix32(np.array(flat, np.uint32))
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = np.sort((owner << np.uint64(32)) | h.astype(np.uint64))
    place = np.arange(len(key))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    nth = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint32)
    h = key.astype(np.uint32)
    return np.array(at), starts, _mix32(h ^ (nth * np.uint32(0x9E3779B1)))


def _rows(kind: int, s: Sketch, min_words: int):
    rng = np.random.default_rng(2024)
    mult = (rng.integers(1, 2**31, s.hashes) * 2 + 1).astype(np.uint32)
    add = rng.integers(0, 2**32, s.hashes).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4000):
                b = whole.slice(first, 4000)
                texts = b.column(1).to_pylist()
                at, starts, e = elements(texts, min_words)
                n = len(at)
                if not n:
                    continue
                ends = np.append(starts[1:], len(e))
                lows = np.stack([np.minimum.reduceat(e * m + a, starts) for m, a in zip(mult, add)], axis=1)
                two = ((_mix32(lows) >> np.uint32(30)).astype(np.uint8))
                bits = np.stack([two & 1, two >> 1], axis=2).reshape(n, -1)
                sketch = np.ascontiguousarray(np.packbits(bits, axis=1))
                keys = np.zeros((n, s.bands), np.uint64)
                for r in range(s.rows):
                    keys = _mix64(keys * np.uint64(31) + lows[:, r :: s.rows].astype(np.uint64) + np.uint64(1))
                keys = _mix64(keys + (np.arange(s.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15))
                wide = _mix64(e.astype(np.uint64) + np.uint64(0x1234567))
                f1 = np.add.reduceat(wide, starts)
                f2 = np.bitwise_xor.reduceat(_mix64(wide), starts)
                width = sketch.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, kind, np.int8)), b.column(0).take(pa.array(at)), pa.array((ends - starts).astype(np.int32)),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([hashlib.blake2b(texts[i].encode(), digest_size=16).digest() for i in at], pa.binary()),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(sketch)]),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s.bands), pa.array(keys.view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(e)).astype(np.int32)), pa.array(e.view(np.int32))),
                ], ["kind", "id", "n", "f1", "f2", "exact", "sketch", "keys", "words"])

    return run


SKETCHED = "kind tinyint, id bigint, n int, f1 bigint, f2 bigint, exact binary, sketch binary, keys array<bigint>, words array<int>"


def _add(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Carry-save addition: reduce each weight to one plane by full adders, passing carries to the next weight."""
    out, w = [], 0
    while w < len(levels):
        a = levels[w]
        while len(a) > 1:
            t = len(a) // 3
            if t:
                x, y, z = a[:t], a[t : 2 * t], a[2 * t : 3 * t]
                half = x ^ y
                carry = (x & y) | (z & half)
                a = np.concatenate([half ^ z, a[3 * t :]])
            else:
                carry = a[:1] & a[1:]
                a = a[:1] ^ a[1:]
            if w + 1 == len(levels):
                levels.append(carry)
            else:
                levels[w + 1] = np.concatenate([levels[w + 1], carry])
        out.append(a)
        w += 1
    return out


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds ``radius``."""
    more = np.zeros_like(counter[0][0])
    same = ~more
    for w in range(max(len(counter), radius.bit_length()) - 1, -1, -1):
        bit = counter[w][0] if w < len(counter) and len(counter[w]) else np.zeros_like(more)
        if radius >> w & 1:
            same = same & bit
        else:
            more |= same & bit
            same = same & ~bit
    return more


def close_pairs(sketches: np.ndarray, block: np.ndarray, words: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the same block within ``radius``. ``block`` holds equal values for neighbours of a block."""
    n = len(block)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes, starts = sizes[order], starts[order]
    ends = np.cumsum(sizes)
    rows = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
    m = len(rows)
    room = np.repeat(ends, sizes)  # where the row's block ends
    length = words[rows].astype(np.float32)
    bits = np.unpackbits(sketches[rows], axis=1)
    spare = (int(sizes[0]) + 63) // 64 * 8 + 16
    planes = np.zeros((bits.shape[1], (m + 63) // 64 * 8 + spare), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    cuts = [0, bits.shape[1] // 2, bits.shape[1] * 3 // 4, bits.shape[1]]
    left, right = [], []
    for d in range(1, int(sizes[0])):
        active = int(ends[np.searchsorted(-sizes, -d, side="left") - 1])  # rows of blocks with more than d rows
        i = np.arange(active)
        ok = np.zeros((active + 63) // 64 * 64, bool)
        other = length[np.minimum(i + d, m - 1)]
        mine = length[:active]
        ok[:active] = (i + d < room[:active]) & (np.minimum(mine, other) >= least * np.maximum(mine, other))
        alive = np.packbits(ok, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        alive = alive[at]
        counter: list[np.ndarray] = []
        jump, bit = np.uint64(d % 64), d // 64
        for lo, hi in zip(cuts, cuts[1:]):
            if not len(at):
                break
            p = planes[lo:hi]
            moved = p[:, at + bit]
            if jump:
                moved = (moved >> jump) | (p[:, at + bit + 1] << (np.uint64(64) - jump))
            counter = _add([np.concatenate([counter[0], p[:, at] ^ moved]) if counter else p[:, at] ^ moved, *counter[1:]])
            alive = alive & ~_above(counter, radius)
            keep = alive != 0
            if not keep.all():
                at, alive = at[keep], alive[keep]
                counter = [c[:, keep] for c in counter]
        if len(at):
            word, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            first = at[word] * 64 + lane
            left.append(rows[first])
            right.append(rows[first + d])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _compare(s: Sketch, least: float):
    def pairs(t: pa.Table) -> pa.RecordBatch:
        width = s.hashes // 4
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, width)
        i, j = close_pairs(sk, t.column("key").to_numpy(), t.column("n").to_numpy(), s.radius, least)
        ids = t.column("gid").to_numpy()
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        both = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:  # sorted by key
            held.append(b)
            count += b.num_rows
            if count >= s.chunk_rows:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last block may go on
                if cut:
                    yield pairs(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    count = t.num_rows - cut
        if count:
            yield pairs(pa.Table.from_batches(held))

    return run


def near_duplicates(tables: list[tuple[DataFrame, str, str]], least: float = 0.7, min_words: int = 40, params: Sketch = Sketch()) -> tuple[DataFrame, DataFrame]:
    """Links and copies among texts of the same kind.

    ``tables`` lists ``(frame, key column, text column)``; the kind is the position in the list. Returns
    ``pairs(kind, a, b)`` between the first texts of classes, and ``members(kind, id, rep, copies, head, same)`` with one
    row per text that belongs to a class of two or more: its class's first text and size, the first of the texts equal
    to it as strings, and their number.
    """
    parts = [
        df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        .mapInArrow(_rows(kind, params, min_words), SKETCHED)
        for kind, (df, key, text) in enumerate(tables)
    ]
    base = parts[0]
    for more in parts[1:]:
        base = base.unionByName(more)
    base = materialize(base, "sketches")
    words = ["kind", "n", "f1", "f2"]
    equal = base.groupBy(*words, "exact").agg(F.min("id").alias("head"), F.count("*").alias("same"))
    classes = equal.groupBy(*words).agg(F.min("head").alias("rep"), F.sum("same").alias("copies")).where("copies > 1")
    members = base.select(*words, "exact", "id").join(classes, words).join(equal, [*words, "exact"]).select("kind", "id", "rep", "copies", "head", "same")
    members = materialize(members, "copies")
    reps = base.join(members.where("id <> rep").select("kind", "id"), ["kind", "id"], "left_anti")

    gid = (F.col("id") * len(tables) + F.col("kind")).alias("gid")
    rows = reps.select(gid, "n", "sketch", F.explode("keys").alias("key"))
    hot = materialize(hot_keys(reps.select(F.explode("keys").alias("key")), "key", params.tile_rows), "hot")
    if hot.limit(1).count():
        rows = _tiled(rows, hot, params)
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(params, least), "a bigint, b bigint").distinct()
    met = materialize(met, "met")

    need = met.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
    words = materialize(base.select(gid, "n", "words").join(need, "gid", "left_semi"), "words")
    a, b = (words.select(F.col("gid").alias(s), F.col("n").alias(f"n{s}"), F.col("words").alias(f"w{s}")) for s in "ab")
    both = met.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    close = both.where(F.col("shared") >= least * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9)
    size = F.lit(len(tables))
    pairs = close.select(F.pmod("a", size).cast("tinyint").alias("kind"), F.floor(F.col("a") / size).cast("bigint").alias("a"), F.floor(F.col("b") / size).cast("bigint").alias("b"))
    return materialize(pairs, "pairs"), members


def _tiled(rows: DataFrame, hot: DataFrame, s: Sketch) -> DataFrame:
    """Rows of hot blocks go to one tile per pair of parts; any two rows of the block meet in exactly one kind of tile."""
    r = rows.join(hot.withColumnRenamed("rows", "many"), "key", "left")
    parts = F.ceil(F.col("many") / s.tile_rows).cast("int")
    mine = F.pmod(F.xxhash64("gid"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.xxhash64("key", F.least(mine, o), F.greatest(mine, o)))
    keys = F.when(F.col("many").isNull(), F.array("key")).otherwise(tiles)
    return r.select("gid", "n", "sketch", F.explode(keys).alias("key"))


def all_pairs(pairs: DataFrame, members: DataFrame, params: Sketch = Sketch()) -> DataFrame:
    """``(kind, a, b)`` with copies put back, under the rule for many exact copies given above."""
    later = (F.col("same") > params.all_pairs_up_to) & (F.col("id") != F.col("head"))
    small, large = members.where(~later), members.where(later)
    left = small.select("kind", F.col("rep").alias("a"), F.col("id").alias("a2"))
    right = small.select("kind", F.col("rep").alias("b"), F.col("id").alias("b2"))
    across = (
        pairs.join(left, ["kind", "a"], "left").join(right, ["kind", "b"], "left")
        .select("kind", F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
    )
    mates = small.select("kind", "rep", F.col("id").alias("x")).join(small.select("kind", "rep", F.col("id").alias("y")), ["kind", "rep"]).where("x < y")
    out = across.unionByName(mates.select("kind", "x", "y")).unionByName(large.select("kind", F.col("head").alias("x"), F.col("id").alias("y")))
    return out.select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(kind, id, class_id, links)``: one row per text with a near-duplicate or a copy.

    class_id is the smallest id linked to it over any number of steps; links counts the other texts that are close to it,
    its own copies and those of the texts close to it included.
    """
    from papyrine.operators.components import components

    node = lambda c: F.struct("kind", F.col(c).alias("id"))
    self_links = members.where("id = rep").select(node("id").alias("a"), node("id").alias("b"))
    links = pairs.select(node("a").alias("a"), node("b").alias("b")).unionByName(self_links)
    found = components(links).select("node.kind", F.col("node.id").alias("rep"), F.col("component.id").alias("class_id"))
    copies = members.where("id = rep").select("kind", "rep", "copies")
    ends = pairs.select("kind", F.col("a").alias("mine"), F.col("b").alias("rep")).unionByName(pairs.select("kind", F.col("b").alias("mine"), F.col("a").alias("rep")))
    near = ends.join(copies, ["kind", "rep"], "left").groupBy("kind", F.col("mine").alias("rep")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("near"))
    per_rep = found.join(near, ["kind", "rep"], "left").join(copies, ["kind", "rep"], "left")
    links = F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    joined = per_rep.select("kind", "rep", "class_id", links.alias("links")).join(members.select("kind", "rep", "id"), ["kind", "rep"], "left")
    return joined.select("kind", F.coalesce("id", "rep").alias("id"), "class_id", "links")
