"""Evaluation texts that leaked into a corpus, by greedy string tiling.

Both sides are reduced to words in a common typography. Runs of ``seed`` words that occur in an item are looked up in
the corpus texts of an Arrow batch at once; a text whose seeds could cover enough of an item goes to greedy string
tiling: longest common runs are found by rolling hashes (Karp-Rabin), longest first, and marked so that no word is used
twice, down to ``shortest`` words. Tiles that lie close together in the text form a stretch; altered words between two
tiles of one stretch bridge them. The item leaked if its two best stretches cover at least ``cover`` of its words, in
any order of the stretches. Where fewer than that are matched word for word in tiles longer than the shortest, a second scan counts the texts that hold the
runs of these stretches: a run met more often elsewhere than in texts that reproduce the item is a turn of speech, and at
least half of the matched words must lie in tiles that have other runs. The scans are narrow: no text is shuffled,
whatever the number of copies.

Defined results
* Null or blank texts and items, and rows with a null id, give no rows; items without any word cannot leak.
* Repeated rows of the corpus are searched each for itself; repeated item rows give one result per id.
* Words are runs of letters and digits (single letters in scripts without blanks between words) after compatibility folding, lower case, without accents, soft hyphens,
  zero-width characters, tags and bracketed reference numbers, and without the separator inside a number; words broken by a hyphen at a line end are joined.
* Items are broadcast in parts of at most ``part_words`` words, each part a pass of its own, so the broadcast is bounded.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.scratch import materialize

PASSAGES = "doc_id bigint, item_id bigint, matched double, covered double, tiles array<struct<words int, runs array<bigint>>>"
TILES = pa.list_(pa.struct([("words", pa.int32()), ("runs", pa.list_(pa.int64()))]))
WORD = re.compile(r"[^\W_]+")
#: Letters of scripts without blanks between words (Thai to Lao, Burmese, Khmer, kana, Chinese) are words of their own.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
ALONE = re.compile(f"[{UNSPACED}]")
ANY_WORD = re.compile(rf"(?!_)\w(?:(?<=[{UNSPACED}])|[^\W_{UNSPACED}]*)")
HIDDEN = re.compile("[­​-‏⁠﻿]")
BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n\s*(?=[a-zß-ɏ])")
DECIMAL = re.compile(r"[.,](?<=\d[.,])(?=\d)")
MARKS = re.compile("[\u0300-\u036f]+")
MIXED = re.compile("[a-z]")
NOTES = re.compile(r"\[\d+(?:\s*[-–,;]\s*\d+)*\]|</?[A-Za-z][^<>]{0,40}>")
#: Letters of other scripts that are drawn like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝοαικνρτυχ", "aeopcyxijsdhqwoaikvptux")


@dataclass(frozen=True)
class Tiling:
    seed: int = 3
    shortest: int = 3
    candidate_cover: float = 0.25
    cover: float = 0.5
    gap: int = 6
    bridge: int = 2
    part_words: int = 2_000_000
    most_seeds: int = 2_000_000


def normal_words(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if "[" in text or "<" in text:
        text = NOTES.sub(" ", text)
    if not text.isascii():
        text = HIDDEN.sub("", text)
    if "\n" in text:
        text = BROKEN.sub("", text)
    text = DECIMAL.sub("", text.lower())
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text).lower())
        words = (ANY_WORD if ALONE.search(text) else WORD).findall(text)
        if text.isascii():
            return words
        return [w if w.isascii() or not MIXED.search(w) else w.translate(LOOKALIKES) for w in words]
    return WORD.findall(text)


class Items:
    """Words of the items as numbers, and a sorted table of their seed runs."""

    def __init__(self, rows: list[tuple[int, str]], p: Tiling):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            words = normal_words(text)
            if words:
                self.ids.append(item)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        codes, where, place = [], [], []
        for n, w in enumerate(self.words):
            k = min(p.seed, len(w))
            for at in range(len(w) - k + 1):
                codes.append(self.code(w[at : at + k]))
                where.append(n)
                place.append(at)
        order = np.argsort(np.array(codes, np.uint64), kind="stable")
        self.codes = np.array(codes, np.uint64)[order]
        self.where, self.place = np.array(where, np.int32)[order], np.array(place, np.int32)[order]
        self.sizes = np.array([len(w) for w in self.words], np.int32)
        self.lengths = sorted({min(p.seed, len(w)) for w in self.words})

    @staticmethod
    def code(words) -> int:
        h = 0
        for w in words:
            h = (h * 0x9E3779B97F4A7C15 + int(w) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def runs(self, n: int, at: int, words: int, p: Tiling) -> list[int]:
        """Codes, as signed numbers, of the shortest runs in a tile of an item."""
        w = self.words[n][at : at + words]
        return [int(np.uint64(self.code(w[i : i + p.shortest])).view(np.int64)) for i in range(words - p.shortest + 1)]


def tiles(pattern: list[int], text: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in pattern, place in text, length)``, longest runs first, without overlap.

    Number 0 stands for words foreign to the pattern and matches nothing.
    """
    base, mod = 1_000_003, (1 << 61) - 1
    used_p, used_t = [False] * len(pattern), [w == 0 for w in text]
    found: list[tuple[int, int, int]] = []

    def windows(seq: list[int], used: list[bool], s: int):
        h, run, top = 0, 0, pow(base, s - 1, mod)
        for i, w in enumerate(seq):
            if used[i]:
                h, run = 0, 0
                continue
            if run >= s:
                h = (h - seq[i - s] * top) % mod
            h = (h * base + w) % mod
            run += 1
            if run >= s:
                yield h, i - s + 1

    s = 1
    while s * 2 <= min(len(pattern), len(text)):
        s *= 2
    while s >= shortest:
        at: dict[int, list[int]] = defaultdict(list)
        for h, i in windows(pattern, used_p, s):
            at[h].append(i)
        matches = []
        for h, j in windows(text, used_t, s):
            for i in at.get(h, ()):
                if i and j and not used_p[i - 1] and not used_t[j - 1] and pattern[i - 1] == text[j - 1]:
                    continue  # part of a longer run that began earlier
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n >= s:
                    matches.append((n, i, j))
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for n, i, j in matches:
            if any(used_p[i : i + n]) or any(used_t[j : j + n]):
                again = True
                continue
            used_p[i : i + n] = [True] * n
            used_t[j : j + n] = [True] * n
            found.append((i, j, n))
        if not again or not matches:
            s = s // 2 if s // 2 >= shortest or s == shortest else shortest
    return found


def coverage(found: list[tuple[int, int, int]], size: int, p: Tiling) -> tuple[float, float, list[tuple[int, int]]]:
    """Shares of the item's words in its two best stretches, matched and with bridged words, and their tiles ``(place, length)``."""
    stretches: list[tuple[int, int, list[tuple[int, int]]]] = []
    hit = bridged = 0
    parts: list[tuple[int, int]] = []
    last: tuple[int, int, int] | None = None
    for i, j, n in sorted(found, key=lambda t: t[1]):
        if last is not None:
            gap_t, gap_p = j - (last[1] + last[2]), i - (last[0] + last[2])
            if gap_t <= p.gap and 0 <= gap_p <= p.gap:
                bridged += min(gap_p, p.bridge)
                hit += n
                parts.append((i, n))
                last = (i, j, n)
                continue
            if gap_t <= p.gap and n < p.seed:
                continue  # a short stray run does not end a stretch
            stretches.append((hit + bridged, hit, parts))
        hit, bridged, last, parts = n, 0, (i, j, n), [(i, n)]
    if last is not None:
        stretches.append((hit + bridged, hit, parts))
    best = sorted(stretches, reverse=True)[:2]
    return sum(h for _, h, _ in best) / size, sum(c for c, _, _ in best) / size, [t for _, _, ts in best for t in ts]


def _numbered(texts: list[str | None], items: Items) -> tuple[list[int], list[int], np.ndarray]:
    """Texts with words, their numbers of words, and all words as the items' numbers (0: foreign)."""
    get = items.vocabulary.get
    rows, sizes, flat = [], [], []
    for i, t in enumerate(texts):
        words = normal_words(t) if t else ()
        if len(words) >= 1:
            rows.append(i)
            sizes.append(len(words))
            flat += [get(w, 0) for w in words]
    return rows, sizes, np.array(flat, np.uint64)


def _runs(w: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``k`` words, and the places of those without foreign words inside one text."""
    n = len(w) - k + 1
    code = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(k):
        part = w[j : j + n]
        code = code * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)
        known &= part > 0
    known &= owner[:n] == owner[k - 1 : k - 1 + n]
    return code, np.flatnonzero(known)


def leaks_in(texts: list[str | None], items: Items, p: Tiling) -> list[tuple[int, int, float, float, list[tuple[int, int]]]]:
    """``(text index, item index, matched, covered, tiles)`` of the texts of one batch."""
    rows, sizes, w = _numbered(texts, items)
    if not rows or not items.words:
        return []
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), sizes)
    pairs = []
    for k in items.lengths:
        if len(w) < k:
            continue
        code, at = _runs(w, owner, k)
        lo, hi = np.searchsorted(items.codes, code[at]), np.searchsorted(items.codes, code[at], side="right")
        many = hi - lo
        if many.sum() > p.most_seeds and len(texts) > 1:  # seeds that many items share: fewer texts at once
            half = len(texts) // 2
            later = [(i + half, *rest) for i, *rest in leaks_in(texts[half:], items, p)]
            return leaks_in(texts[:half], items, p) + later
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        if not len(at):
            continue
        seed = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(owner[at], many), items.where[seed], items.place[seed]], axis=1))
    if not pairs:
        return []
    hits = np.unique(np.concatenate(pairs), axis=0)
    new = np.concatenate([[True], (hits[1:, :2] != hits[:-1, :2]).any(axis=1)])
    first = np.flatnonzero(new)
    # words of the item under at least one seed: each seed adds as many words as it lies beyond the one before
    step = np.minimum(np.where(new, p.seed, np.diff(hits[:, 2], prepend=0)), p.seed)
    covered = np.add.reduceat(step, first)
    out = []
    for d, n in hits[first[covered >= p.candidate_cover * np.minimum(items.sizes[hits[first, 1]], 10_000)]][:, :2]:
        text = [int(x) for x in w[starts[d] : starts[d + 1]]]
        pattern = items.words[n]
        own = set(pattern)
        matched, share, parts = coverage(tiles(pattern, [x if x in own else 0 for x in text], p.shortest), len(pattern), p)
        if share >= p.cover:
            out.append((rows[d], int(n), matched, share, parts))
    return out


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, evals: DataFrame, item_id: str, item_text: str, params: Tiling = Tiling()) -> DataFrame:
    """``(doc_id, item_id, matched, covered)`` for every text and item whose wording it reproduces."""
    spark = docs.sparkSession
    known = evals.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    known = known.groupBy("i").agg(F.min("t").alias("t"))
    words = known.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0
    parts = int(words // params.part_words) + 1
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).where("d is not null and t is not null")
    out = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        items = Items([(r["i"], r["t"]) for r in mine.orderBy("i").collect()], params)  # at most part_words words
        sent = spark.sparkContext.broadcast(items)
        found = materialize(rows.mapInArrow(_scan(sent, params), PASSAGES), "passages")
        found = _without_turns(found, rows, sent, params)
        out = found if out is None else out.unionByName(found)
    return out


def _without_turns(found: DataFrame, rows: DataFrame, sent, p: Tiling) -> DataFrame:
    """The passages matched for the most part, and of the others those that do not consist of turns of speech."""
    total = lambda tiles: F.aggregate(tiles, F.lit(0), lambda s, t: s + t["words"])
    long_runs = total(F.filter("tiles", lambda t: t["words"] > p.shortest)) / F.greatest(total(F.col("tiles")), F.lit(1))
    found = found.withColumn("doubtful", F.col("matched") * long_runs < p.cover)
    doubtful = found.where("doubtful")
    run = F.explode(F.array_distinct(F.flatten("tiles.runs"))).alias("run")
    asked = [r["run"] for r in doubtful.select(run).distinct().collect()]  # runs of the items of one part
    columns = ["doc_id", "item_id", "matched", "covered"]
    if not asked:
        return found.select(columns)
    codes = found.sparkSession.sparkContext.broadcast(np.sort(np.array(asked, np.int64)))
    texts = rows.mapInArrow(_counted_runs(sent, codes, p), "run bigint, texts bigint").groupBy("run").agg(F.sum("texts").alias("texts"))
    here = found.select("item_id", run).groupBy("item_id", "run").agg(F.count("*").alias("here"))
    turns = here.join(texts, "run").where("texts - here > here").groupBy("item_id").agg(F.collect_set("run").alias("turns"))
    judged = doubtful.join(turns, "item_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<bigint>")))
    own = F.filter("tiles", lambda t: F.size(F.array_except(t["runs"], F.col("turns"))) > 0)
    judged = judged.where(2 * total(own) >= total(F.col("tiles")))
    return found.where("not doubtful").select(columns).unionByName(judged.select(columns))


def _counted_runs(sent, asked, p: Tiling):
    """``(run, texts)``: in how many texts of a task each asked run occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, codes = sent.value, asked.value
        texts = np.zeros(len(codes), np.int64)
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                rows, sizes, w = _numbered(whole.column(1).slice(s, 2000).to_pylist(), items)
                if len(w) < p.shortest:
                    continue
                owner = np.repeat(np.arange(len(rows), dtype=np.int64), sizes)
                code, at = _runs(w, owner, p.shortest)
                mine = code[at].view(np.int64)
                place = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
                hit = codes[place] == mine
                met = np.unique(np.stack([owner[at[hit]], place[hit]], axis=1), axis=0)
                texts += np.bincount(met[:, 1], minlength=len(codes))
        yield pa.RecordBatch.from_arrays([pa.array(codes[texts > 0]), pa.array(texts[texts > 0])], ["run", "texts"])

    return run


def _scan(sent, p: Tiling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                hits = leaks_in(b.column(1).to_pylist(), items, p)
                if hits:
                    i, n, m, c, parts = zip(*hits)
                    tiles_ = [[{"words": k, "runs": items.runs(x, at, k, p)} for at, k in ts] for x, ts in zip(n, parts)]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(i)), pa.array([items.ids[x] for x in n], pa.int64()), pa.array(m, pa.float64()), pa.array(c, pa.float64()),
                        pa.array(tiles_, TILES),
                    ], ["doc_id", "item_id", "matched", "covered", "tiles"])

    return run
