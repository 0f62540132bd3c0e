"""Scores for abusive, hateful or sexual passages, by a factorization machine over hashed terms.

A text is cut into passages: at sentence ends and lines, and long pieces into overlapping windows. The terms of a
passage are its words in a folded spelling (case, accents, look-alike letters, digits for letters, letters repeated,
spaced or separated, hidden characters) and pairs of neighbours, hashed. The machine adds a weight per term and the
inner products of the factors of all pairs of terms, so an insult together with the mention of a group, or a harsh
word together with a quoting verb, counts otherwise than its parts. The score of a text is that of its worst passage.

Labels hold for whole texts, so training alternates: the worst passages of each labelled text under the current
weights stand for it, then weights and factors are fitted. A wrong label would teach the machine harmless wording, so the
labels are reviewed first: machines fitted on the other folds score each text, and labels they contradict are left out;
twice, the second time by machines without the labels left out before. Training runs on a bounded sample of labelled rows.

Defined results
* A text is labelled by the majority of its non-null labels; ties are left out.
* Null and blank texts have score 0; without any positive or any negative label all scores are 0 and nothing is flagged.
* Every text is scored, copies included; texts are never cut off. Rows with a null id are skipped.
* Below ``least_labels`` labels of a class in the other folds no label is doubted.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.scratch import materialize

_W = "[^\\W_぀-ヿ㐀-鿿]"
TOKEN = re.compile(rf"[぀-ヿ㐀-鿿]|[$@]?{_W}(?:{_W}|[_*$@]|[.'’!|-](?=[a-z$@]))*|[.!?。！？\n]+|[“”\"«»„「」]")
HIDDEN = re.compile("[­​-‏⁠﻿]")
MARKS = re.compile("[̀-ͯ]+")
REPEATED = re.compile(r"(.)\1\1+")
STARS = re.compile(r"\*+")
# Letters of other scripts drawn like Latin ones, and signs typed for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝο", "aeopcyxijsdhqwo")
SIGNS = str.maketrans("01345789$@!|", "oieastbgsail")


@dataclass(frozen=True)
class Machine:
    """label_rows bounds the labelled texts per class that the machine is fitted on, passages_per_text the passages drawn of one."""

    label_rows: int = 5_000
    passages_per_text: int = 400
    bits: int = 20
    factors: int = 6
    window: int = 22
    stride: int = 11
    rounds: int = 3
    steps: int = 25
    worst_harmless: int = 2
    threshold: float = 0.35
    least_texts: int = 2
    folds: int = 3
    reviews: int = 2
    least_labels: int = 20
    doubt: float = 0.03
    decay: float = 0.3


def fold(word: str) -> tuple[str, bool]:
    """The folded spelling of one word, and whether it was disguised."""
    w = word.lower()
    odd = False
    if not w.isascii():
        if re.search("[a-z]", w) and re.search("[а-яѐ-џԁһԛԝο]", w):
            odd = True
        if odd or not re.search("[Ѐ-ӿ]", w):
            w = MARKS.sub("", unicodedata.normalize("NFKD", w.translate(LOOKALIKES)))
    if not w.isalpha():
        if w.isdigit():
            return "0", False
        bare = re.sub(r"[._'’-]", "", w)
        if "*" in bare:
            return STARS.sub("*", bare), True
        if re.search("[a-z]", bare) and not bare.isalpha():
            if not word.isupper() and not re.fullmatch(r"\d+[a-z]{1,3}|[A-Z]+\d+|[a-z]+\d+", word):
                w, odd = bare.translate(SIGNS), True
            else:
                w = re.sub(r"\d+", "0", bare)
        else:
            odd = odd or "." in w or "_" in w
            w = bare
    if REPEATED.search(w):
        w, odd = REPEATED.sub(r"\1", w), True
    if re.search("[a-z][A-Z]", word) and word[0].islower() and word.isalpha():
        odd = True
    return w, odd


_terms: dict[str, int] = {}
BREAK = 0


def _number(word: str) -> int:
    """63-bit number of a word's folded spelling; the lowest bit tells a disguised one, 0 is a break."""
    if word[0] in ".!?。！？\n":
        return BREAK
    w, odd = fold(word)
    data = w.encode("utf-8", "surrogatepass")
    h = (zlib.crc32(data) << 32 | zlib.crc32(data, 0x9E3779B9)) & 0x7FFFFFFFFFFFFFFE
    return (h | 2) + int(odd)


def tokens(text: str) -> list[int]:
    if not text.isascii():
        text = HIDDEN.sub("", text)
    found = TOKEN.findall(text)
    try:
        return [_terms[w] for w in found]
    except KeyError:
        if len(_terms) > 1_000_000:
            _terms.clear()
        for w in found:
            if w not in _terms:
                _terms[w] = _number(w)
        return [_terms[w] for w in found]


SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")


def _join_spaced(text: str) -> str:
    return SPACED.sub(lambda m: m[0].replace(" ", "") + " spaced*out", text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def passages(texts: list[str | None], p: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner of each passage, start of each passage's terms, hashed terms)``."""
    flat: list[int] = []
    owner_sizes = []
    for t in texts:
        n = tokens(_join_spaced(t)) if t else []
        flat += n
        flat.append(BREAK)
        owner_sizes.append(len(n) + 1)
    w = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(texts)), owner_sizes)
    stop = w == BREAK
    # runs between breaks, then windows over long runs
    ends = np.flatnonzero(stop)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    keep = size > 0
    starts, size = starts[keep], size[keep]
    count = np.maximum(1, np.ceil((size - p.window) / p.stride).astype(np.int64) + 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(starts, count) + nth * p.stride
    length = np.minimum(p.window, np.repeat(starts + size, count) - begin)
    at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    own = np.repeat(np.arange(len(begin)), length)
    mask = np.uint64((1 << p.bits) - 1)
    one = _mix(w >> np.uint64(1)) & mask
    pair = _mix((w[:-1] >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (w[1:] >> np.uint64(1))) & mask if len(w) > 1 else np.empty(0, np.uint64)
    terms = [one[at]]
    who = [own]
    inner = np.flatnonzero(np.concatenate([own[1:] == own[:-1], [False]])) if len(own) else np.empty(0, np.int64)
    terms.append(pair[at[inner]])
    who.append(own[inner])
    odd = (w[at] & np.uint64(1)) == 1
    terms.append(np.full(odd.sum(), 1, np.uint64))
    who.append(own[odd])
    who, terms = np.concatenate(who), np.concatenate(terms).astype(np.int64)
    order = np.argsort(who, kind="stable")
    return owner[begin], who[order], terms[order]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows between neighbouring bounds; an empty range gives 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0)
    return out


def _score(bounds: np.ndarray, x: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of passages, whose terms stand between the bounds, and their factor sums."""
    v = factor[x]
    sums = _sums(v, bounds)
    squares = _sums(np.einsum("ij,ij->i", v, v), bounds)
    return bias + _sums(weight[x], bounds) + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares), sums


def _bounds(who: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(who, np.arange(n + 1))


def _probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _fit(cut: tuple, y: np.ndarray, use: np.ndarray, p: Machine, seed: int = 5) -> dict:
    """Bias, weights and factors over the hashed terms of the passages ``cut`` (see ``passages``) of the texts in ``use``."""
    owner, who, terms = _part(cut, use)
    rng = np.random.default_rng(seed)
    size = 1 << p.bits
    seen = owner[who].astype(np.int64) * size + terms
    seen.sort()
    seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
    doc, term = seen // size, seen % size
    total = np.bincount(term, minlength=size)
    yes = np.bincount(term, y[doc], minlength=size)
    used = np.flatnonzero(total >= p.least_texts)
    slot = np.zeros(size, np.int32)
    slot[used] = np.arange(1, len(used) + 1)  # slot 0: terms of fewer texts have no say
    x = slot[terms]
    keep = x > 0
    who, x = who[keep], x[keep]
    n_yes = y[use].sum()
    n_no = use.sum() - n_yes
    w = np.zeros(len(used) + 1, np.float32)
    w[1:] = 0.3 * (np.log((yes[used] + 0.5) / (n_yes + 1)) - np.log((total[used] - yes[used] + 0.5) / (n_no + 1)))
    v = rng.normal(0, 0.02, (len(used) + 1, p.factors)).astype(np.float32)
    v[0] = 0
    bias = -2.0
    bounds = _bounds(who, len(owner))
    for _ in range(p.rounds):
        raw, _ = _score(bounds, x, bias, w, v)
        order = np.lexsort((-raw, owner))
        first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        chosen = np.sort(order[rank < np.where(y[owner[order]] == 1, 1, p.worst_harmless)])
        target = y[owner[chosen]]
        sizes = bounds[chosen + 1] - bounds[chosen]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(bounds[chosen] - ends[:-1], sizes) + np.arange(ends[-1])
        here, cx = np.unique(x[at], return_inverse=True)  # only these terms move
        by = np.argsort(cx, kind="stable")
        of_term = np.repeat(np.arange(len(chosen)), sizes)[by]
        term_ends = np.concatenate([[0], np.cumsum(np.bincount(cx, minlength=len(here)))])
        values = [w[here], v[here], bias]
        m, s = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        for step in range(1, p.steps + 1):
            lw, lv, bias = values
            raw, sums = _score(ends, cx, bias, lw, lv)
            error = (_probability(raw) - target).astype(np.float32)[:, None]
            g = _sums(np.concatenate([error, error * sums], axis=1)[of_term], term_ends)
            grads = [g[:, 0] + p.decay * lw, g[:, 1:] - lv * g[:, :1] + 2 * p.decay * lv, float(error.sum())]
            for i, (rate, g) in enumerate(zip((0.05, 0.02, 0.05), grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                values[i] = values[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)
        w[here], v[here], bias = values
        w[0], v[0] = 0, 0
    strong = np.flatnonzero((np.abs(w[1:]) > 0.03) | ((v[1:] ** 2).sum(axis=1) > 0.003))
    table = np.zeros(size, np.int32)
    table[used[strong]] = np.arange(1, len(strong) + 1)
    return {"bias": float(bias), "table": table, "weight": np.concatenate([w[:1], w[1:][strong]]), "factor": np.concatenate([v[:1], v[1:][strong]])}


def _part(cut: tuple, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages of some of the texts."""
    owner, who, terms = cut
    mine = use[owner]
    inside = mine[who]
    return owner[mine], (np.cumsum(mine) - 1)[who[inside]], terms[inside]


def _worst(cut: tuple, model: dict, n: int) -> np.ndarray:
    """Scores of n texts: that of the worst passage of each."""
    owner, who, terms = cut
    x = model["table"][terms]
    keep = x > 0
    raw, _ = _score(_bounds(who[keep], len(owner)), x[keep], model["bias"], model["weight"], model["factor"])
    out = np.zeros(n)
    np.maximum.at(out, owner, _probability(raw))
    return out


def _both(y: np.ndarray, use: np.ndarray) -> bool:
    return 0 < y[use].sum() < use.sum()


def _held_out(cut: tuple, y: np.ndarray, sure: np.ndarray, fold: np.ndarray, k: int, p: Machine) -> tuple[np.ndarray, np.ndarray]:
    """The texts of fold k and their scores by a machine fitted on the sure labels of the others. With too few labels to judge
    others by, each score is the label."""
    mine = fold == k
    use = sure & ~mine
    if min(y[use].sum(), use.sum() - y[use].sum()) < p.least_labels:
        return np.flatnonzero(mine), y[mine].astype(float)
    return np.flatnonzero(mine), _worst(_part(cut, mine), _fit(cut, y, use, p), len(y))[mine]


def _agrees(y, score, p: Machine):
    """Whether a label stands: not contradicted by the machine fitted without it. For arrays and for columns."""
    return ~(((y == 1) & (score < p.doubt)) | ((y == 0) & (score > 1 - p.doubt)))


def fit(texts: list[str], labels: np.ndarray, p: Machine) -> dict:
    """The machine fitted on these texts in this process; ``train`` does the same on the cluster."""
    cut = passages(texts, p)
    sure = np.ones(len(texts), bool)
    fold = np.arange(len(texts)) % p.folds
    for _ in range(p.reviews):
        seen = np.zeros(len(texts))
        for k in range(p.folds):
            at, score = _held_out(cut, labels, sure, fold, k, p)
            seen[at] = score
        sure = _agrees(labels, seen, p)
    return _fit(cut, labels, sure if _both(labels, sure) else np.ones(len(texts), bool), p)


def score_texts(texts: list[str | None], model: dict, p: Machine) -> np.ndarray:
    return _worst(passages(texts, p), model, len(texts))


def _apply(sent, p: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(b.column(1).to_pylist(), model, p))], ["id", "score"])

    return run


CUT = "id bigint, y int, fold int, starts binary, terms binary"


def _cut_up(p: Machine):
    """Each text as its passages: where their terms start, and the terms. Of more than ``passages_per_text`` a sample is drawn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, y, text in zip(f["id"], f["y"], f["t"]):
                _, who, terms = passages([text], p)
                ends = np.concatenate([[0], np.cumsum(np.bincount(who))]) if len(who) else np.zeros(1, np.int64)
                n = len(ends) - 1
                if n > p.passages_per_text:
                    some = np.sort(np.random.default_rng(i & 0x7FFFFFFF).choice(n, p.passages_per_text, replace=False))
                    terms = np.concatenate([terms[a:b] for a, b in zip(ends[some], ends[some + 1])])
                    ends = np.concatenate([[0], np.cumsum(ends[some + 1] - ends[some])])
                out.append((i, y, (i * 2654435761 >> 8) % p.folds, ends.astype(np.int32).tobytes(), terms.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["id", "y", "fold", "starts", "terms"])

    return run


def _cut_of(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = [np.frombuffer(b, np.int32) for b in f["starts"]]
    count = [len(e) - 1 for e in ends]
    owner = np.repeat(np.arange(len(f)), count)
    sizes = np.concatenate([np.diff(e) for e in ends])
    return owner, np.repeat(np.arange(len(owner)), sizes), np.concatenate([np.frombuffer(b, np.int32) for b in f["terms"]])


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, flag: str, params: Machine = Machine()) -> dict | None:
    """The fitted machine, or None where one class has no labels.

    The sample is cut up and the machines are fitted in executors, one task per fold; only the last machine comes to the driver.
    """
    p = params
    votes = labels.where(F.col(flag).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("id")).agg(F.avg(F.col(flag).cast("double")).alias("v"))
    order = F.xxhash64("id")
    picked = [votes.where(c).orderBy(order).limit(p.label_rows).withColumn("y", F.lit(y)) for c, y in (("v > 0.5", 1), ("v < 0.5", 0))]
    few = picked[0].unionByName(picked[1]).select("id", "y")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(few), "id")  # bounded by label_rows
    rows = rows.groupBy("id", "y").agg(F.min("t").alias("t"))  # one text per id
    sample = materialize(rows.mapInPandas(_cut_up(p), CUT), "labelled")

    def held_out(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        at, score = _held_out(_cut_of(f), f["y"].to_numpy(), f["sure"].to_numpy(), f["fold"].to_numpy(), int(f["k"].iloc[0]), p)
        return pd.DataFrame({"id": f["id"].to_numpy()[at], "score": score})

    def last(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        y, sure = f["y"].to_numpy(), f["sure"].to_numpy()
        sure = sure if _both(y, sure) else np.ones(len(f), bool)
        return pd.DataFrame({"model": [pickle.dumps(_fit(_cut_of(f), y, sure, p))] if _both(y, sure) else []})

    now = sample.withColumn("sure", F.lit(True))
    for _ in range(p.reviews):
        each = now.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(p.folds)])))
        seen = each.groupBy("k").applyInPandas(held_out, "id bigint, score double").dropDuplicates(["id"])
        now = sample.join(seen, "id").withColumn("sure", _agrees(F.col("y"), F.col("score"), p)).drop("score")
    found = now.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(last, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def scores(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, flag: str, params: Machine = Machine()) -> DataFrame:
    """``(id, score, flagged)`` of every text."""
    model = train(docs, doc_id, text, labels, label_id, flag, params)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null")
    if model is None:
        out = rows.select("id", F.lit(0.0).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hash values
        out = rows.mapInArrow(_apply(sent, params), "id bigint, score double")
    return out.withColumn("flagged", F.col("score") >= params.threshold)
