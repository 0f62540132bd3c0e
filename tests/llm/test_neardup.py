import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import neardup as D

WORDS = [f"w{i}" for i in range(400)]


def similarity(a, b):
    x, y = Counter(D.WORD.findall(a.lower())), Counter(D.WORD.findall(b.lower()))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randint(40, 90))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, 14)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            rng.shuffle(other)
            out.append(" ".join(other))
    return out


def test_against_brute_force(spark):
    texts = [*corpus(1), "short text", "", None, "   "]
    rows = [(i, t, "k", 0) for i, t in enumerate(texts)] + [(None, texts[0], "k", 0)]
    df = spark.createDataFrame(rows, "row_id long, content string, kind string, n int")
    found = D.all_pairs(*D.near_duplicates([(df, "row_id", "content"), (df.limit(0), "row_id", "content")]))
    got = {(r["a"], r["b"]) for r in found.collect()}
    real = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 40]
    want = {(i, j) for i, s in real for j, t in real if i < j and similarity(s, t) >= 0.7}
    assert got == want and len(want) > 20


def test_copies_beyond_the_bound(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(60)]
    near = [*base[:-4], "x1", "x2", "x3", "x4"]
    rows = [(i, " ".join(base)) for i in range(100)] + [(200, " ".join(near)), (201, " ".join(reversed(near)))]
    df = spark.createDataFrame(rows, "row_id long, content string")
    pairs, members = D.near_duplicates([(df, "row_id", "content")])
    got = {(r["a"], r["b"]) for r in D.all_pairs(pairs, members).collect()}
    assert {(0, i) for i in range(1, 100)} <= got and (200, 201) in got and (0, 200) in got and (0, 201) in got and len(got) == 102
    groups = D.classes(pairs, members).collect()
    assert len(groups) == 102 and {r["class_id"] for r in groups} == {0} and {r["id"]: r["links"] for r in groups} == {**{i: 101 for i in range(100)}, 200: 101, 201: 101}


def test_many_reorderings_are_different_texts(spark):
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(60)]
    texts = [" ".join(base[i:] + base[:i]) for i in range(50)] + [" ".join(base[i:] + base[:i]).upper() for i in range(20)]
    near = " ".join([*base[:-4], "x1", "x2", "x3", "x4"])
    rows = list(enumerate([*texts, near])) + [(100 + i, texts[3]) for i in range(70)]
    got = D.all_pairs(*D.near_duplicates([(spark.createDataFrame(rows, "row_id long, content string"), "row_id", "content")]))
    got = [(r["a"], r["b"]) for r in got.collect()]
    want = {(a, b) for a in range(71) for b in range(a + 1, 71)} | {(3, 100 + i) for i in range(70)}
    assert set(got) == want and len(got) == len(want)


def test_hot_blocks_are_tiled(spark):
    texts = corpus(2)
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, content string")
    pick = lambda p: {(r["a"], r["b"]) for r in D.all_pairs(*D.near_duplicates([(df, "row_id", "content")], params=p)).collect()}
    assert pick(D.Sketch()) == pick(D.Sketch(tile_rows=2, chunk_rows=20))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 9), st.integers(0, 2**31))
def test_bit_slices_against_popcount(n, blocks, seed):
    rng = np.random.default_rng(seed)
    sk = rng.integers(0, 256, (n, 24)).astype(np.uint8)
    sk[1::2] = sk[0::2][: len(sk[1::2])] ^ (rng.random((len(sk[1::2]), 24)) < 0.2)
    block = np.sort(rng.integers(0, blocks, n))
    size = rng.integers(40, 80, n)
    i, j = D.close_pairs(sk, block, size, 54, 0.7)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    dist = np.bitwise_count(sk[:, None] ^ sk[None, :]).sum(axis=2)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if block[a] == block[b] and dist[a, b] <= 54 and min(size[a], size[b]) >= 0.7 * max(size[a], size[b])}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "row_id long, content string")
    pairs, members = D.near_duplicates([(df, "row_id", "content")])
    assert D.all_pairs(pairs, members).count() == 0 and D.classes(pairs, members).count() == 0
