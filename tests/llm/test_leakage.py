import random

import pytest

from papyrine.llm import leakage as L

ITEM = "The quick brown fox jumped over the lazy dog while seven grey wolves watched from the frozen hill above the silent village near Oslo in 1995."
WORDS = [f"word{i}" for i in range(500)]


def filler(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hit(text, item=ITEM):
    return bool(L.leaks_in([text], L.Items([(1, item)], L.Tiling()), L.Tiling()))


def halves():
    w = ITEM.split()
    return " ".join(w[:12]), " ".join(w[12:])


@pytest.mark.parametrize("text", [
    ITEM, filler(300) + " " + ITEM + " " + filler(300), ITEM.upper().replace(" ", "  "), ITEM.replace("o", "ο").replace("fi", "ﬁ"),
    " ".join(reversed(halves())), halves()[0] + " " + filler(40) + " " + halves()[1], ITEM.replace("jumped", "leapt").replace("frozen ", ""),
    " ".join(ITEM.split()[5:22]), ITEM.replace("wolves", "wol­ves").replace("quick", "<b>quick</b>").replace("dog", "dog [12]"),
])
def test_leaks(text):
    assert hit(text)


@pytest.mark.parametrize("text", [filler(200), "the lazy dog " * 20, "The quick brown fox jumped over the " + filler(50), None, "", "   "])
def test_no_leaks(text):
    assert not hit(text)


def brute_tiles(p, t, shortest):
    """Longest common unmarked run again and again."""
    up, ut, found = [0] * len(p), [0] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not up[i + n] and not ut[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return found
        up[i : i + n] = [1] * n
        ut[j : j + n] = [1] * n
        found += n


def test_tiles_against_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        p = [rng.randint(1, 9) for _ in range(rng.randint(3, 30))]
        t = [rng.randint(1, 9) for _ in range(rng.randint(3, 40))]
        got = L.tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in got)
        assert abs(sum(n for _, _, n in got) - brute_tiles(p, t, 3)) <= 3


def test_frames(spark):
    docs = spark.createDataFrame([(1, ITEM, 9), (1, ITEM, 9), (2, None, 9), (3, "", 9), (None, ITEM, 9), (4, filler(20000) + ITEM, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "x"), (8, None, "x"), (9, " . ", "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    run = lambda p: sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, "doc_id", "text", items, "item_id", "text", p).collect())
    assert run(L.Tiling()) == [(1, 7), (1, 7), (4, 7)] == run(L.Tiling(part_words=5))
    assert L.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_half_of_the_wording():
    item = " ".join(f"own{i}" for i in range(40))
    assert hit(" ".join(item.split()[10:30]), item) and hit(filler(50) + " " + " ".join(item.split()[3:24]), item)
    assert not hit(" ".join(item.split()[10:29]), item)


def test_altered_passages_and_turns_of_speech(spark):
    """Both texts match 20 of 44 words and 23 with the altered ones; only the runs of the second item are met elsewhere."""
    own, turns = ([f"{k}{i}" for i in range(44)] for k in ("own", "turn"))
    altered = lambda w: " ".join(x if i % 6 < 5 else "altered" for i, x in enumerate(w[:23]))
    docs = [(1, filler(60) + " " + altered(own)), (2, filler(60) + " " + altered(turns)), (5, "")]
    docs += [(10 + i, filler(30, i) + " " + " ".join(turns[6 * (i % 4) : 6 * (i % 4) + 5])) for i in range(16)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(own)), (8, " ".join(turns))], "item_id long, text string")
    found = L.find_leaks(frame, "doc_id", "text", items, "item_id", "text").collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 7)]
    assert found[0]["matched"] < 0.5 <= found[0]["covered"] < 0.55


def test_every_fourth_word_altered():
    item = [f"own{i}" for i in range(25)]
    assert hit(filler(30) + " " + " ".join("other" if i % 4 == 3 else w for i, w in enumerate(item)), " ".join(item))
    assert hit(filler(30) + " " + " ".join(item[6:19]), " ".join(item))


def test_scripts_without_blanks():
    item = "给予受试者三周药物后观察到炎症性反应明显下降而其他指标没有变化并在随访中得到证实"
    assert hit("前言不同。" + item[2:28] + "，结束", item) and not hit("前言不同。" + item[2:9] + "，结束", item)
    assert L.normal_words("ab中文c กข") == ["ab", "中", "文", "c", "ก", "ข"]


def test_seeds_that_many_items_share():
    items = L.Items([(i, ITEM + f" tail{i} more{i}") for i in range(40)], L.Tiling())
    few = L.leaks_in([ITEM, filler(9), ITEM], items, L.Tiling(most_seeds=50))
    assert few == L.leaks_in([ITEM, filler(9), ITEM], items, L.Tiling()) and len(few) == 80
