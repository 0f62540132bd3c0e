import random

import numpy as np
import pytest

from papyrine.llm import abuse as A

PLACES = [f"Place{i}" for i in range(60)]
NICE = ["The trial at {} measured dose levels in adults.", "Thanks everyone, the scan in {} was fine.", "We compared two drugs in {} cohorts.", "I am so angry that the clinic in {} lost my results."]
BAD = ["You stupid worthless clown from {}, crawl back and choke.", "Those filthy people of {} breed like rats and must vanish."]


def example(rng, bad):
    lines = [rng.choice(NICE).format(rng.choice(PLACES)) for _ in range(rng.randint(2, 6))]
    if bad:
        lines.insert(rng.randint(0, len(lines)), rng.choice(BAD).format(rng.choice(PLACES)))
    return " ".join(lines)


def data(n, seed):
    rng = random.Random(seed)
    y = np.array([int(rng.random() < 0.3) for _ in range(n)])
    return [example(rng, b) for b in y], y


def test_held_out_accuracy():
    x, y = data(400, 1)
    flipped = y.copy()
    flipped[::40] = 1 - flipped[::40]
    p = A.Machine()
    model = A.fit(x, flipped, p)
    tx, ty = data(300, 2)
    got = A.score_texts(tx, model, p) >= p.threshold
    assert (got == ty).mean() > 0.97
    hidden = "The scan was fine. You st_upid w0rthless cLoWn from Place3, crawl back and choke. Done."
    assert A.score_texts([hidden], model, p)[0] >= p.threshold
    assert A.score_texts(["", None, "   ", "." * 50], model, p).tolist() == [0, 0, 0, 0]


def test_the_machine_needs_its_factors():
    """Two words that are harmless alone and bad together: additive weights cannot tell."""
    rng = random.Random(3)
    x, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["alpha"] * a + ["beta"] * b + [rng.choice(["x", "y", "z"]) for _ in range(2)]
        words += ["gamma"] * (not a) + ["delta"] * (not b)
        rng.shuffle(words)
        x.append(" ".join(words))
        y.append(int(a == b))
    p = A.Machine(steps=200, rounds=2)
    model = A.fit(x, np.array(y), p)
    assert ((A.score_texts(x, model, p) >= 0.5) == np.array(y)).mean() > 0.9


@pytest.mark.parametrize(("word", "want"), [("iDiOt", "idiot"), ("id.iot", "idiot"), ("w0rthl3$$", "worthless"), ("worttthless", "worthless"), ("dumbаss", "dumbass"), ("imbécile", "imbecile"), ("1995", "0"), ("b*****d", "b*d")])
def test_fold(word, want):
    assert A.fold(word)[0] == want


def test_frames(spark):
    x, y = data(200, 5)
    docs = spark.createDataFrame([*enumerate(x), (900, None), (901, ""), (None, "x"), (902, BAD[0].format("Here") + " fine." * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, None), (None, 1), (5000, 1)], "doc_id long, flagged int")
    got = {r["id"]: r["flagged"] for r in A.scores(docs, "doc_id", "text", labels, "doc_id", "flagged").collect()}
    assert len(got) == 203 and not got[900] and not got[901] and got[902]
    assert np.mean([got[i] == bool(v) for i, v in enumerate(y)]) > 0.95
    none = A.scores(docs, "doc_id", "text", labels.where("flagged = 0"), "doc_id", "flagged")
    assert none.where("flagged").count() == 0 and none.count() == 203
    assert A.scores(docs.limit(0), "doc_id", "text", labels, "doc_id", "flagged").count() == 0


def test_wrong_labels_teach_nothing():
    """One label in seven of the bad ones is wrong; what those texts say must not be flagged elsewhere."""
    x, y = data(900, 9)
    rng = random.Random(4)
    wrong = [i for i in range(900) if not y[i]][::20]
    given = y.copy()
    given[wrong] = 1
    model = A.fit(x, given, A.Machine())
    got = A.score_texts([x[i] for i in wrong] + [example(rng, False) for _ in range(300)], model, A.Machine()) >= A.Machine().threshold
    assert got.mean() < 0.02


def test_long_labelled_texts_are_sampled_not_left_out(spark):
    x, y = data(60, 6)
    x[0], y[0] = BAD[0].format("Here") + " Fine." * 30000, 1
    docs = spark.createDataFrame(list(enumerate(x)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, flagged int")
    assert A.train(docs, "doc_id", "text", labels, "doc_id", "flagged", A.Machine(passages_per_text=5)) is not None
