import numpy as np

from papyrine.operators import retrieval


def test_bm25_by_scan_and_by_join_agree(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(300)] + [(900, None), (901, ""), (None, "w1 w2")]
    asked = [(q, " ".join(rng.choice(words, 4))) for q in range(7)] + [(50, "absent"), (51, None), (None, "w1"), (1, "w3 w3")]
    d = spark.createDataFrame(docs, "key long, content string").repartition(5)
    q = spark.createDataFrame(asked, "query long, text string")
    pick = lambda **kw: sorted(map(tuple, retrieval.bm25_topk(d.where("key is not null"), "key", q.where("query is not null"), "query", k=6, **kw).collect()))
    assert pick() == pick(most_terms=0) and len(pick()) == 42
    assert retrieval.bm25_topk(d, "key", q, "query", k=6).where("key is null or query is null").count() == 0
    assert retrieval.bm25_topk(d.limit(0), "key", q, "query").count() == 0 and retrieval.bm25_topk(d, "key", q.limit(0), "query").count() == 0


def test_best_rows_over_batches():
    rng = np.random.default_rng(5)
    best = retrieval._Best(3)
    rows = []
    for _ in range(6):
        q, c, s = rng.integers(0, 4, 20), rng.integers(0, 1000, 20), np.round(rng.random(20), 1)
        best.add(q, c, s)
        rows += zip(q.tolist(), c.tolist(), s.tolist())
    want = [r for n in range(4) for r in sorted((r for r in rows if r[0] == n), key=lambda r: (-r[2], r[1]))[:3]]
    got = list(zip(*(x.tolist() for x in best.rows)))
    assert got == want and best.floor(5).tolist() == [min(r[2] for r in want if r[0] == n) for n in range(4)] + [-np.inf]
