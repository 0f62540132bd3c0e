from papyrine.llm import mixing as M


def frames(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, mix_id string, copies int")
    t = spark.createDataFrame(targets, "mix_id int, source string, target_weight double, max_repeats int")
    return d, t


def test_shares_and_caps(spark):
    docs = [(i, "some words of text here " * (1 + i % 5), "Big-Source" if i % 4 else " small", "x", 1) for i in range(400)]
    docs += [(1000, None, "small", "x", 1), (1001, "", "small", "x", 1), (1002, "text", None, "x", 1), (None, "text", "small", "x", 1)]
    targets = [(1, "big_source", 1.0, 1), (1, "SMALL", 1.0, 3), (1, "absent", 2.0, 1), (2, "small", None, 2), (2, "big_source", 5.0, None), (None, "small", 1.0, 1), (3, None, 1.0, 1)]
    d, t = frames(spark, docs, targets)
    counts, planned = M.prepare(d, "doc_id", "text", "source", t)
    mixed = M.mixture(counts, planned)
    rows = {(r["mix_id"], r["source"]): r for r in M.shares(planned, mixed).collect()}
    assert abs(rows[1, "small"]["reached_share"] - 0.5) < 0.03 and rows[1, "small"]["most_copies"] <= 3
    assert rows[1, "absent"]["reached_tokens"] == 0 and rows[2, "big_source"]["reached_share"] == 1.0 and (2, "small") not in rows
    assert {r["copies"] for r in mixed.where("mix_id = 2").collect()} == {1}
    assert mixed.groupBy("mix_id", "id").count().where("count > 1").count() == 0
    small = M.shares(M.plan(counts, t, total_tokens=500), M.mixture(counts, M.plan(counts, t, total_tokens=500))).where("mix_id = 1")
    assert 300 < sum(r["reached_tokens"] for r in small.collect()) < 700


def test_same_rows_every_time(spark):
    docs = [(i, f"text {i} " * 3, "a", "x", 1) for i in range(200)]
    d, t = frames(spark, docs, [(1, "a", 1.0, 1)])
    pick = lambda: sorted((r["id"], r["copies"]) for r in M.mixture(*M.prepare(d.repartition(7), "doc_id", "text", "source", t, total_tokens=600)).collect())
    assert pick() == pick() and 0 < len(pick()) < 200


def test_empty(spark):
    d, t = frames(spark, [], [(1, "a", 1.0, 1)])
    counts, planned = M.prepare(d, "doc_id", "text", "source", t)
    assert M.mixture(counts, planned).count() == 0 and M.shares(planned, M.mixture(counts, planned)).first()["reached_tokens"] == 0


def test_slots_do_not_change_the_result(spark):
    """A hot source of one length class is spread over as many slots as its rows need."""
    docs = [(i, f"text {i % 7} here", "a" if i % 3 else "b", "x", 1) for i in range(600)]
    d, t = frames(spark, docs, [(1, "a", 1.0, 1), (1, "b", 1.0, 2)])
    counts, planned = M.prepare(d, "doc_id", "text", "source", t)
    pick = lambda n: sorted(map(tuple, M.mixture(counts, planned, slots=n).collect()))
    assert pick(1) == pick(64) == pick(1000) and len(pick(1)) > 100
