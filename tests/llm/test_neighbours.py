import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyrine.llm.neighbours import CentroidGraph, Lists, fit_centroids, knn, unit_rows

SCHEMA = "vec_id long, embedding array<float>, id string, v int, rank string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in vectors], SCHEMA)


def test_unusable_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 0.0])]
    got = {(r["id"], r["neighbour"]) for r in knn(frame(spark, rows), "vec_id", "embedding", k=5, dim=2).collect()}
    assert got == {(0, 1), (1, 0)}
    assert knn(frame(spark, []), "vec_id", "embedding", k=5, dim=2).count() == 0


def test_copies_are_first_neighbours(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(50, [0.9, 0.1, 0.0]), (51, [0.0, 0.0, 1.0])]
    got = knn(frame(spark, rows), "vec_id", "embedding", k=3, dim=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert sorted(by[0]) == [(1, 1), (2, 2), (3, 3)] and sorted(by[39]) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(by[50]) == [(1, 0), (2, 1), (3, 2)] and len(by) == 42


def test_recall_against_brute_force(spark, smallest):
    df = spark.read.parquet(f"{smallest}/embedded_chunks.parquet")
    t = df.select("vec_id", "embedding").toArrow()
    at, x = unit_rows(t["embedding"], 128)
    ids = t["vec_id"].to_numpy()[at]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(a, b) for a, row in zip(ids, np.argsort(-s, axis=1)[:, :5]) for b in ids[row]}
    got = {(r["id"], r["neighbour"]) for r in knn(df, "vec_id", "embedding", params=Lists(list_rows=16)).collect()}
    assert len(want & got) / len(want) >= 0.9
    asked = knn(df, "vec_id", "embedding", ask=lambda c: c % 10 == 0).where(F.col("id") % 10 != 0)
    assert asked.count() == 0


def test_long_lists_are_split(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))]
    whole = knn(frame(spark, rows), "vec_id", "embedding", k=2, dim=4, params=Lists(list_rows=1000))
    parts = knn(frame(spark, rows), "vec_id", "embedding", k=2, dim=4, params=Lists(list_rows=1000, block_rows=50))
    pick = lambda df: {(r["id"], r["neighbour"], r["rank"]) for r in df.collect()}
    assert pick(whole) == pick(parts) and len(pick(whole)) == 600


def test_graph_finds_the_nearest_centroid():
    x = np.random.default_rng(2).normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, shares = fit_centroids(x, 200)
    assert abs(shares.sum() - 1) < 1e-9
    got, sims = CentroidGraph(c, 16).search(x[:500], 3, 12)
    best = (x[:500] @ c.T).argmax(axis=1)
    assert (got[:, 0] == best).mean() > 0.9 and (np.diff(sims, axis=1) <= 0).all()


def test_null_entries_in_arrow():
    at, x = unit_rows(pa.array([[1.0, None], [3.0, 4.0], None], pa.list_(pa.float32())), 2)
    assert at.tolist() == [1] and np.allclose(x, [[0.6, 0.8]])


def clustered(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters, dim))
    x = (base[rng.integers(0, clusters, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_lists_inside_coarse_lists(spark):
    """More lists than the centroid table may hold: each coarse list is split by a task of its own."""
    x = clustered(6000, 32, 60, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(a, b) for a, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for b in row}
    for more in ({}, {"part_rows": 500, "ask_rows": 100, "block_rows": 40}):
        near = knn(df, "vec_id", "embedding", dim=32, params=Lists(list_rows=64, max_lists=12, **more))
        got = {(r["id"], r["neighbour"]) for r in near.collect()}
        assert len(want & got) / len(want) >= 0.95 and len(got) > 29_900


def test_asking_rows_are_split(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 4)))]
    pick = lambda p: {(r["id"], r["neighbour"], r["rank"]) for r in knn(frame(spark, rows), "vec_id", "embedding", k=2, dim=4, params=p).collect()}
    assert pick(Lists(list_rows=1000)) == pick(Lists(list_rows=1000, block_rows=70, ask_rows=200))


def test_graph_of_many_centroids():
    c = clustered(16_384, 64, 400, 3)
    rng = np.random.default_rng(4)
    q = c[rng.integers(0, len(c), 1000)] + 0.05 * rng.normal(size=(1000, 64)).astype(np.float32)
    got, _ = CentroidGraph(c, 16).search(q, 4, Lists().beam)
    assert (got[:, 0] == (q @ c.T).argmax(axis=1)).mean() >= 0.95
