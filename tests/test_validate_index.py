import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.operators import embedding, index, ordering, stats, validate
from papyrine.operators.components import components
from papyrine.scratch import hot_keys, new_path

NAN, INF = float("nan"), float("inf")


def test_vector_reasons(spark):
    rows = [("ok", [1.0, 0.0]), ("nan", [NAN, 0.0]), ("inf", [INF, 0.0]), ("dim", [1.0]), ("norm", [2.0, 0.0]), ("empty", []), ("null", None)]
    df = spark.createDataFrame(rows, "k string, e array<float>").select("k", validate.vector_reasons("e", 2).alias("r"))
    got = {r["k"]: r["r"] for r in df.collect()}
    assert got == {"ok": [], "nan": ["contains_nan"], "inf": ["contains_inf"], "dim": ["wrong_dimension"], "norm": ["non_unit_norm"], "empty": ["empty_embedding"], "null": ["empty_embedding"]}


def test_payload_rules(spark):
    df = spark.createDataFrame([("c", "", "t", "s", "TEXT", 0, "x")], "chunk_id string, pmcid string, title string, section string, chunk_type string, token_count int, content string")
    assert df.select(validate.payload_missing().alias("m")).first()["m"] == ["pmcid"]
    assert df.select(validate.payload_missing(validate.REQUIRED, zero_is_missing=True).alias("m")).first()["m"] == ["pmcid", "token_count"]


def test_empty_id_is_an_error(spark):
    with pytest.raises(Exception, match="chunk id"):
        spark.createDataFrame([("",)], "c string").select(T.point_id("c")).collect()


def test_collection(spark):
    c = index.Collection(spark, new_path(spark, "c"), "demo", dim=2)
    assert not c.exists() and c.info() == {} and not c.delete()
    assert c.create() and not c.create()
    p = lambda *r: spark.createDataFrame(list(r), "id long, chunk_type string, journal string, pub_year int, pmcid string")
    c.upsert(p((1, "TEXT", "a", 1, "x"), (2, "TEXT", "a", 1, "x")))
    c.upsert(p((2, "TEXT", "new", 1, "x"), (3, "TABLE", "a", None, None)))
    assert c.info()["points_count"] == 3
    assert c.points().where("id = 2").first()["journal"] == "a"
    c.upsert(p((2, "TEXT", "new", 1, "x")), force=True)
    assert c.points().where("id = 2").first()["journal"] == "new" and c.info()["points_count"] == 3
    c.recreate()
    assert c.info()["points_count"] == 0
    assert c.delete() and not c.exists()


def _bytes(spark, c):
    fs, path = c._fs()
    return fs.getContentSummary(path(c.path)).getLength()


def test_interrupted_and_repeated_upserts(spark, monkeypatch):
    c = index.Collection(spark, new_path(spark, "c"), "demo")
    c.create()
    p = lambda *r: spark.createDataFrame(list(r), "id long, journal string")
    c.upsert(p((1, "a"), (2, "a")))
    with monkeypatch.context() as m:
        m.setattr(c, "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            c.upsert(p((3, "a")))
    assert {r["id"] for r in c.points().collect()} == {1, 2}
    fs, path = c._fs()
    out = fs.create(path(f"{c.path}/manifest-{9:010d}.json"), True)
    out.write(bytearray(b'{"segments": [{"na'))
    out.close()
    assert {r["id"] for r in c.points().collect()} == {1, 2}
    c.upsert(p((4, "b"), (4, "c"), (1, "z")), force=True)
    c.upsert(p((4, "b"), (4, "c"), (1, "z")), force=True)
    assert sorted(map(tuple, c.points().collect())) == [(1, "z"), (2, "a"), (4, "c")]
    with pytest.raises(FileExistsError):
        c._write("properties.json", {})


def test_last_new_row_counts_by_order(spark):
    c = index.Collection(spark, new_path(spark, "c"), "demo")
    c.create()
    c.upsert(spark.createDataFrame([(1, "z", 1), (1, "a", 2)], "id long, journal string, at int"), order=("at",))
    assert c.points().first()["journal"] == "a"


def test_upserts_write_their_own_rows_and_segments_are_merged(spark):
    c = index.Collection(spark, new_path(spark, "c"), "demo")
    c.create()
    big = spark.range(90_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("journal"))
    c.upsert(big)
    size = _bytes(spark, c)
    for i in range(10):
        c.upsert(spark.createDataFrame([(i, f"new{i}"), (100_000 + i, "x")], "id long, journal string"), force=True)
    assert _bytes(spark, c) < 1.1 * size and len(c._segments()[1]) <= 5
    got = c.points()
    assert got.count() == 90_010 and got.where("journal like 'new%'").count() == 10


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "pmcid string, chunk_type string, token_count int")
    row = stats.corpus_stats(stats.document_stats(empty)).first()
    assert row["documents"] == 0 and row["total_tokens"] == 0 and row["average_tokens"] == 0.0


def test_cumulative(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert stats.cumulative(a, a).first().asDict() == {"x": 2, "y": 4}


def test_embedder(spark):
    meta = "metadata struct<pmcid string>"
    df = spark.createDataFrame([("a", ("p",), "", "some words"), ("b", ("p",), None, " "), ("c", None, "h", None)], f"chunk_id string, {meta}, metadata_header string, content string")
    rows = {r["chunk_id"]: r for r in embedding.embed(df, dim=16, batch=1).collect()}
    assert set(rows) == {"a", "c"} and abs(sum(x * x for x in rows["a"]["embedding"]) - 1) < 1e-5
    with pytest.raises(ValueError):
        embedding.embed(df, batch=0)
    assert round(embedding.memory_estimate_mb(32, 512, 768), 2) == 48.22
    assert embedding.device("cuda") == "cuda" and embedding.device() == "cpu"


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = ordering.global_position(df, "k").collect()
    assert sorted((r["k"], r["position"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 6), (7, 7), (10, 9), (9, 8), (8, 11), (None, 3)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[6] == 5 and got[7] == 7
    assert {got[i] for i in (8, 9, 10, 11)} == {8} and {got[i] for i in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, "k", 500, slots=64).collect()] == [(0, 1000)]
