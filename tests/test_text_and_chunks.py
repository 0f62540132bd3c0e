import random

from pyspark.sql import functions as F

from papyrine.config import Settings
from papyrine.functions import registry
from papyrine.functions import text as T
from papyrine.functions.tokens import Bpe, Whitespace
from papyrine.operators import chunking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_blanks_of_all_kinds(spark):
    assert one(spark, " a  b\x1c\nc ", T.normalize_whitespace("t")) == "a b c"
    assert one(spark, None, T.normalize_whitespace("t")) == ""


def test_citations(spark):
    assert one(spark, "Seen [1, 2] often (Lee et al., 2020) .", T.strip_citations("t")) == "Seen often."
    assert one(spark, "A (see Fig 1) b (Smith, 2020).", T.strip_citations("t")) == "A."
    assert one(spark, "A (see Fig 1) b (Smith, 2020).", T.strip_citations("t", strict=True)) == "A (see Fig 1) b."
    assert one(spark, "é x", T.clean_text("t")) == "é x"


def test_slug_and_ids(spark):
    assert one(spark, "  Methods & Data!", T.slugify("t")) == "methods_data"
    assert one(spark, "方法", T.slugify("t")) == "untitled"
    assert one(spark, "P", T.chunk_id("t", F.lit("A b"), F.lit(1234))) == "P_a_b_1234"


def test_sentences_and_tokens(spark):
    assert one(spark, "A b. C d?  E", T.split_sentences("t")) == ["A b.", "C d?", "E"]
    assert one(spark, None, Whitespace().count("t")) == 0
    assert one(spark, "a b c", Whitespace().truncate("t", 2)) == "a b"


def test_byte_pairs(spark):
    import public_tokenizers as P

    bpe = Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert one(spark, "hello world", bpe.count("t")) == 2
    assert one(spark, "hello world again", bpe.truncate("t", 2)) == "hello world"
    assert one(spark, "", bpe.count("t")) == 0


def naive_pack(sentences, target, most, overlap):
    """Chunks of (word count) by the rule, written out step by step."""
    out, cur = [], []
    for s in sentences:
        n = len(s.split())
        if n > most:
            if cur:
                out.append(cur)
            words = s.split()
            out += [[" ".join(words[i : i + target])] for i in range(0, n, target)]
            cur = []
            continue
        if cur and sum(len(x.split()) for x in cur) + n > target:
            out.append(list(cur))
            keep, k = [], overlap
            while cur and len(cur[-1].split()) <= k:
                k -= len(cur[-1].split())
                keep = [cur.pop(), *keep]
            cur = keep
        cur = [*cur, s]
    return [" ".join(c) for c in [*out, *([cur] if cur else [])]]


def test_pack_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        sentences = [" ".join(["w"] * (rng.randint(1, 30) - 1) + ["e."]) for _ in range(rng.randint(0, 20))]
        got = chunking.pack(" ".join(sentences), Whitespace(), 20, 25, 6)
        assert [t for _, t, _ in got] == naive_pack(sentences, 20, 25, 6)
        assert all(n == len(t.split()) for _, t, n in got)


def test_all_chunk_types(spark):
    docs = spark.createDataFrame(
        [("P1", "T", "J", 2020, "An abstract here.", [("t1", "Cap", "| a |", "Results")], [("f1", " Fig cap "), ("f2", None)]), ("P2", None, None, None, None, None, None)],
        "pmcid string, title string, journal string, pub_year int, abstract string, doc_tables array<struct<id string, caption string, markdown string, section string>>, figures array<struct<id string, caption string>>",
    )
    sections = spark.createDataFrame([("P1", 0, ["A"], "One. Two."), ("P1", 1, ["A", "B"], ""), ("P9", 0, ["A"], "No document.")], "pmcid string, ord int, section_path array<string>, content string")
    made = chunking.chunk_documents(docs, sections, s=Settings(chunk_target_tokens=50)).collect()
    rows = {r["chunk_type"]: r for r in made if r["pmcid"] == "P1"}
    orphan = [r for r in made if r["pmcid"] == "P9"]
    assert len(orphan) == 1 and orphan[0]["metadata_header"] == "PMCID: P9\nSection: A" and len(made) == 5
    own = sections.join(docs.select("pmcid", "title", "journal", "pub_year"), "pmcid", "left")  # metadata carried along
    assert sorted(map(str, chunking.chunk_documents(docs, own, s=Settings(chunk_target_tokens=50)).collect())) == sorted(map(str, made))
    assert set(rows) == {"ABSTRACT", "TEXT", "TABLE", "FIGURE_CAPTION"}
    assert rows["TABLE"]["content"] == "Cap\n\n| a |" and rows["TABLE"]["chunk_id"] == "P1_t1_000"
    assert rows["FIGURE_CAPTION"]["metadata"]["section"] == "Figures"
    assert rows["TEXT"]["metadata_header"].startswith("PMCID: P1\nTitle: T")


def test_sql_functions(spark):
    names = registry.register(spark)
    assert {"slugify", "point_id", "rrf", "bm25"} <= set(names)
    assert spark.sql("select slugify('A b'), rrf(1, 60)").first()[0] == "a_b"


def test_tokens_behind_an_overlap_are_those_of_the_joined_text():
    """Two letters are a token, blanks included: joined texts have other tokens than their sentences."""

    class Pairs:
        split = staticmethod(lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])
        join = staticmethod("".join)

    sentences = ["aaa.", "bbb.", "ccc.", "ddd."]  # 2 tokens each, 5 for two joined by a blank
    got = [t for _, t, _ in chunking.pack(" ".join(sentences), Pairs, target=6, most=9, overlap=2)]
    assert got == ["aaa. bbb. ccc.", "ccc. ddd."]
    assert [t for _, t, _ in chunking.pack(" ".join([*sentences, "e."]), Pairs, target=6, most=9, overlap=2)][-1] == "ccc. ddd. e."
    assert [t for _, t, _ in chunking.pack(" ".join([*sentences, "eee."]), Pairs, target=6, most=9, overlap=2)][-1] == "ddd. eee."
