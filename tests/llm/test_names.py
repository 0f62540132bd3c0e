import pytest

from papyrine.llm import names as N

GIVEN = N.Known({"katherine", "robert", "jeanbaptiste", "dolores", "mehmet", *N.FORMAL})


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Katherine M. Olgebakowa", ("olgebakowa", "katherine", "k", "m")),
        ("Olgebakowa, Katherine M.", ("olgebakowa", "katherine", "k", "m")),
        ("OLGEBAKOWA Katherine", ("olgebakowa", "katherine", "k", "")),
        ("Olgebakowa Katherine", ("olgebakowa", "katherine", "k", "")),
        ("KATHERINE OLGEBAKOWA", ("olgebakowa", "katherine", "k", "")),
        ("Dr Katherine  Olgebakowa, MD", ("olgebakowa", "katherine", "k", "")),
        ("K.M. Olgebakowa", ("olgebakowa", "", "k", "m")),
        ("Olgebakowa KM", ("olgebakowa", "", "k", "m")),
        ("Olgebakowa, K. M.", ("olgebakowa", "", "k", "m")),
        ("K Olgebakowa", ("olgebakowa", "", "k", "")),
        ("J-B. Skalugatti", ("skalugatti", "", "j", "")),
        ("Robert von Lypalistad", ("lypalistad", "robert", "r", "")),
        ("Mehmet Ó Dabivuvall", ("dabivuvall", "mehmet", "m", "")),
        ("Mehmet O Dabivuvall", ("dabivuvall", "mehmet", "m", "")),
        ("", None),
        ("...", None),
    ],
)
def test_parse(name, want):
    assert N.parse_person(name, GIVEN) == want


def test_titles():
    assert N.title_words("Arch. Cardiol. Infect. Dis. Lett.")[0] == ["arch", "cardiol", "infect", "dis", "lett"]
    assert N.title_words("The Annals of X Surgery (Online)")[0] == ["annals", "x", "surgery"]
    assert N.title_words("Annals of X Surg…") == (["annals", "x", "surg"], True)
    assert N.title_words("Palosushire DSG")[0] == ["palosushire", "d", "s", "g"]
    assert N.abbreviates("jnl", "journal") and N.abbreviates("neurol", "neurology") and not N.abbreviates("neurol", "nephrology")
    assert N.close("abcd", "abdc") and N.close("abcd", "abd") and not N.close("abcd", "badc")


def pairs(spark, authors, journals=()):
    rows = [("author", a) for a in authors] + [("journal", j) for j in journals]
    df = spark.createDataFrame(rows, "kind string, name string")
    return {(r["name_a"], r["name_b"]) for r in N.variant_pairs(df).collect()}


def test_variants_and_ambiguity(spark):
    got = pairs(spark, [
        "Katherine M. Olgebakowa", "Kathy Olgebakowa", "Katherine Olgebakwoa", "K. Olgebakowa", "Kwabena Olgebakowa", "Katherine M. Olgebakowa",
        "Robert Dukugavall", "Bob Dukuagvall", "Dukugavall, R.", None, "", "  ", "Dolores Hozevoford",
    ], ["Annals of Pudovuria Pediatrics", "ANN PUDOVURIA PEDIATR", "Annals of Pudovuria Pediatrcs", "Annals of Pudovuria Neurology", None, ""])
    linked = lambda a, b: (min(a, b), max(a, b)) in got
    assert linked("Katherine M. Olgebakowa", "Kathy Olgebakowa") and linked("Kathy Olgebakowa", "Katherine Olgebakwoa")
    assert linked("K. Olgebakowa", "Kwabena Olgebakowa") and linked("K. Olgebakowa", "Kathy Olgebakowa")
    assert not linked("Kwabena Olgebakowa", "Kathy Olgebakowa")
    assert linked("Robert Dukugavall", "Dukugavall, R.") and linked("Robert Dukugavall", "Bob Dukuagvall")
    assert not any("Dolores Hozevoford" in p for p in got)
    assert linked("Annals of Pudovuria Pediatrics", "ANN PUDOVURIA PEDIATR") and linked("ANN PUDOVURIA PEDIATR", "Annals of Pudovuria Pediatrcs")
    assert not any("Annals of Pudovuria Neurology" in p for p in got)
    assert all(a < b for a, b in got)


def test_empty(spark):
    assert pairs(spark, [None, ""]) == set()


def resolved(spark, titles, tile=2_000):
    """Groups of the numbers of titles, each title a profile under its number."""
    rows = [("journal", pid, [[w] for w in t.split()], [], {w: 1 for w in t.split()}) for pid, t in titles.items()]
    profiles, roots = N._resolve(spark.createDataFrame(rows, N.PROFILE), tile)
    groups = {}
    for r in roots.collect():
        groups.setdefault(r["root"], set()).add(r["pid"])
    for pid in set(titles) - {p for g in groups.values() for p in g}:
        groups[pid] = {pid}
    assert {r["pid"] for r in profiles.collect()} == set(groups) == {min(g) for g in groups.values()}
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("in_one", [0, 1000])
def test_links_are_closed(spark, in_one):
    links = [(1, 3), (2, 3), (-5, 9), (8, 9), (7, 8), (6, 7), (20, 21)]
    got = N._closed(spark.createDataFrame(links, "a bigint, b bigint"), len(links), in_one)
    assert {r["pid"]: r["root"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, -5: -5, 6: -5, 7: -5, 8: -5, 9: -5, 20: 20, 21: 20}
    assert N._closed(spark.createDataFrame([], "a bigint, b bigint"), 0, in_one).count() == 0


def test_hub_with_the_largest_id(spark):
    titles = {3: "quarterly neurology pediatrics", 1: "auarterly neurology pediatrics", 2: "quarterly beurology pediatrics", 9: "quarterly nephrology pediatrics"}
    assert resolved(spark, titles) == [[1, 2, 3], [9]]


def test_combinations_of_initials(spark):
    assert "t|dx" in N.title_keys([["a", "b", "c", "d"], ["x"]])
    titles = {1: "quarterly neurology pediatrics surgery", 2: "wuarterly neurology pediatrics surgery", 3: "quarterly meurology pediatrics surgery", 4: "quarterly neurology oediatrics surgery"}
    assert resolved(spark, {**titles, 5: "wuarterly meurology oediatrics surgery"}) == [[1, 2, 3, 4, 5]]


def test_rounds_until_nothing_matches(spark):
    word = lambda k: "n" + "abcdefghijklm"[:k] + "opqrstuvwxyzz"[k:]
    titles = {k: f"{word(k)} {'pediatrics' if k % 2 else 'pediatrixs'}" for k in range(1, 13)} | {0: f"{word(0)} pediatrics", 13: f"{word(0)} pediatrixs"}
    assert resolved(spark, titles) == [list(range(14))]


def test_turned_titles_around_a_hub(spark):
    """Both titles in two parts stand under the words in this order, whose group has the largest id."""
    titles = ["Quarterly: Neurology Frontiers Pediatrics", "Quarterly Neurology: Frontiers Pediatrics", "Neurology Frontiers Pediatrics Quarterly", "Frontiers Pediatrics Quarterly Neurology"]
    got = pairs(spark, [], [*titles, "Surgery Letters Quarterly Oncology"])
    assert got == {(min(a, b), max(a, b)) for a in titles for b in titles if a != b}


def test_nicknames_under_common_family_names(spark):
    """A short name learned from family names with many given names; a name that meets all others there is no short one."""
    rows = [(f"hot{f}", f"other{f}x{g}") for f in range(6) for g in range(10)] + [(f"hot{f}", g) for f in range(6) for g in ("zuzu", "zusanna")]
    rows += [(f"rare{f}", g) for f in range(9) for g in ("zusanna", "marta")]
    rows += [(f"big{f}", g) for f in range(4) for g in ("zusanna", "marta", "ivo", *(f"g{f}x{i}" for i in range(9)))]
    rows += [(f"few{f}", g) for f in range(3) for g in ("lulu", "lucasta")] + [(f"lone{f}", "lucasta") for f in range(5)]
    people = spark.createDataFrame(rows, "family string, given string")
    assert {tuple(r) for r in N._aliases(people).collect()} == {("zuzu", "zusanna"), ("lulu", "lucasta")}


@pytest.mark.parametrize("tile", [1, 2, 5])
def test_tiles_find_what_one_block_finds(spark, tile):
    titles = {k: f"quarterly {w} pediatrics" for k, w in enumerate(["neurology", "neurologi", "neuroloigy", "nephrology", "nephrologi", "nematology", "neurol", "nephrol"])}
    assert resolved(spark, titles, tile) == resolved(spark, titles)


@pytest.mark.parametrize("in_one", [0, 100])
def test_chains_of_short_names(spark, in_one):
    learned = spark.createDataFrame([("bobs", "bob"), ("zuzu", "zusa"), ("zusa", "zusanna")], "given string, stands_for string")
    got = {tuple(r) for r in N._stands_for(learned, {"bob": "robert", "zuzu": "other"}, in_one).collect()}
    assert got == {("bob", "robert"), ("bobs", "robert"), ("zuzu", "zusanna"), ("zusa", "zusanna")}


def test_words_looked_up_by_a_join(spark):
    """Beyond the bound each name gets its known words by a join; the result is the same."""
    authors = [f"Marta X. Family{i}" for i in "abcd"] + ["Familya Marta", "Familyb Mrata", "Marat Familyc", "Katherine Familyd", "Familyd Kathy", "Lone Wolf", "X", ""]
    df = spark.createDataFrame([("author", a) for a in authors], "kind string, name string")
    found = [{(r["nid"], r["root"]) for r in N.members(df, n)[1].collect()} for n in (0, 100)]
    assert found[0] == found[1]


def test_rare_words():
    assert N.rare(2, 3, 2) and not N.rare(3, 4, 2) and N.rare(50, 1000, 2) and not N.rare(51, 1000, 2)


def test_classes(spark):
    df = spark.createDataFrame([("author", "Robert Dukugavall"), ("author", "Bob Dukugavall"), ("author", "Ivo Xanten"), ("journal", None)], "kind string, name string")
    got = {r["name"]: (r["entity"], r["spellings"]) for r in N.classes(df).collect()}
    assert got["Robert Dukugavall"] == got["Bob Dukugavall"] and got["Ivo Xanten"][1] == 1 and len(got) == 3
