import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyrine.operators import nested


def paths(value):
    text = value if isinstance(value, str) else json.dumps(value)
    return [(p, q) for t, p, q, _ in nested.emit_record(text, None) if t == "section"]


def test_shapes():
    a = {"title": "A", "content": "x"}
    assert paths([a, None, 3, "see", {"title": "B", "subSections": [a, {"sub_sections": a}]}]) == [("0", ""), ("4", ""), ("4.0", "4"), ("4.1", "4"), ("4.1.0", "4.1")]
    assert paths(a) == [("0", "")]
    assert paths({"sections": [a], "schema_version": 1}) == [("0", "")]
    assert paths({"title": "own", "subsections": json.dumps([a])}) == [("0", ""), ("0.0", "0")]
    assert paths("") == paths("[{broken") == paths("null") == paths("3") == []
    assert paths([{"Subsections": "", "subsections": [a]}]) == [("0", ""), ("0.0", "0")]
    deep = a
    for _ in range(500):
        deep = {"title": "t", "subsections": [deep]}
    assert len(paths([deep])) == 501


def test_list_as_text_behind_many_blanks():
    a = {"title": "A", "content": "x"}
    for blanks in (63, 64, 5000):
        assert paths({"title": "own", "subsections": " " * blanks + json.dumps([a])}) == [("0", ""), ("0.0", "0")]
        assert paths({"title": "own", "subsections": "\n" * blanks + json.dumps(a)}) == [("0", ""), ("0.0", "0")]
    assert paths({"title": "own", "subsections": " " * 5000}) == [("0", "")]


def test_table_parents():
    secs = json.dumps([{"title": "One", "subsections": [{"title": "Two"}, {"title": "two "}]}, {"title": "Three"}])
    tables = [{"section": " oNe "}, None, {"section": "Two"}, {"section": ""}, {"section": None}, {"section": "x"}, {"section": "THREE"}]
    got = [(p, q) for t, p, q, _ in nested.emit_record(secs, tables) if t == "table"]
    assert got == [("0", "0"), ("2", ""), ("3", ""), ("4", ""), ("5", ""), ("6", "1")]


def test_tables_of_broken_record():
    assert [r[:3] for r in nested.emit_record("{bad", [{"section": "A"}])] == [("table", "0", "")]


SCHEMA = "canon_id long, sections string, doc_tables array<struct<id string, caption string, markdown string, section string>>, tag string, path int, parent string, payload string"


def test_typed_tables(spark):
    rows = [(1, json.dumps([{"title": "A", "content": None, "lang": {"v": 1}}]), [("t", "c", "m", "a")], "x", 1, "y", "z"), (None, "[]", None, None, None, None, None), (1, None, None, None, None, None, None)]
    nodes = nested.flatten(spark.createDataFrame(rows, SCHEMA))
    s = nested.section_rows(nodes).collect()
    assert len(s) == 1 and s[0]["title"] == "A" and s[0]["extra"] == {"lang": '{"v": 1}'} and s[0]["depth"] == 1
    t = nested.table_rows(nodes).collect()
    assert t[0]["parent"] == "0" and t[0]["markdown"] == "m"


def test_empty(spark):
    assert nested.flatten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("depth", [3, 1_100, 5_000, 50_000])
def test_any_depth(depth):
    text = '{"sections": ' + '[{"title": "t", "subsections": ' * depth + "[]" + "}]" * depth + "}"
    nodes = nested.visit(nested.top_list(text))
    n = longest = 0
    for path, _, _, d in nodes:
        n, longest = n + 1, max(longest, d)
        if n == 6_000:  # the paths of all nodes grow with the square of the depth
            break
    assert n == longest == min(depth, 6_000)


def test_deep_values_beside_the_children():
    deep = "[" * 30_000 + "1" + "]" * 30_000
    rows = list(nested.emit_record('[{"title": "a", "note": ' + deep + '}, {"title": "b"}]', None))
    assert [r[1] for r in rows] == ["0", "1"] and deep in rows[0][3]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=30))
def test_own_parser_agrees(value):
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        assert nested.parse_deep(text) == json.loads(text) == value
    assert nested.dump_deep(value) == json.dumps(value, ensure_ascii=False)


@pytest.mark.parametrize("text", ["", "[", "[1", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1] 2", "01", "tru", '"x', "[}", "{]", "-", "1.", ",", "nul"])
def test_own_parser_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        nested.parse_deep(text)
