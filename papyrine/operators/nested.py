"""Nested section trees and table lists as flat rows that know their parent.

One depth-first visit of each record emits every node once, as ``(tag, id, path, parent, payload)``. The rows are
written partitioned by tag; each flat table is then a read of one partition with its own schema applied to the
payload. The visit is narrow, so a record of any size never meets another one, and no shuffle takes place.

Defined results
* A node's path joins the zero-based positions from the root with '.'; the parent of a top node is ''.
* A list of sections may be a list, a lone object, or either of them stored as JSON text. Entries that are no objects
  give no row but keep their position. An object around the top list that is itself no section is skipped.
* The list of children may be spelled in any letter case and with or without separators; of several spellings in one
  object the first non-empty one counts.
* Text that is not valid JSON and null give no section rows; the record's tables are still emitted. Depth is not bounded:
  what the standard parser gives up on is parsed with a stack of its own.
* A table's parent is the only section of its record with the same title, ignoring letter case and outer blanks; '' if
  its section is empty or no or several sections have that title.
* Rows with a null id are skipped; repeated rows are emitted repeatedly; only the named columns are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.scratch import materialize

EMITTED = "tag string, id bigint, path string, parent string, payload string"
SECTION = "title string, content string, depth int, extra map<string,string>"
TABLE = "table_id string, caption string, markdown string, section string"
_plain = re.compile(r"[\s_-]+")
_roles: dict[str, str] = {}


def role(key: str) -> str:
    """``title``, ``content``, ``children``, ``list`` or '' for one spelling of a key."""
    found = _roles.get(key)
    if found is None:
        name = _plain.sub("", key).lower()
        found = {"title": "title", "content": "content", "subsections": "children", "sections": "list"}.get(name, "")
        if len(_roles) < 10_000:
            _roles[key] = found
    return found


BLANK = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
WORD = re.compile("|".join(WORDS))


def parse_deep(text: str):
    """JSON of any depth; raises ValueError where the text is not valid."""
    at = BLANK.match(text, 0).end()
    open_: list[tuple[dict | list, str | None]] = []  # containers around the place, with the key under which the next value goes
    while True:
        c = text[at : at + 1]
        value, ready = None, True
        if c == '"':
            value, at = scanstring(text, at + 1)
        elif c in ("{", "["):
            value, ready = ({}, False) if c == "{" else ([], False)
            at = BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at, ready = at + 1, True
            else:
                open_.append((value, None))
        elif m := WORD.match(text, at):
            value, at = WORDS[m[0]], m.end()
        elif m := NUMBER.match(text, at):
            value, at = float(m[0]) if m[2] or m[3] else int(m[1]), m.end()
        else:
            raise ValueError("no value")
        while ready:  # put the value into what is around it, and close what ends here
            at = BLANK.match(text, at).end()
            if not open_:
                if at < len(text):
                    raise ValueError("something behind the value")
                return value
            around, key = open_.pop()
            if isinstance(around, list):
                around.append(value)
            else:
                around[key] = value
            c, at = text[at : at + 1], BLANK.match(text, at + 1).end()
            if c == ",":
                open_.append((around, None))
                ready = False
            elif c == ("]" if isinstance(around, list) else "}"):
                value = around
            else:
                raise ValueError("no end of the container")
        if isinstance(open_[-1][0], dict):
            if text[at : at + 1] != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1)
            at = BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at = BLANK.match(text, at + 1).end()
            open_[-1] = (open_[-1][0], key)


def _parsed(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return parse_deep(text)
    except ValueError:
        return None


def as_list(value) -> list:
    if isinstance(value, str):
        value = _parsed(value) if value.lstrip()[:1] in ("[", "{") else None
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def top_list(text: str | None) -> list:
    value = _parsed(text) if text else None
    if isinstance(value, str):
        value = _parsed(value)
    if isinstance(value, dict):
        roles = {role(k): k for k in reversed(value)}
        if "list" in roles and not {"title", "content", "children"} & roles.keys():
            return as_list(value[roles["list"]])
    return as_list(value)


def visit(entries: list) -> Iterator[tuple[str, str, dict, int]]:
    """``(path, parent, object, depth)`` of every section, parents before children, in document order."""
    stack = [(entries, "", 0, 1)]
    while stack:
        items, parent, at, depth = stack.pop()
        while at < len(items):
            node = items[at]
            at += 1
            if not isinstance(node, dict):
                continue
            path = f"{parent}.{at - 1}" if parent else str(at - 1)
            yield path, parent, node, depth
            children = next((c for c in (as_list(v) for k, v in node.items() if role(k) == "children") if c), None)
            if children:
                stack.append((items, parent, at, depth))
                items, parent, at, depth = children, path, 0, depth + 1


def dump_deep(value) -> str:
    """JSON text of a value of any depth, as ``json.dumps`` writes it."""
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Written):
            out.append(v)
        elif isinstance(v, dict | list):
            inner: list = [_Written("{" if isinstance(v, dict) else "[")]
            for n, x in enumerate(v.items() if isinstance(v, dict) else v):
                if n:
                    inner.append(_Written(", "))
                if isinstance(v, dict):
                    inner.append(_Written(json.dumps(x[0], ensure_ascii=False) + ": "))
                    x = x[1]
                inner.append(x)
            inner.append(_Written("}" if isinstance(v, dict) else "]"))
            todo += reversed(inner)
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Written(str):
    """Text that is part of the result already."""


def _text(value) -> str | None:
    if isinstance(value, str) or value is None:
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return dump_deep(value)


def emit_record(sections: str | None, tables: list | None, payload: bool = True) -> Iterator[tuple[str, str, str, str | None]]:
    """``(tag, path, parent, payload)`` of one record, in one pass over its nodes."""
    titles: Counter = Counter()
    where: dict[str, str] = {}
    wanted = {t["section"].strip().casefold() for t in tables or () if t is not None and t.get("section")} - {""}
    for path, parent, node, depth in visit(top_list(sections)):
        body = None
        if payload:
            own: dict = {"depth": depth}
            extra = {}
            for k, v in node.items():
                r = role(k)
                if r in ("title", "content"):
                    own.setdefault(r, _text(v))
                elif r != "children":
                    extra[k] = _text(v)
            if extra:
                own["extra"] = extra
            body = json.dumps(own, ensure_ascii=False)
        yield "section", path, parent, body
        if wanted:
            title = next((v for k, v in node.items() if role(k) == "title"), None)
            if isinstance(title, str) and (key := title.strip().casefold()) in wanted:
                titles[key] += 1
                where[key] = path
    for at, t in enumerate(tables or ()):
        if t is None:
            continue
        key = (t.get("section") or "").strip().casefold()
        parent = where[key] if key and titles[key] == 1 else ""
        body = None
        if payload:
            body = json.dumps({"table_id": t.get("id"), "caption": t.get("caption"), "markdown": t.get("markdown"), "section": t.get("section")}, ensure_ascii=False)
        yield "table", str(at), parent, body


NODES = pa.schema([("tag", pa.string()), ("id", pa.int64()), ("path", pa.string()), ("parent", pa.string()), ("payload", pa.string())])


def _emit(payload: bool, most: int = 1 << 23):
    """Rows leave in batches of about ``most`` characters, so that a deep record does not fill the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                key = b.column(0)[i].as_py()
                for tag, path, parent, body in emit_record(b.column(1)[i].as_py(), b.column(2)[i].as_py(), payload):
                    rows.append((tag, key, path, parent, body))
                    size += 40 + 2 * len(path) + len(body or "")
                    if size > most:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), NODES)], schema=NODES)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), NODES)], schema=NODES)

    return run


def emit(df: DataFrame, id_col: str = "canon_id", sections: str = "sections", tables: str = "doc_tables", payload: bool = True) -> DataFrame:
    """The tagged rows of all records."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(sections).alias("s"), F.col(tables).alias("t")).where("id is not null")
    return rows.mapInArrow(_emit(payload), EMITTED)


def flatten(df: DataFrame, id_col: str = "canon_id", sections: str = "sections", tables: str = "doc_tables") -> DataFrame:
    """The tagged rows, written to the shared folder partitioned by tag; a filter on ``tag`` reads one partition."""
    return materialize(emit(df, id_col, sections, tables), "nodes", partition_by=("tag",))


def section_rows(nodes: DataFrame) -> DataFrame:
    body = nodes.where("tag = 'section'").withColumn("p", F.from_json("payload", SECTION))
    return body.select("id", "path", "parent", "p.title", "p.content", "p.depth", "p.extra")


def table_rows(nodes: DataFrame) -> DataFrame:
    body = nodes.where("tag = 'table'").withColumn("p", F.from_json("payload", TABLE))
    return body.select("id", F.col("path").cast("int").alias("position"), "parent", "p.table_id", "p.caption", "p.markdown", "p.section")
