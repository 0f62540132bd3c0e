"""Scientific articles in JATS XML to typed rows, in one pass per article.

The text is parsed by the strict standard parser after its document type is removed, and by a forgiving one if that
fails. Errors are data: an article that cannot be used gives a row with its reasons. Nothing is fetched from outside.
"""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.schemas import FIGURE, METADATA, SECTION, TABLE

DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", re.S | re.I)
ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)")
HREF = "{http://www.w3.org/1999/xlink}href"
MIN_SIZE = 100
# Inline citations and blanks, as in the text functions.
CITATION = re.compile(r"(?:\[[\d\s,\-]+\])|(?:\(\s*[A-Za-z]+.*?(?:19|20)\d{2}\s*\))")


def clean(text: str) -> str:
    t = CITATION.sub("", unicodedata.normalize("NFC", text or ""))
    return re.sub(r"\s+", " ", re.sub(r"\s+([.,;:!?])", r"\1", t)).strip()


class _Forgiving(HTMLParser):
    """Builds a tree from damaged XML: unknown ends are ignored, open elements are closed at the end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs) -> None:
        el = ET.SubElement(self.open[-1], tag, {k.replace("xlink:href", HREF): v or "" for k, v in attrs})
        self.open.append(el)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        self.open.pop()

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data) -> None:
        el = self.open[-1]
        if len(el):
            el[-1].tail = (el[-1].tail or "") + data
        else:
            el.text = (el.text or "") + data


def tree(xml: str) -> tuple[ET.Element | None, bool]:
    """The root, and whether the text was well formed."""
    body = ENTITY.sub("&amp;", DOCTYPE.sub("", xml, count=1))
    try:
        root = ET.Element("root")
        root.append(ET.fromstring(body.lstrip("﻿ \r\n\t").encode("utf-8", "replace")))
        return root, True
    except ET.ParseError:
        p = _Forgiving()
        p.feed(body)
        p.close()
        return (p.root if len(p.root) else None), False


def text(el: ET.Element | None, sep: str = " ") -> str:
    return "" if el is None else re.sub(r"\s+", " ", sep.join(t for t in el.itertext())).strip()


def _tight(el: ET.Element | None) -> str:
    """Text without blanks put between inline elements."""
    return text(el, "")


def metadata(root: ET.Element) -> dict:
    ids = {}
    for e in root.iter("article-id"):
        ids.setdefault(e.get("pub-id-type"), _tight(e))
    authors = []
    for c in root.iter("contrib"):
        if c.get("contrib-type") == "author":
            name = " ".join(p for p in (_tight(c.find(".//given-names")), _tight(c.find(".//surname"))) if p)
            if name:
                authors.append(name)
    year = None
    dates = list(root.iter("pub-date"))
    kind = lambda d: d.get("pub-type") or d.get("date-type")
    for d in [*(d for d in dates if kind(d) == "epub"), *(d for d in dates if kind(d) == "ppub"), *dates]:
        t = _tight(d.find("year"))
        if re.fullmatch(r"[+-]?\d+", t):
            year = int(t)
            break
    lic = next(root.iter("license"), None)
    license_ = ""
    if lic is not None:
        license_ = lic.get(HREF) or text(lic.find(".//license-p"))[:200] or text(lic)[:200]
    article = next(root.iter("article"), None)
    return {
        "doi": ids.get("doi", ""), "title": _tight(next(root.iter("article-title"), None)), "authors": authors,
        "journal": _tight(next(root.iter("journal-title"), None)), "pub_year": year, "keywords": [k for k in (_tight(e) for e in root.iter("kwd")) if k],
        "article_type": "" if article is None else article.get("article-type", ""), "license": license_,
    }


def sections(root: ET.Element) -> list[dict]:
    """Sections of the body in document order, each with its own text only."""
    out: list[dict] = []
    body = next(root.iter("body"), None)

    def visit(sec: ET.Element, path: list[str]) -> bool:
        title = clean(text(sec.find("title"))) or "Untitled Section"
        here = [*path, title]
        row = {"ord": len(out), "depth": len(path), "section_path": here, "title": title, "content": ""}
        out.append(row)
        parts, kept = [], False
        for child in sec:
            if child.tag == "sec":
                kept |= visit(child, here)
            elif child.tag not in ("title", "table-wrap", "fig"):
                parts.append(clean(text(child)))
        row["content"] = " ".join(p for p in parts if p)
        if row["content"] or kept:
            return True
        out.remove(row)
        return False

    for sec in body.findall("sec") if body is not None else ():
        visit(sec, [])
    for i, row in enumerate(out):
        row["ord"] = i
    return out


def _cells(row: ET.Element) -> str:
    cells = [text(c).replace("|", "\\|") for c in row if c.tag in ("td", "th")]
    return "| " + " | ".join(cells) + " |" if cells else ""


def markdown(table: ET.Element | None) -> str:
    """Header row, separator and body rows of a table; without a head the first row is the header."""
    if table is None:
        return ""
    head = [r for h in table.iter("thead") for r in h.iter("tr")]
    in_head = set(head)
    body = [r for r in table.iter("tr") if r not in in_head]
    rows = [*(head[:1] or body[:1]), *(body if head else body[1:])]
    lines = [t for t in (_cells(r) for r in rows) if t]
    if not lines:
        return ""
    width = sum(c.tag in ("td", "th") for c in rows[0])
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def tables(root: ET.Element) -> list[dict]:
    above = {c: p for p in root.iter() for c in p}
    out = []
    for wrap in root.iter("table-wrap"):
        md = markdown(wrap.find(".//table"))
        if not md:
            continue
        sec = above.get(wrap)
        while sec is not None and sec.tag != "sec":
            sec = above.get(sec)
        out.append({"id": wrap.get("id") or f"table_{len(out)}", "caption": clean(text(wrap.find("caption"))), "markdown": md, "section": "" if sec is None else clean(text(sec.find(".//title")))})
    return out


def article(pmcid: str, xml: str | None) -> dict:
    """Everything of one article, with validation errors and warnings."""
    empty = {"pmcid": pmcid, "metadata": None, "abstract": "", "sections": [], "doc_tables": [], "figures": [], "refs": [], "errors": [], "warnings": [], "well_formed": False}
    if not xml:
        return empty | {"errors": ["empty_file"]}
    if len(xml) < MIN_SIZE and len(xml.encode("utf-8", "surrogatepass")) < MIN_SIZE:  # bytes
        return empty | {"errors": ["file_too_small"]}
    root, ok = tree(xml)
    if root is None:
        return empty | {"errors": ["unparseable"]}
    m = metadata(root)
    m["pmcid"] = pmcid
    ids = {_tight(e) for e in root.iter("article-id") if e.get("pub-id-type") in ("pmc", "pmcid")}
    abstract = clean(text(next(root.iter("abstract"), None)))
    errors = [] if ids & {pmcid, pmcid.removeprefix("PMC")} else ["missing_pmcid"]
    errors += [] if m["title"] else ["missing_title"]
    refs = next(root.iter("ref-list"), None)
    return {
        "pmcid": pmcid, "metadata": m, "abstract": abstract, "sections": sections(root), "doc_tables": tables(root),
        "figures": [{"id": f.get("id") or f"fig_{i}", "caption": clean(text(f.find("caption")))} for i, f in enumerate(root.iter("fig"))],
        "refs": [t for t in (text(r) for r in (refs.iter("ref") if refs is not None else ())) if t],
        "errors": errors, "warnings": [] if abstract else ["missing_abstract"], "well_formed": ok,
    }


PARSED = (
    f"pmcid string, metadata struct<{METADATA}>, abstract string, sections array<struct<{SECTION}>>, doc_tables array<struct<{TABLE}>>, "
    f"figures array<struct<{FIGURE}>>, refs array<string>, errors array<string>, warnings array<string>, well_formed boolean"
)


def parse(raw: DataFrame, key: str = "pmcid", xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per article of ``raw``, with the columns ``keep`` beside it; rows without a key are skipped."""
    names = ["pmcid", "metadata", "abstract", "sections", "doc_tables", "figures", "refs", "errors", "warnings", "well_formed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([article(k, x) for k, x in zip(f["k"], f["x"])], columns=names)
            yield out.assign(**{c: f[c].to_numpy() for c in keep})

    rows = raw.select(F.col(key).alias("k"), F.col(xml).alias("x"), *keep).where("k is not null")
    return rows.mapInPandas(run, ", ".join([PARSED, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)]))


def usable() -> Column:
    """A canonical document needs an id, a title, and sections or an abstract."""
    return (F.coalesce("pmcid", F.lit("")) != "") & (F.coalesce("metadata.title", F.lit("")) != "") & ((F.size("sections") > 0) | (F.trim("abstract") != ""))


def route(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to keep, and those for quarantine."""
    ok = F.coalesce(usable(), F.lit(False)) & ~F.array_contains("errors", "unparseable")
    return parsed.where(ok), parsed.where(~ok)


def decode(content: str = "content") -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not valid UTF-8."""
    return F.coalesce(F.expr(f"try_validate_utf8(cast({content} as string))"), F.decode(F.col(content), "ISO-8859-1"))
