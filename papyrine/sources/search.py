"""Article search as a Spark data source, over a service or a folder of article records.

``spark.read.format("article_search")`` with the option ``url`` asks a service page by page, at most one request per ``delay``
seconds, with retries; with ``path`` it searches a folder of JSON records. It gives ``(pmcid, rank)``: records whose title
or keywords hold every word of ``query``, with optional ``year`` and ``journal``, ranked by hits and id. One partition serves
the result list.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader


def with_prefix(number: str) -> str:
    return number if number.startswith("PMC") else f"PMC{number}"


def search_response(text: str) -> dict:
    """Ids and total of a search service's JSON answer."""
    r = json.loads(text).get("esearchresult", {})
    return {"pmcids": [with_prefix(i) for i in r.get("idlist", [])], "total_count": int(r.get("count", 0)), "web_env": r.get("webenv", ""), "query_key": r.get("querykey", "")}


class RateLimit:
    def __init__(self, gap: float):
        self.gap, self.last = gap, 0.0

    def wait(self) -> None:
        rest = self.last + self.gap - time.monotonic()
        if rest > 0:
            time.sleep(rest)
        self.last = time.monotonic()


def retrying(fetch, retries: int = 3, base: float = 1.0, sleep=time.sleep):
    """Call ``fetch`` until it succeeds, waiting twice as long after each failure; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return fetch()
        except (OSError, ValueError):
            if attempt == retries:
                raise
            sleep(base * 2**attempt)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        return self._asked() if self.options.get("url") else self._searched()

    def _asked(self) -> Iterator[tuple]:
        """Pages of a service's answers, until the total or the limit is reached."""
        o = self.options
        gate, limit, page = RateLimit(float(o.get("delay", 0.3))), int(o.get("limit", 0) or 0), int(o.get("page", 500))
        parts = [o.get("query", "").strip(), "open access[filter]", f"{o['year']}[pdat]" if o.get("year") else "", f'"{o["journal"]}"[journal]' if o.get("journal") else ""]
        term, rank, seen = " AND ".join(p for p in parts if p), 0, set()
        while True:
            ask = urllib.parse.urlencode({"term": term, "retstart": rank, "retmax": min(page, limit - rank) if limit else page, "retmode": "json"})

            def once():
                gate.wait()
                with urllib.request.urlopen(f"{o['url']}?{ask}", timeout=float(o.get("timeout", 20))) as answer:
                    return search_response(answer.read().decode("utf-8"))

            got = retrying(once, int(o.get("retries", 3)), float(o.get("base", 1.0)))
            for pmcid in got["pmcids"]:
                rank += 1
                if pmcid not in seen:
                    seen.add(pmcid)
                    yield (pmcid, rank)
            if not got["pmcids"] or rank >= (limit or got["total_count"]):
                return

    def _searched(self) -> Iterator[tuple]:
        words = self.options.get("query", "").lower().split()
        year, journal = self.options.get("year"), self.options.get("journal")
        limit = int(self.options.get("limit", 0) or 0)
        gate = RateLimit(float(self.options.get("delay", 0)))
        found = []
        for file in sorted(Path(self.options["path"]).glob("*.json")):
            gate.wait()
            for line in file.read_text(encoding="utf-8").splitlines():
                r = json.loads(line)
                if year and str(r.get("pub_year")) != str(year) or journal and r.get("journal") != journal:
                    continue
                text = " ".join([r.get("title") or "", *(r.get("keywords") or [])]).lower()
                hits = [text.count(w) for w in words]
                if all(hits):
                    found.append((-sum(hits), with_prefix(str(r["pmcid"]))))
        for rank, (_, pmcid) in enumerate(sorted(set(found))[: limit or None], 1):
            yield (pmcid, rank)


class ArticleSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "pmcid string, rank int"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleSearch)
