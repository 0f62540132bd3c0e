"""Article texts from a service or a folder, fetched in tasks with a rate limit and retries; failures are rows, not errors."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from papyrine.sources.search import RateLimit, retrying

FETCHED = "pmcid string, xml string, status string, attempts int, error string"


class FromUrl:
    """``template`` holds ``{pmcid}``, or ``{number}`` for the id without its prefix."""

    def __init__(self, template: str, timeout: float = 20):
        self.template, self.timeout = template, timeout

    def __call__(self, pmcid: str) -> bytes | None:
        url = self.template.format(pmcid=pmcid, number=pmcid.removeprefix("PMC"))
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            raise


class FromFolder:
    """Files ``<pmcid>.xml`` of a folder that all executors can read."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, pmcid: str) -> bytes | None:
        file = Path(self.folder) / f"{pmcid}.xml"
        return file.read_bytes() if file.is_file() else None


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def fetch(found: DataFrame, opener: Callable[[str], bytes | None], delay: float = 0.3, retries: int = 3, base: float = 1.0, tasks: int = 1) -> DataFrame:
    """``(pmcid, xml, status, attempts, error)`` of every distinct id: fetched, missing (no such text) or failed.

    All ``tasks`` together start a request every ``delay`` seconds at most. A failed request is repeated after ``base``
    seconds, then after twice as long and so on, with a random part.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = RateLimit(delay * tasks)
        for f in frames:
            out = []
            for pmcid in f["pmcid"]:
                tried = 0

                def once(pmcid=pmcid):
                    nonlocal tried
                    tried += 1
                    gate.wait()
                    return opener(pmcid)

                try:
                    data = retrying(once, retries, base, lambda s: time.sleep(s * (0.5 + random.random())))
                    out.append((pmcid, None if data is None else decoded(data), "missing" if data is None else "fetched", tried, None))
                except (OSError, ValueError) as e:
                    out.append((pmcid, None, "failed", tried, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["pmcid", "xml", "status", "attempts", "error"])

    ids = found.select("pmcid").where("pmcid is not null").distinct()
    return ids.repartition(tasks, "pmcid").mapInPandas(run, FETCHED)
