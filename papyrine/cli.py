"""Command line: one command per stage.

``python -m papyrine.cli chunk --limit 10`` and so on; exit code 1 if a stage fails.
"""

from __future__ import annotations

import argparse
import importlib.util
import os
import shutil
import signal
import sys
from dataclasses import replace
from pathlib import Path

from papyrine.config import Settings
from papyrine.log import stage_logger
from papyrine.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyrine")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "parse", "chunk", "embed", "index"):
        c = sub.add_parser(name)
        c.add_argument("--limit", type=int, default=None)
        c.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--force", action="store_true")
        c.add_argument("--verbose", action="store_true")
        c.add_argument("--pmcid", default=None)
        c.add_argument("--data-dir", default=None)
        if name == "ingest":
            c.add_argument("--source", required=True, help="folder of XML files, with JSON records beside them where a query is given; or an address with {pmcid}")
            c.add_argument("--search", default=None, help="address of a search service")
            c.add_argument("--query", default="")
            c.add_argument("--year", type=int)
            c.add_argument("--journal")
        if name in ("embed", "index"):
            c.add_argument("--batch-size", type=int, default=None)
        if name == "embed":
            c.add_argument("--device", default=None)
            c.add_argument("--model", default="hashing")
        if name == "index":
            c.add_argument("--recreate", action="store_true")
    sub.add_parser("setup").add_argument("--data-dir", default=None)
    sub.add_parser("check")
    return p


def check() -> dict[str, bool]:
    """Modules, Java, the Python version, and whether the data folder can be written."""
    found = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy", "tiktoken")}
    folder = Path(Settings.from_env().data_dir)
    place = next(p for p in (folder, *folder.absolute().parents) if p.exists())
    return found | {"java": bool(shutil.which("java") or os.environ.get("JAVA_HOME")), "python >= 3.10": sys.version_info >= (3, 10), f"{folder} writable": os.access(place, os.W_OK)}


def stop_gently(spark) -> None:
    """The first interrupt cancels the running jobs, so that finished work stays; the second one ends the process."""

    def once(*_) -> None:
        signal.signal(signal.SIGINT, signal.default_int_handler)
        spark.sparkContext.cancelAllJobs()

    signal.signal(signal.SIGINT, once)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    settings = Settings.from_env()
    if getattr(a, "data_dir", None):
        settings = replace(settings, data_dir=a.data_dir)
    if a.command == "setup":
        print(*settings.make_dirs(local_session() if "://" in settings.data_dir else None), sep="\n")
        return 0
    if a.command == "check":
        found = check()
        print(*(f"{k}: {'ok' if v else 'missing'}" for k, v in found.items()), sep="\n")
        return int(not all(found.values()))
    from papyrine.plans.pipelines import Run
    from papyrine.sources import fetch, files

    if getattr(a, "batch_size", None):
        settings = replace(settings, **{"embedding_batch_size" if a.command == "embed" else "indexing_batch_size": a.batch_size})
    spark = local_session()
    stop_gently(spark)
    log = stage_logger(a.command, f"{settings.data_dir}/logs", "DEBUG" if a.verbose else settings.log_level)
    run = Run(spark, settings)
    force = a.force or not a.resume
    try:
        if a.command == "ingest":
            remote = "{pmcid}" in a.source or "{number}" in a.source
            if a.search or a.query or a.year or a.journal:
                found = run.search(a.query, a.year, a.journal, a.limit, **({"url": a.search} if a.search else {"path": a.source}))
                raw = run.fetch(found, fetch.FromUrl(a.source, settings.timeout)) if remote else run.fetch(found, fetch.FromFolder(a.source), delay=0)
            elif remote:
                found = spark.createDataFrame([(a.pmcid,)], "pmcid string")
                raw = run.fetch(found, fetch.FromUrl(a.source, settings.timeout))
            else:
                found = raw = files.xml_files(spark, a.source, a.pmcid)
            raw = raw.persist()  # each text is fetched once
            out = run.ingest(found.select("pmcid"), raw, force, a.limit)
        elif a.command == "embed":
            out = run.embed(force, a.model, a.pmcid, a.limit, a.device)
        elif a.command == "index":
            out = run.index(force, a.recreate, a.pmcid, a.limit)
        else:
            out = getattr(run, a.command)(force, a.pmcid, a.limit)
        log.info("done: %s", out.toJSON().collect())  # one statistics row
        return 0
    except Exception as e:
        log.error("%s failed: %s", a.command, e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
