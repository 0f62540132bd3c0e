"""Logs of a stage: everything from the set level, warnings and errors apart, and the console.

The files are the driver's own; with a data folder on another file system only the console is used."""

from __future__ import annotations

import logging
from pathlib import Path


def stage_logger(stage: str, folder: str, level: str = "INFO", console: bool = True) -> logging.Logger:
    files = "://" not in folder
    if files:
        Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"papyrine.{stage}")
    log.setLevel(level)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    to_files = ((logging.FileHandler(f"{folder}/{stage}.log", encoding="utf-8"), level), (logging.FileHandler(f"{folder}/{stage}_errors.log", encoding="utf-8"), "WARNING")) if files else ()
    for handler, low in (*to_files, *([(logging.StreamHandler(), level)] if console or not files else [])):
        handler.setLevel(low)
        handler.setFormatter(form)
        log.addHandler(handler)
    log.propagate = False
    return log
