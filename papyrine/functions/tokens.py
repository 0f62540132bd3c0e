"""Token counters behind one interface: counting, and truncation to n tokens."""

from __future__ import annotations

import base64
import functools
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.text import _c


class TokenCounter(Protocol):
    def count(self, c: str | Column) -> Column: ...
    def truncate(self, c: str | Column, n: int) -> Column: ...
    def split(self, text: str) -> list[str]: ...


class Whitespace:
    """Words between blanks; runs inside the JVM."""

    def _words(self, c) -> Column:
        return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")

    def count(self, c) -> Column:
        return F.size(self._words(c))

    def truncate(self, c, n: int) -> Column:
        return F.array_join(F.slice(self._words(c), 1, n), " ")

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split()

    @staticmethod
    def join(parts: list[str]) -> str:
        return " ".join(parts)


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Bpe:
    """Byte-pair tokens of a vocabulary file; ``path`` and ``pattern`` are parameters, the file is read per worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def _encoding(self):
        return _encoding(self.path, self.pattern)

    def count(self, c) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("int")
        def run(s: pd.Series) -> pd.Series:
            enc = _encoding(path, pattern)
            return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

        return run(_c(c))

    def truncate(self, c, n: int) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            enc = _encoding(path, pattern)
            return s.map(lambda t: enc.decode(enc.encode_ordinary(t)[:n], errors="ignore") if t else "")

        return run(_c(c))

    def split(self, text: str) -> list[bytes]:
        enc = self._encoding()
        return [enc.decode_single_token_bytes(t) for t in enc.encode_ordinary(text)]

    @staticmethod
    def join(parts: list[bytes]) -> str:
        return b"".join(parts).decode("utf-8", errors="ignore").strip()


COUNTERS = {"whitespace": Whitespace, "bpe": Bpe}
