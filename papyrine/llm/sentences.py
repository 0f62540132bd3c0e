"""Sentence units of texts in many languages, by document-centred disambiguation.

Every terminator is a candidate. Scripts with their own terminators (CJK stops, danda, Arabic marks) end a sentence
there; Thai ends one at a blank between Thai letters. A period is ambiguous: whether the word before it is an
abbreviation, and whether the capitalised word behind it is a name or a common word, is decided from unambiguous
occurrences elsewhere in the same document (followed by a small letter, seen without a period, seen in small letters,
seen capitalised inside a sentence). Where the document has no evidence the corpus decides: one pass counts the same
evidence over all documents, and words that are abbreviations there form a lexicon. The most frequent entries are sent
to all tasks; the others are joined to the texts that may ask for them. Fixed lists hold titles and reference words of
the languages.

Defined results
* Positions count code points; a unit ends at its last character that is not blank. Null and blank texts give no rows.
* Closing quotes, brackets and citation marks directly behind a terminator belong to the sentence; a quotation followed
  by a small letter, a comma or a Japanese quotative does not end it; a Chinese quotation that opens the sentence does
  not end it if a verb of saying follows.
* A heading or list label on its own line is one unit; other line breaks end nothing.
* Texts are never cut; repeated rows are treated alike; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine import scratch

# Abbreviations that a name, noun or number follows, so that they do not end a sentence.
NEVER = set(
    """dr dra drs mr mrs ms mx prof profs st fr mme mlle mm mgr hr hrn sr sra srta ing dipl
    no nos nr nrs núm num fig figs abb tab taf suppl eq eqs ref refs vol vols sec ch chap app art éd ed eds p pp s v ver vers
    pág págs seg vs cf vgl bzw approx aprox ca env circa e.g i.e viz resp sog inkl exkl evtl ggf p.ex p.ej z.b d.h u.a s.o s.u v.a i.d.r
    n.b op sp spp var subsp ee sta gen univ dept col lt sgt capt rev hon pres gov
    проф акад доц им рис см стр ср напр табл гл ул т.е т.к г-н г-жа д-р د أ डॉ श्री""".split()
)
# Those of them that only a number or a short label follows.
NUMBERED = set("no nos nr nrs núm num fig figs abb tab taf eq eqs ref refs vol vols sec ch chap pág págs рис табл стр".split())
# Abbreviations that may also be the last word of a sentence.
MAY_END = set(
    """etc al a.m p.m inc ltd co corp llc gmbh jr u.k u.s u.s.a e.u u.n ph.d m.d b.sc m.sc i.v i.m s.c p.o b.i.d t.i.d q.d
    ff usw uu др т.д т.п г гг тыс млн млрд ibid""".split()
)
# German words before an ordinal number.
BEFORE_ORDINAL = set("der die das dem den des im am vom zum zur beim ein eine einem einen einer seit bis ab jeder jede jedes".split())
# Headings of articles in several languages.
HEADINGS = set(
    """abstract background introduction methods method materials results result discussion conclusion conclusions objective
    objectives aim aims purpose participants setting limitations ethics funding references findings interpretation
    hintergrund einleitung methoden methodik ergebnisse diskussion schlussfolgerung schlussfolgerungen ziele zielsetzung
    contexte méthodes résultats conclusions discussion objectifs matériel antecedentes introducción métodos resultados discusión
    conclusiones objetivos введение методы результаты обсуждение выводы заключение цель цели материалы
    المقدمة الطرق النتائج المناقشة الخلاصة الأهداف पृष्ठभूमि परिचय विधियाँ विधि परिणाम निष्कर्ष चर्चा उद्देश्य
    บทนำ วิธีการ ผลการศึกษา ผลลัพธ์ อภิปราย สรุป วัตถุประสงค์ 背景 方法 结果 结论 讨论 目的 引言 結果 結論 考察 序論 目的 はじめに""".split()
)
SAYING = re.compile("[问說说写寫道称稱喊答叫嚷]")
CLOSERS = "”»“」』\"’'›‹)]）】〉》］}"
OPENERS = "“„«「『\"‘'‹([（【〈《［{¿¡•"
CANDIDATE = re.compile("[.!?…。！？｡．।॥؟۔։።]|(?<=[฀-๿])[ \t\r\n ]+(?=[฀-๿])|\n")
HARD = set("。！？｡．।॥؟۔։።")
CITATION = re.compile(r"\[\d+(?:\s*[,;–-]\s*\d+)*\]|[⁰¹²³⁴-⁹]+(?:[,–-][⁰¹²³⁴-⁹]+)*")
LABEL = re.compile(r"(?:[•●▪◦‣*–—-]\s+|\(?[0-9]{1,2}[.)]\s|[0-9]{1,2}(?:\.[0-9]{1,2})+\.?\s|\(?[ivx]{1,4}\)\s)")
EVIDENCE = re.compile(r"(?<![\w.])([^\W\d_]+(?:\.[^\W\d_]+)*)\.(?=\s+([^\W_])|[,;:])")
SHORT = re.compile(r"(?<![\w.])[^\W\d_]{1,6}(?![\w.])")
LABELLED = re.compile(r"[^\W_]{1,2}\b|[IVXLC]+\b|[^\W\d_]{1,2}\d|\W")
# places where a unit may begin inside a line: behind a terminator, what may close a sentence, or a blank between Thai letters
BEGINS = re.compile(rf"(?:[.!?…{re.escape(''.join(sorted(HARD)) + CLOSERS)}⁰¹²³⁴-⁹]|(?<=[฀-๿])(?=\s+[฀-๿]))[\s\u200b\ufeff]*")
LONGEST = 8  # letters of an abbreviation in the lexicon
WORDS = 4  # words of a heading in the lexicon
GUILLEMET = re.compile("[   ]»")


def evidence(text: str, digits: bool = False) -> tuple[Counter, Counter]:
    """Words followed by a period where the sentence certainly goes on, and short words seen without a period.

    ``digits`` also counts short words before a number, which over a whole corpus tells reference words."""
    with_period, without = Counter(), Counter()
    for m in EVIDENCE.finditer(text):
        after = m[2]
        if after is None or after.islower() or digits and after.isdigit() and len(m[1]) <= 5:
            with_period[m[1].lower()] += 1
    if with_period:
        without.update(w.lower() for w in SHORT.findall(text))
    return with_period, without


class Splitter:
    def __init__(self, abbreviations: frozenset[str], headings: frozenset[str]):
        self.abbreviations, self.headings = abbreviations, headings
        self.own: frozenset[str] = frozenset()

    def ends(self, text: str, own: frozenset[str] = frozenset()) -> list[int]:
        """End positions of the units of ``text``; ``own`` holds those of its ``asked`` entries that are in the lexicon too."""
        self.own = own
        out: list[int] = []
        start = self._skip(text, 0)
        n = len(text)
        memo: dict = {}
        for m in CANDIDATE.finditer(text, start):
            i = m.start()
            if i < start:
                continue
            c = text[i]
            if c.isspace() and i > start and "฀" <= text[i - 1] <= "๿" and "฀" <= text[m.end() : m.end() + 1] <= "๿":
                end = i
            elif c == "\n":
                end = self._line_unit(text, start, i)
            elif c.isspace():
                end = 0
            else:
                end = self._sentence(text, start, i, memo)
            if end > start:
                out.append(end)
                start = self._skip(text, end)
        last = len(text.rstrip())
        if start < last <= n:
            out.append(last)
        return out

    def asked(self, text: str) -> set[str]:
        """Every entry that ``ends`` may look up, wherever the units begin, and that the lexicon sent to all tasks lacks:
        ``w`` and a word, or ``h`` and a heading."""
        out: set[str] = set()
        yes, no = evidence(text)
        for m in re.finditer(r"(?<=\S)\.", text):
            i = m.start()
            for a in range(i - 1, max(i - LONGEST, 0) - 1, -1):
                if self._bounds_word(text[a]):
                    break
                if a == 0 or not text[a - 1].isalpha():  # words and units begin behind something that is no letter
                    low = text[a:i].lower()
                    if len(low) <= LONGEST and low not in self.abbreviations and not (yes[low] or no[low]) and not re.search(r"\d", low):
                        out.add("w" + low)
        for whole in text.split("\n")[:-1]:
            line = whole.rstrip()
            for a in {self._skip(line, 0), *(m.end() for m in BEGINS.finditer(line))}:
                if 0 < len(line) - a <= 80:
                    bare = self._parts(line[a:])[2]
                    if 0 < len(bare.split()) <= WORDS and bare not in self.headings:
                        out.add("h" + bare)
        return out

    @staticmethod
    def _skip(text: str, i: int) -> int:
        n = len(text)
        while i < n and (text[i].isspace() or text[i] in "​﻿"):
            i += 1
        return i

    @staticmethod
    def _parts(line: str) -> tuple[re.Match | None, str, str]:
        """Label of a line, what follows it, and that as a heading is looked up."""
        label = LABEL.match(line)
        core = line[label.end() :] if label else line
        return label, core, core.rstrip("  :：.").lower()

    def _line_unit(self, text: str, start: int, i: int) -> int:
        """End of a heading or label that fills its line, else 0."""
        line = text[start:i].rstrip()
        if not line or "\n" in line or len(line) > 80:
            return 0
        j = self._skip(text, i)
        if j >= len(text):
            return 0
        nxt = text[j]
        if nxt.islower() or nxt in ",;:)]}»”.!?":
            return 0
        end = start + len(line)
        label, core, bare = self._parts(line)
        words = bare.split()
        if not words:
            return end if label else 0
        if len(words) > 8 or core[-1] in ",;(–-":
            return 0
        if label and len(words) <= 6:
            return end
        if core[-1] in ":：" and len(words) <= 4:
            return end
        if bare in self.headings or "h" + bare in self.own or all(w in HEADINGS or w in ("and", "und", "et", "y", "и", "&") for w in words):
            return end
        if len(words) <= 4 and len(core) > 4 and core.isupper() and not any(ch.isdigit() for ch in core):
            return end
        return 0

    def _tail(self, text: str, start: int, i: int) -> int:
        """Position behind closing quotes, brackets and citation marks that follow a terminator."""
        n = len(text)
        while True:
            if i < n and text[i] in CLOSERS:
                c = text[i]
                if c in "“\"'’" and c != "’":
                    # could open a quotation instead: an odd number of quotes must be open before it
                    before = text[start:i]
                    if c == "“" and "„" not in before and before.count("“") <= before.count("”"):
                        return i
                    if c in "\"'" and before.count(c) % 2 == 0:
                        return i
                i += 1
            elif i < n and (m := CITATION.match(text, i)):
                i = m.end()
            elif (m := GUILLEMET.match(text, i)) and text.count("«", start, i) > text.count("»", start, i):
                i = m.end()
            else:
                return i

    def _sentence(self, text: str, start: int, i: int, memo: dict) -> int:
        n = len(text)
        c = text[i]
        j = i + 1
        while j < n and text[j] in ".!?…。！？":
            j += 1
        dots = text[i:j]
        e = self._tail(text, start, j)
        if e >= n:
            return e
        k = self._skip(text, e)
        if k >= n:
            return e
        nxt = text[k]
        if c in HARD or any(x in HARD for x in dots):
            if e > j:  # a quotation closed behind the terminator
                if nxt in "とって，、,；;：:" or nxt.islower():
                    return 0
                if k == e and text[start] in "“「『\"«" and "一" <= self._first_cjk(text, k) and SAYING.search(text, k, self._next_stop(text, k)):
                    return 0
                if nxt in "的地得" or "ぁ" <= nxt <= "ゖ" and nxt in "とがのをにはへもで":
                    return 0
            return e
        if c == "…" or len(dots) > 1 and set(dots) <= {".", "…"}:
            if self._opens_new(text, k) and k > e:
                return e
            return 0
        if c in "!?":
            if k == e:
                return e if nxt.isupper() or nxt in OPENERS or self._caseless(nxt) else 0
            return e if self._opens_new(text, k) or nxt.isdigit() else 0
        # a period
        if i == start or text[i - 1].isspace():
            return 0
        word = self._word_before(text, start, i)
        low = word.lower()
        if k == e:  # no blank behind it
            if not (nxt.isupper() or nxt in "“«„¿¡" or self._caseless(nxt)):
                return 0
            if e > j:
                return e
            tail = re.split(r"[./]", low)[-1]
            if self._caseless(nxt):
                return e if self._caseless(text[i - 1]) and len(tail) > 1 and low not in NEVER and "ऀ" > text[i - 1] else 0
            if nxt.isupper() and not (k + 1 < n and (text[k + 1].islower() or text[k + 1].isupper() and len(tail) > 3)):
                return 0
            return e if (len(tail) >= 3 or tail.isdigit()) and not self._abbreviation(low, text, memo) else 0
        if "ऀ" <= text[i - 1] <= "ॿ":  # Devanagari ends sentences with a danda
            return 0
        if nxt.islower() or nxt in ",;:)]}":
            return 0
        if e > j and text[j] in ")]}" and not self._opens_new(text, k) and not nxt.isdigit():
            return 0
        if nxt in OPENERS and not self._opens_new(text, k):
            return 0
        if e > j:
            return e
        if low.isdigit() and len(low) <= 2:
            before = text[:i].rstrip()[: -len(low)].rstrip()
            prev = re.split(r"[\s(„“]", before)[-1].lower() if before else ""
            at_line_start = text[max(start, text.rfind("\n", 0, i) + 1) : i].strip() == low
            if nxt.isdigit() or at_line_start or prev in BEFORE_ORDINAL or re.fullmatch(r"\d{1,2}\.", prev):
                return 0
        if nxt.isdigit():
            return 0 if low in NEVER or len(low) == 1 and low.isalpha() or self._abbreviation(low, text, memo) else e
        if low in NEVER or len(low) == 1 and low.isalpha() and low not in MAY_END:
            if self._ordinary(word, text, memo) or low in NUMBERED and not LABELLED.match(text, k):
                return e
            return 0
        if low in MAY_END:
            return e
        if self._abbreviation(low, text, memo):
            return e if self._common_word(text, k, memo) else 0
        return e

    @staticmethod
    def _caseless(c: str) -> bool:
        return c.isalpha() and not c.isupper() and not c.islower()

    def _opens_new(self, text: str, k: int) -> bool:
        """Whether the text at ``k`` can begin a sentence."""
        n = len(text)
        while k < n and (text[k] in OPENERS or text[k].isspace()):
            k += 1
        return k < n and (text[k].isupper() or self._caseless(text[k]) or text[k].isdigit())

    @staticmethod
    def _bounds_word(c: str) -> bool:
        return c.isspace() or c in "([{“„«\"¿¡,:;<>=’'–"

    @staticmethod
    def _word_before(text: str, start: int, i: int) -> str:
        a = i
        while a > start and not Splitter._bounds_word(text[a - 1]):
            a -= 1
        return text[a:i]

    @staticmethod
    def _first_cjk(text: str, k: int) -> str:
        return next((c for c in text[k : k + 40] if c >= "一"), "")

    @staticmethod
    def _next_stop(text: str, k: int) -> int:
        stops = [p for p in (text.find(s, k) for s in "。！？\n") if p >= 0]
        return min(stops, default=len(text))

    def _abbreviation(self, low: str, text: str, memo: dict) -> bool:
        """Evidence of this document first, then the corpus."""
        if "own" not in memo:
            memo["own"] = evidence(text)
        yes, no = memo["own"]
        if yes[low] or no[low]:
            return yes[low] > no[low]
        return low in self.abbreviations or "w" + low in self.own

    def _ordinary(self, word: str, text: str, memo: dict) -> bool:
        """Whether the document uses a listed word inside its sentences as a common one: without a period, before a small
        letter or a comma, and never with a period where the sentence certainly goes on."""
        if ("word", word) not in memo:
            if "own" not in memo:
                memo["own"] = evidence(text)
            used = memo["own"][0][word.lower()] == 0 and re.search(rf"(?<=[^\W\d_A-Z] ){re.escape(word)}(?:[,;:]|\s[^\W\d_A-Z])", text)
            memo["word", word] = bool(used) and not used[0][-1].isupper()
        return memo["word", word]

    @staticmethod
    def _common_word(text: str, k: int, memo: dict) -> bool:
        """Whether the word at ``k`` is capitalised only because it begins a sentence."""
        m = re.compile(r"[^\W_]+").match(text, k)
        if not m:
            return True
        if "small" not in memo:
            memo["small"] = set(re.findall(r"\b[^\W\d_]+\b", text))
            memo["inside"] = set(re.findall(r"(?<=[^\W\d_A-Z] )[^\W\d_]+", text))
        if m[0].lower() in memo["small"]:
            return True
        return m[0] not in memo["inside"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: evidence per word, and lines that stand alone before a capital. The counts may come out in parts."""
    yes, no, lines = Counter(), Counter(), Counter()

    def counts() -> pa.RecordBatch:
        words = list(yes | no)
        heads = list({k for k, _ in lines})
        return pa.RecordBatch.from_arrays([
            pa.array(["w"] * len(words) + ["h"] * len(heads)), pa.array(words + heads, pa.string()),
            pa.array([yes[w] for w in words] + [lines[(h, True)] for h in heads], pa.int64()),
            pa.array([no[w] for w in words] + [lines[(h, False)] for h in heads], pa.int64()),
        ], ["what", "word", "yes", "no"])

    for b in batches:
        for t in b.column(0).to_pylist():
            a, c = evidence(t, digits=True)
            yes.update(a)
            no.update(c)
            if "\n" in t:
                for line, after in re.findall(r"(?:^|\n)[ \t]*([^\n]{2,40}?)[ \t]*\n\s*([^\W\d_])", t):
                    if line[-1] not in ".!?,;。！？।؟" and len(line.split()) <= WORDS:
                        lines[(line.rstrip("  :：").lower(), not after.islower())] += 1
            if len(yes) + len(no) + len(lines) > 500_000:
                yield counts()
                for done in (yes, no, lines):
                    done.clear()
    yield counts()


def corpus_lexicon(texts: DataFrame, least: int = 5, most: int = 50_000) -> tuple[tuple[frozenset[str], frozenset[str]], DataFrame | None]:
    """Abbreviations and headings of the whole corpus, from a column ``text``: those to send to all tasks, and all others.

    Counts are combined per task before the shuffle. Words of at most ``LONGEST`` letters and headings of at most ``WORDS``
    words enter with at least ``least`` cases. The ``most`` frequent ones come as two sets; if there are more, the rest
    comes as a table ``(entry)`` with entries as in ``Splitter.asked``.
    """
    counted = texts.mapInArrow(_count, "what string, word string, yes bigint, no bigint").groupBy("what", "word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    kept = counted.where((F.col("yes") >= least) & (F.col("yes") > 3 * F.col("no")) & ((F.col("what") == "h") | (F.length("word") <= LONGEST)))
    table, n = scratch.counted(kept.select("what", "word", "yes"), "lexicon")
    rows = table.orderBy(F.desc("yes"), "word", "what").limit(most).collect()
    sent = frozenset(r["word"] for r in rows if r["what"] == "w"), frozenset(r["word"] for r in rows if r["what"] == "h")
    if n <= most:
        scratch.discard(table)
        return sent, None
    entry = F.concat("what", "word").alias("entry")
    if not rows:
        return sent, table.select(entry)
    last = rows[-1]
    yes, word, what = (F.lit(last[c]) for c in ("yes", "word", "what"))
    later = (F.col("word") > word) | (F.col("word") == word) & (F.col("what") > what)
    return sent, table.where((F.col("yes") < yes) | (F.col("yes") == yes) & later).select(entry)


def _asked(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(*sent.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                distinct = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                found = [(k, e) for k, t in distinct.items() for e in splitter.asked(t)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([e for _, e in found], pa.string())], ["key", "entry"])

    return run


def _split(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(*sent.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                texts = b.column(2).to_pylist()
                own = b.column(3).to_pylist() if b.num_columns > 3 else [None] * len(texts)
                found = [splitter.ends(t, frozenset(o or ())) for t, o in zip(texts, own, strict=True)]
                at = [i for i, f in enumerate(found) for _ in f]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array([e for f in found for e in f], pa.int32())], ["kind", "id", "end_pos"]
                )

    return run


def sentence_ends(tables: list[tuple[str, DataFrame, str, str]], most: int = 50_000) -> DataFrame:
    """``(kind, id, end_pos)`` for ``(kind, frame, id column, text column)`` entries.

    A lexicon of up to ``most`` entries is sent to all tasks. Of a larger one the ``most`` frequent are sent, and each text gets
    those of the others that it may ask for by a join; the result is the same.
    """
    parts = [
        df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and trim(text) <> ''")
        for kind, df, key, text in tables
    ]
    texts = parts[0]
    for more in parts[1:]:
        texts = texts.unionByName(more)
    lexicon, rest = corpus_lexicon(texts.select("text"), most=most)
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)  # at most ``most`` words
    if rest is not None:
        texts = texts.withColumn("key", F.unhex(F.sha2("text", 256)))
        asked = texts.select("key", "text").mapInArrow(_asked(sent), "key binary, entry string")
        own = asked.join(rest, "entry").groupBy("key").agg(F.collect_set("entry").alias("own"))
        texts = texts.join(own, "key", "left").select("kind", "id", "text", "own")
    return texts.mapInArrow(_split(sent), "kind string, id bigint, end_pos int")
