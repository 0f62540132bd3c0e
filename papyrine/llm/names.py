"""Variant spellings of names typed by people, by merging and rematching.

Every spelling becomes a profile: for a person the family names, given names and middle initials it shows; for a group
or journal the alternatives at each word position. Profiles meet in blocks under keys that survive one slip of the pen
(a name with one letter left out, together with the other part of the name), and match if one part agrees and the other
is close. Matching profiles are merged: the merged one holds the spellings and initials of all, and re-enters blocking
with them, until no further merge occurs. Spellings with initials only name whoever they fit, so they are attached to
all profiles they fit, and never merge two persons; neither do titles whose end is cut off.

Given names are told from family names by the corpus (which words stand before a middle initial or behind a comma), and
nicknames are taken from a general list and learned: a given name that shares its family names with another far beyond
chance is the same person's.

Defined results
* Null, empty and blank entries are no names; repeated rows count once; a name that matches nothing gives no pair.
* Two words or family names that differ by one letter are different where both are frequent. One is taken for a slip where it is
  met in at most 2 spellings (a given name: 4), or a twentieth as often as the other.
* Statistics for nicknames count all family names. Under those with more than 8 given names, names meet by chance; a nickname
  must share twice as many family names with its full name as it shares of these with any other one.
* All pairs of spellings of one person, group or journal are returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.components import components
from papyrine.scratch import counted, discard, materialize

# Common given names and their usual short forms in several languages; further ones are learned from the corpus.
NICKNAMES = {
    "alexander": "alex sandy sasha", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck",
    "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "donald": "don", "edward": "ed eddie ned ted", "francis": "frank",
    "frederick": "fred freddie", "gerald": "gerry", "gregory": "greg", "henry": "harry hank", "james": "jim jimmy", "jeffrey": "jeff",
    "john": "jack johnny", "joseph": "joe", "joshua": "josh", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny", "matthew": "matt",
    "michael": "mike mick mickey", "nathaniel": "nat nate", "nicholas": "nick", "patrick": "paddy pat", "peter": "pete", "philip": "phil",
    "raymond": "ray", "richard": "dick rick rich", "robert": "bob bobby rob", "ronald": "ron", "samuel": "sam", "stephen": "steve",
    "theodore": "ted theo", "thomas": "tom tommy", "timothy": "tim", "walter": "walt wally", "william": "bill billy will",
    "amanda": "mandy", "barbara": "barb", "catherine": "cathy", "christine": "chris chrissie", "deborah": "debbie", "dorothy": "dot dolly",
    "eleanor": "ellie nell", "elizabeth": "beth betty eliza liz lizzie", "jacqueline": "jackie", "jennifer": "jen jenny", "judith": "judy",
    "katherine": "kate kathy katie", "kimberly": "kim", "margaret": "maggie meg peggy", "mary": "molly polly", "pamela": "pam", "patricia": "patty tricia",
    "penelope": "penny", "rebecca": "becca becky", "sarah": "sally", "susan": "sue susie", "susannah": "sue susie", "victoria": "tori vicky",
    "concepcion": "concha", "dolores": "lola", "enrique": "quique", "francisco": "paco pancho", "guadalupe": "lupe", "ignacio": "nacho", "jose": "pepe",
    "manuel": "manolo", "gabriela": "gabi gaby", "giovanni": "gianni", "giuseppe": "beppe peppe", "luigi": "gigi", "johannes": "hannes hans",
    "maximilian": "max", "anastasia": "nastya", "dmitri": "dima mitya", "ivan": "vanya", "mikhail": "misha", "natalia": "natasha", "nikolai": "kolya",
    "tatiana": "tanya", "yekaterina": "katya", "agnieszka": "aga", "aleksandra": "ola", "konstantinos": "kostas",
}
# Words of titles and names that carry no identity.
STOP = set("of and the for on in und et de la le del der die des du y e".split())
GROUP = set("study group grp consortium cons network netw collaborative collab collaboration working registries registry investigators trialists initiative alliance committee trial trials invest".split())
LONG_GROUP = [g for g in GROUP if len(g) > 6]
PARTICLES = set("von van der den de dos da di del della du la le al el bin ibn ter ten zu o".split())
DEGREES = set("md phd msc bsc frcp mph dds jr sr ii iii".split())
TITLES = set("dr prof mr mrs ms professor doctor".split())
FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.lower().translate(FOLD))
    return "".join(c for c in t if not unicodedata.combining(c))


def plain(word: str) -> str:
    """Letters only, one form for umlauts written out."""
    w = re.sub(r"[^a-z0-9\w]|_", "", fold(word))
    return re.sub("([aou])e", r"\1", w) if len(w) > 4 else w


def close(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def shorter(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


FORMAL = {s: g for g, short in NICKNAMES.items() for s in short.split()}
OFFICIAL = re.compile(r"[:;,–-]\s*(?:the\s+)?official (?:journal|organ|publication).*$", re.I)


def _initials(text: str) -> str | None:
    """Letters of a run of initials such as 'A.', 'AB', 'J-B.', or None."""
    letters = re.sub(r"[\s.\-]", "", text)
    if 1 <= len(letters) <= 3 and letters.isupper() and letters.isalpha():
        return fold(letters)
    return None


def clean(name: str) -> str:
    n = re.sub(r"\s+", " ", name.replace("’", "'").replace("‐", "-").replace("‑", "-")).strip()
    n = re.sub(r"^on behalf of (?:the )?", "", n, flags=re.I)
    n = re.sub(r"(?:^|(?<=[\s-]))Ó (?=[^\W\d_]{2})", "", n)
    words = n.split(" ")
    while len(words) > 1 and re.sub(r"\W", "", fold(words[0])) in TITLES:
        words = words[1:]
    n = " ".join(words)
    while (m := re.search(r"[,\s]+([A-Za-z.]+)$", n)) and re.sub(r"\W", "", m[1].lower()) in DEGREES and "," in m[0]:
        n = n[: m.start()]
    return n.strip(" ,;")


def is_group(name: str) -> bool:
    words = re.findall(r"[^\W\d_]+", fold(name))
    if len(words) >= 3 and "," not in name and any(w in GROUP or len(w) > 6 and any(close(w, g) for g in LONG_GROUP) for w in words):
        return True
    return bool(re.fullmatch(r"[^\W\d_]{4,}\.? [A-Z]{3,5}", name)) and not name.isupper()


class Known:
    """Words known as given names, and those within one slip of one of them."""

    def __init__(self, words: Iterable[str], near: Iterable[str] | None = None):
        self.words = frozenset(words)
        self.near = None if near is None else frozenset(near)
        self.forms = {s for g in self.words if len(g) > 3 for s in shorter(g)} if near is None else None

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def level(self, word: str) -> int:
        if word in self.words:
            return 2
        return int(word in self.near if self.forms is None else any(s in self.forms for s in shorter(word)))


def asked_words(name: str) -> set[str]:
    """The words of a name that ``parse_person`` may look up."""
    words = clean(name).split(" ")
    return {plain(words[0]), plain(words[-1]), plain("".join(words[:2])), plain("".join(words[-2:]))} - {""}


def parse_person(name: str, given: Known) -> tuple[str, str, str, str] | None:
    """``(family, given or '', initial, middles)``; an empty given marks a spelling with initials only."""
    n = clean(name)
    if not n:
        return None
    if "," in n:
        family, _, rest = n.partition(",")
        words, front = rest.split(), family.split()
        return _finish(front, words)
    words = n.split(" ")
    if len(words) == 1:
        dotted = re.fullmatch(r"((?:[^\W\d_]\.-?)+)([^\W\d_]{3,}.*)", n)
        return _finish([dotted[2]], [dotted[1]]) if dotted else None
    if (i := _initials(words[-1])) and len(words) >= 2 and not (len(words[-1]) > 1 and n.isupper()) and plain(words[-1]) not in given:
        if not _initials(words[0]):
            return _finish(words[:-1], [words[-1]])
    if _initials(words[0]) or "." in words[0]:
        k = 1
        while k < len(words) - 1 and _initials(words[k]) and plain(words[k]) not in PARTICLES:
            k += 1
        return _finish(words[k:], words[:k])
    if words[0].isupper() and len(words[0]) > 2 and not n.isupper() and not all(w.isupper() for w in words if len(w) > 2):
        k = 1
        while k < len(words) and words[k].isupper() and len(words[k]) > 2:
            k += 1
        return _finish(words[:k], words[k:])
    # two or more spelled words: the corpus tells which end is the given name
    first, last = plain(words[0]), plain(words[-1])
    if given.level(last) > given.level(first) or first in PARTICLES:
        k = len(words) - 1
        if k >= 2 and plain(words[k - 1] + words[k]) in given:
            k -= 1
        return _finish(words[:k], words[k:])
    k = 1
    if len(words) > 2 and plain(words[0] + words[1]) in given:
        k = 2
    while k < len(words) - 1 and (m := _initials(words[k])) and len(m) == 1 and (words[k].endswith(".") or m not in ("o",)):
        k += 1
    return _finish(words[k:], words[:k])


def _finish(family: list[str], front: list[str]) -> tuple[str, str, str, str] | None:
    core = [w for w in family if plain(w) not in PARTICLES] or family
    fam = plain(re.sub(r"^(?:al|el)-", "", " ".join(core), flags=re.I))
    spelled = [w for w in front if not _initials(w) and not re.fullmatch(r"(?:[^\W\d_]\.-?)+", w) and plain(w) not in PARTICLES]
    letters = "".join(re.sub(r"[\s.\-]", "", fold(w)) for w in front if w not in spelled and plain(w) not in PARTICLES or _initials(w) and w.endswith("."))
    hyphen = any("-" in w for w in front)
    if not fam or len(fam) < 2:
        return None
    if spelled:
        g = plain("".join(spelled))
        parts = re.split(r"[-\s]", " ".join(spelled))
        extra = fold(parts[1])[:1] if len(parts) > 1 and parts[1] else ""
        return (fam, g, fold(parts[0])[:1], (letters[:1] or "") + ("+" + extra if extra else ""))
    if not letters:
        return None
    return (fam, "", letters[0], "" if hyphen or len(letters) < 2 else letters[1])


def title_words(name: str) -> tuple[list[str], bool]:
    """Content words of a group or journal name in order, and whether the end is cut off."""
    n = name.strip()
    cut = n.endswith(("…", "..."))
    n = n.rstrip("….")
    n = re.sub(r"^\s*on behalf of\s+", "", n, flags=re.I)
    n = re.sub(r"\((?:online|print|internet|electronic)[^)]*\)", " ", n, flags=re.I)
    n = OFFICIAL.sub(" ", n)
    if m := re.fullmatch(r"([^\W\d_]{4,})\.? ([A-Z]{3,5})", n.strip()):
        if not n.isupper():
            return [plain(m[1]), *fold(m[2])], False
    words = [plain(w) for w in re.findall(r"[^\W_]+", n)]
    words = [w for i, w in enumerate(words) if w and w not in STOP and not _no_word(i, w)]
    return words, cut


def _no_word(i: int, w: str) -> bool:
    """The closing word of a group, and slipped little words."""
    if len(w) > 5 and ("investigators".startswith(w) or close(w, "investigators")):
        return True
    return i > 0 and len(w) < 4 and w != "ann" and any(close(w, x) for x in ("of", "and", "the", "for"))


def turned(name: str) -> str | None:
    """A title in two parts with the parts exchanged."""
    name = OFFICIAL.sub(" ", name)
    front, colon, back = name.partition(":")
    if not colon or not front.strip() or not back.strip():
        return None
    cut = re.sub(r"\((?:online|print|internet|electronic)[^)]*\)", " ", back, flags=re.I)
    return None if name.rstrip().endswith(("…", "...")) else f"{cut.strip(' .')} {front.strip()}"


def abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word abbreviates the other: a prefix, or its first letter and some more in order."""
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a):
        return True
    if a[0] != b[0] or len(a) > 5 or len(a) < 3 or len(a) > 0.75 * len(b):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


# ---- profiles: kind, pid, slots (alternatives per position), middles


def person_keys(slots: list[list[str]]) -> set[str]:
    family, given = slots
    keys = set()
    for f in family:
        for g in given:
            if len(f) > 3:
                keys.update(f"g|{g}|{s}" for s in shorter(f))
            if len(g) > 2:
                keys.update(f"f|{f}|{s}" for s in shorter(g))
            keys.add(f"f|{f}|{g}")
    return keys


def title_keys(slots: list[list[str]]) -> set[str]:
    """First letters of all positions in all combinations met, as they are and with each one left open."""
    keys = set()
    anchors = {w[:3] for s in slots[:2] for w in s if len(w) > 5} | {w[:3] for s in slots for w in s if len(w) > 7}
    for letters in product(*({w[0] for w in s} for s in slots)):
        first = "".join(letters)
        keys.add(f"t|{first}")
        for i in range(len(first)):
            keys.update(f"w|{first[:i]}?{first[i + 1 :]}|{a}" for a in anchors)
    return keys


def rare(n: int, other: int, least: int) -> bool:
    """Whether a word is so much rarer than the other that it can be a slip of it: met at most ``least`` times, or a small part as often."""
    return min(n, other) <= max(least, SLIP_SHARE * max(n, other))


def persons_match(a, b) -> bool:
    ma, mb = {m for m in a["middles"] if not m.startswith("+")}, {m for m in b["middles"] if not m.startswith("+")}
    if ma and mb and not ma & mb:
        return False
    (fa, ga), (fb, gb) = a["slots"], b["slots"]
    na, nb = a["freq"], b["freq"]
    if not set(fa).isdisjoint(fb):
        return not set(ga).isdisjoint(gb) or any(close(x, y) and max(len(x), len(y)) > 2 and rare(na.get(x, 0), nb.get(y, 0), 4) for x in ga for y in gb)
    if not set(ga).isdisjoint(gb):
        return any(len(x) > 4 and close(x, y) and rare(na.get(x, 0), nb.get(y, 0), 2) for x in fa for y in fb)
    return False


def titles_match(a, b) -> bool:
    sa, sb = a["slots"], b["slots"]
    if len(sa) != len(sb):
        return False
    na, nb = a["freq"], b["freq"]
    slips = 0
    for x, y in zip(sa, sb):
        if x == y or not set(x).isdisjoint(y) or any(abbreviates(p, q) for p in x for q in y):
            continue
        if any(rare(na.get(p, 0), nb.get(q, 0), 2) and _slipped(p, q) for p in x for q in y):
            slips += 1
            if slips <= 1:
                continue
        return False
    return True


def _slipped(a: str, b: str) -> bool:
    """The same word, or an abbreviation and its word, with one slip."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > 2 and len(a) > 1 and close(a, b):
        return True
    return len(a) > 3 and any(close(a, b[:n]) for n in (len(a) - 1, len(a), len(a) + 1))


SLIP_SHARE = 0.05
PROFILE = "kind string, pid bigint, slots array<array<string>>, middles array<string>, freq map<string,bigint>"


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keys = [person_keys(s) if k == "person" else {k + x for x in title_keys(s)} for k, s in zip(f["kind"], f["slots"])]
        yield pd.DataFrame({"pid": np.repeat(f["pid"].to_numpy(np.int64), [len(k) for k in keys]), "key": [x for k in keys for x in sorted(k)]})


def _linked(rows: list[dict]) -> list[tuple[int, int]]:
    """Links that join the matching profiles of one block; those joined already are not compared again."""
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    match = persons_match if rows[0]["kind"] == "person" else titles_match
    mixed = len({r["own"] for r in rows}) > 1  # a block of two tiles: each tile has met itself elsewhere
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a["pid"] == b["pid"] or mixed and a["own"] == b["own"]:
                continue
            x, y = top(i), top(j)
            if x != y and match(a, b):
                root[max(x, y)] = min(x, y)
                out.append((min(a["pid"], b["pid"]), max(a["pid"], b["pid"])))
    return out


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within each block of rows sorted by block."""
    held: list[dict] = []
    for f in frames:
        found = []
        f["freq"] = [dict(x) for x in f["freq"]]
        f["slots"] = [[list(w) for w in x] for x in f["slots"]]
        for r in f.to_dict("records"):
            if held and r["block"] != held[0]["block"]:
                found += _linked(held)
                held = []
            held.append(r)
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])
    if held and (found := _linked(held)):
        yield pd.DataFrame(found, columns=["a", "b"])


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(pid, root)`` of all links of one task, by hooking roots to smaller ones and shortening the paths."""
    links = [f[["a", "b"]].to_numpy(np.int64) for f in frames]
    if not links:
        return
    nodes, at = np.unique(np.concatenate(links).T, return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"pid": nodes, "root": nodes[root]})


def _closed(edges: DataFrame, links: int, in_one: int = 1_000_000) -> DataFrame:
    """``(pid, root)`` for both ends of links ``(a, b)``: the smallest one over any number of steps.

    Up to ``in_one`` links are closed by one task, more by rounds over the cluster; the result is the same.
    """
    if links > in_one:
        return components(edges).select(F.col("node").alias("pid"), F.col("component").alias("root"))
    return edges.coalesce(1).mapInPandas(_grouped, "pid bigint, root bigint")


def _united(rows: DataFrame, by: str) -> DataFrame:
    """Rows of one profile each, united: alternatives per position, middle initials and counts of all."""
    empty = F.first("slots")
    united = rows.groupBy(F.col(by).alias("pid")).agg(
        F.first("kind").alias("kind"), F.aggregate(F.collect_set("slots"), F.transform(empty, lambda x: F.array().cast("array<string>")), lambda a, x: F.zip_with(a, x, lambda p, q: F.array_union(p, q))).alias("slots"),
        F.array_distinct(F.flatten(F.collect_set("middles"))).alias("middles"), F.flatten(F.collect_set(F.map_entries("freq"))).alias("freq"),
    )
    freq = F.map_from_entries(F.array_distinct("freq"))  # a word has one count
    return united.select("kind", "pid", F.transform("slots", lambda x: F.array_sort(x)).alias("slots"), "middles", freq.alias("freq"))


def _blocks(profiles: DataFrame, keyed: DataFrame, tile: int) -> DataFrame:
    """Profiles under every key they share with another one; a block of more than ``tile`` rows is met tile against tile."""
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # lone rows need not move as wide rows
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = keyed.join(many, "key").withColumn("own", F.pmod(F.xxhash64("pid"), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    block = F.when(F.col("n") <= tile, F.xxhash64("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select("pid", "own", block.alias("block")).join(profiles, "pid")


def _resolve(profiles: DataFrame, tile: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Merge and rematch until nothing changes: final profiles and ``(pid, root)`` of all that were merged.

    Keys of profiles that did not change are kept; after the first round only blocks that hold a merged profile meet
    again. Every round with a match leaves fewer profiles, so the rounds end. Each round is written; the profiles of the
    round before are removed. The root of a group is its smallest id in every round, so all rounds' links closed give
    the last roots.
    """
    keyed = [materialize(profiles.mapInPandas(_keyed, "pid bigint, key string"), "keyed")]
    blocks, gone = keyed[0], None
    first = profiles
    while True:
        meeting = _blocks(profiles, blocks, tile).repartition("block").sortWithinPartitions("block", "pid")
        edges, found = counted(meeting.mapInPandas(_match, "a bigint, b bigint"), "matches")
        if not found:
            break
        roots = materialize(_closed(edges, found), "roots")
        gone = roots if gone is None else gone.unionByName(roots)
        before = profiles
        profiles = materialize(_united(profiles.join(roots, "pid", "left").withColumn("to", F.coalesce("root", "pid")), "to"), "profiles")
        if before is not first:
            discard(before)
        heads = roots.select(F.col("root").alias("pid")).distinct()
        fresh = materialize(profiles.join(heads, "pid", "left_semi").mapInPandas(_keyed, "pid bigint, key string"), "fresh")
        old = [k.join(roots.select("pid"), "pid", "left_anti") for k in keyed]
        touched = fresh.select("key").distinct()
        blocks = fresh
        for k in old:
            blocks = blocks.unionByName(k.join(touched, "key", "left_semi"))
        keyed = [*old, fresh]
    if gone is None:
        return profiles, profiles.select("pid", F.col("pid").alias("root")).limit(0)
    total = gone.count()
    return profiles, materialize(_closed(gone.select(F.col("pid").alias("a"), F.col("root").alias("b")), total), "everyone")


def _given_words(spellings: DataFrame) -> tuple[DataFrame, int]:
    """Words that stand where only a given name stands, behind a comma or before a middle initial, with several families."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name in f["name"]:
                n = clean(name)
                if is_group(n):
                    continue
                m = re.fullmatch(r"([^\W\d_]{2,}(?:-[^\W\d_]+)?) [^\W\d_]\. (.+)", n) or re.fullmatch(r"()([^,]+), ([^\W\d_]{3,}(?:-[^\W\d_]+)?)(?: [^\W\d_]\.?)*", n)
                if m:
                    g = m[1] or m[3]
                    if not (_initials(g) and len(g) < 3):
                        out.append((plain(g), plain(m[2])))
            yield pd.DataFrame(out, columns=["g", "f"])

    seen = spellings.where("kind = 'author'").select("name").mapInPandas(run, "g string, f string").distinct()
    return counted(seen.groupBy("g").agg(F.count("*").alias("n")).where("n >= 3").select("g"), "given")


def _with_known(names: DataFrame, given: DataFrame) -> DataFrame:
    """The names with ``known`` and ``near``: those of their words that are given names, or within one slip of one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, w, s) for i, n in zip(f["nid"], f["name"]) for w in asked_words(n) for s in shorter(w)]
            yield pd.DataFrame(out, columns=["nid", "w", "form"])

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(g, s) for g in f["g"] for s in (shorter(g) if len(g) > 3 else {g})], columns=["g", "form"])

    asked = names.where("kind = 'author'").mapInPandas(run, "nid bigint, w string, form string")
    hit = asked.join(given.mapInPandas(forms, "g string, form string"), "form")
    hit = hit.groupBy("nid").agg(F.collect_set(F.when(F.col("w") == F.col("g"), F.col("w"))).alias("known"), F.collect_set(F.when(F.length("g") > 3, F.col("w"))).alias("near"))
    return names.join(hit, "nid", "left")


def _aliases(people: DataFrame) -> DataFrame:
    """``(given, stands_for)``: short or slipped given names and the given name they stand for, learned from shared family names."""
    seen = people.where("given <> ''").select("family", "given").distinct()
    total = seen.groupBy("given").agg(F.count("*").alias("families"))
    seen = seen.join(seen.groupBy("family").agg(F.count("*").alias("givens")), "family").join(total, "given")
    seen = materialize(seen, "given")
    # enough shared family names leave none of these out: so many of the smallest ones that the others are too few
    least = F.greatest(F.lit(3), F.ceil(0.55 * F.col("families") - 1e-9))
    at = F.row_number().over(Window.partitionBy("given").orderBy("givens", "family"))
    some = seen.where("families >= 3").withColumn("at", at).where(F.col("at") <= F.col("families") - least + 1)
    full = seen.select("family", F.col("given").alias("full"), F.col("families").alias("of_full"))
    met = some.join(full, "family").where("of_full > 2 * families").select("given", "full").distinct()
    both = met.join(seen, "given").join(full.select("family", "full"), ["family", "full"]).groupBy("given", "full").agg(
        F.count("*").alias("shared"), F.count_if(F.col("givens") > 8).alias("common"), F.first("families").alias("families")
    )
    others = F.max("common").over(Window.partitionBy("given").orderBy(F.desc("shared"), "full").rowsBetween(1, Window.unboundedFollowing))
    first = F.row_number().over(Window.partitionBy("given").orderBy(F.desc("shared"), "full"))
    scored = both.withColumn("others", F.coalesce(others, F.lit(0))).withColumn("first", first).where((F.col("first") == 1) & (F.col("shared") >= least))
    return scored.where("shared >= 2 * others").select("given", F.col("full").alias("stands_for"))


def _stands_for(learned: DataFrame, table: dict[str, str], in_one: int = 100_000) -> DataFrame:
    """``(given, stands_for)`` with chains followed to their end; what is learned goes before the table.

    Up to ``in_one`` learned names are followed on the driver, more by joins; the result is the same.
    """
    spark = learned.sparkSession
    schema = "given string, stands_for string"
    learned, n = counted(learned, "aliases")
    if n <= in_one:
        alias = {**table, **{r["given"]: r["stands_for"] for r in learned.collect()}}
        for _ in range(len(alias)):
            step = {k: alias.get(v, v) for k, v in alias.items()}
            if step == alias or any(k == v for k, v in step.items()):
                break
            alias = step
        return spark.createDataFrame(sorted(alias.items()), schema)
    fixed = spark.createDataFrame(sorted(table.items()), schema)
    alias = materialize(learned.unionByName(fixed.join(learned, "given", "left_anti")), "aliases")
    while True:
        to = alias.select(F.col("given").alias("stands_for"), F.col("stands_for").alias("next"))
        step = materialize(alias.join(to, "stands_for", "left").select("given", F.coalesce("next", "stands_for").alias("stands_for"), F.col("next").isNotNull().alias("moved")), "aliases")
        if not step.where("moved").limit(1).count() or step.where("given = stands_for").limit(1).count():
            return alias
        alias = step.drop("moved")


def _parsed(sent):
    """Every name as the persons or titles it may be; ``sent`` is a broadcast ``Known``, or None where each row brings its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            own = zip(f["known"], f["near"]) if sent is None else repeat((None, None))
            for nid, kind, name, (known, near) in zip(f["nid"], f["kind"], f["name"], own):
                person = None
                if kind == "author" and not is_group(clean(name)):
                    person = parse_person(name, sent.value if sent else Known(() if known is None else known, () if near is None else near))
                if person:
                    out.append((nid, "person", *person, None, False))
                else:
                    words, cut = title_words(name)
                    if words:
                        out.append((nid, kind, "", "", "", "", words, cut))
                    if (other := turned(name)) and (words := title_words(other)[0]):
                        out.append((nid, kind, "", "", "", "", words, False))
            yield pd.DataFrame(out, columns=["nid", "kind", "family", "given", "initial", "middle", "words", "cut"])

    return run


PARSED = "nid bigint, kind string, family string, given string, initial string, middle string, words array<string>, cut boolean"


def _profile_rows(parsed: DataFrame, alias: DataFrame) -> DataFrame:
    """One row per parsed name that can found a profile, with the profile's id and the counts of its words over all names."""
    rows = parsed.where("(kind = 'person' and given <> '') or (kind <> 'person' and not cut)").join(alias, "given", "left")
    formal = F.coalesce("stands_for", "given")
    person = F.col("kind") == "person"
    rows = rows.select(
        "nid", "kind", F.when(person, F.xxhash64("kind", "family", formal)).otherwise(F.xxhash64("kind", "words")).alias("pid"),
        F.when(person, F.array(F.array("family"), F.array_distinct(F.array("given", formal)))).otherwise(F.transform("words", lambda w: F.array(w))).alias("slots"),
        F.when(person, F.filter(F.split(F.regexp_replace("middle", r"\+", ",+"), ","), lambda m: m != "")).otherwise(F.array().cast("array<string>")).alias("middles"),
        F.when(person, F.array("family", "given")).otherwise(F.array_distinct("words")).alias("own"),
    )
    rows = materialize(rows, "rows")
    counts = rows.select("nid", F.explode("own").alias("w")).unionByName(
        parsed.where("(kind = 'person' and given = '') or (kind <> 'person' and cut)").select("nid", F.explode(F.when(F.col("kind") == "person", F.array("family")).otherwise(F.array_distinct("words"))).alias("w"))
    ).groupBy("w").agg(F.count("*").alias("n"))
    words = rows.select("pid", F.explode(F.flatten("slots")).alias("w")).distinct().join(counts, "w")
    freq = words.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("freq"))
    return materialize(rows.drop("own").join(freq, "pid"), "rows")


def members(spellings: DataFrame, in_one: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(nid, kind, name)`` of all spellings, and ``(nid, root)``: the persons, groups and journals each one may name."""
    spark = spellings.sparkSession
    names = spellings.where("name is not null and trim(name) <> ''").select("kind", "name").distinct()
    names = materialize(names.withColumn("nid", F.xxhash64("kind", "name")), "names")
    given, n = _given_words(names)
    listed = sorted({*NICKNAMES, *FORMAL})
    if n <= in_one:  # given names of at most so many words are sent to all tasks; of more, each name gets its own by a join
        read = names.mapInPandas(_parsed(spark.sparkContext.broadcast(Known([*listed, *(r["g"] for r in given.collect())]))), PARSED)
    else:
        all_given = given.unionByName(spark.createDataFrame([(g,) for g in listed], "g string")).distinct()
        read = _with_known(names, all_given).mapInPandas(_parsed(None), PARSED)
    parsed = materialize(read, "parsed")
    people = parsed.where("kind = 'person'")
    alias = _stands_for(_aliases(people), FORMAL, in_one)
    rows = _profile_rows(parsed, alias)
    start = materialize(_united(rows, "pid"), "profiles")
    final, roots = _resolve(start)

    placed = rows.select("nid", "pid").join(roots, "pid", "left").select("nid", F.coalesce("root", "pid").alias("root")).distinct()
    placed = materialize(placed, "placed")
    # names in two parts stand under both orders, so under two groups at most; their groups are one
    ends = placed.groupBy("nid").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    ends, found = counted(ends.select("a", "b").distinct(), "ends")
    cut = materialize(_attach_cut(parsed.where("kind <> 'person' and cut"), final), "cut")
    titles = placed.unionByName(cut)
    if found:
        one = materialize(_closed(ends, found).select(F.col("pid").alias("root"), F.col("root").alias("component")), "turned")
        titles = titles.join(one, "root", "left").select("nid", F.coalesce("component", "root").alias("root"))
    initials = materialize(_attach(people.where("given = ''"), final), "initials")
    return names, materialize(titles.unionByName(initials).distinct(), "members")


def variant_pairs(spellings: DataFrame) -> DataFrame:
    """``(kind, name_a, name_b)`` from ``(kind, name)`` with kind 'author' or 'journal'; names in code point order."""
    names, member = members(spellings)
    left = member.select("root", F.col("nid").alias("a"))
    met = left.join(member.select("root", F.col("nid").alias("b")), "root").where("a < b").select("a", "b").distinct()
    x = names.select(F.col("nid").alias("a"), "kind", F.col("name").alias("x"))
    y = names.select(F.col("nid").alias("b"), F.col("name").alias("y"))
    both = met.join(x, "a").join(y, "b")
    return both.select("kind", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def classes(spellings: DataFrame) -> DataFrame:
    """``(kind, name, entity, spellings)``: every spelling under each person, group or journal it may name, with their number of spellings."""
    names, member = members(spellings)
    sizes = member.groupBy("root").agg(F.count("*").alias("spellings"))
    return member.join(sizes, "root").join(names, "nid").select("kind", "name", F.col("root").alias("entity"), "spellings")


def _attach(initials: DataFrame, final: DataFrame) -> DataFrame:
    """``(nid, root)``: spellings with initials only, at every person they fit; else among themselves."""
    persons = final.where("kind = 'person'").select(F.col("pid").alias("root"), F.col("slots")[0].alias("families"), F.col("slots")[1].alias("givens"), "middles")
    open_ = persons.select("root", "middles", F.explode("families").alias("family"), "givens").select("root", "middles", "family", F.explode(F.array_distinct(F.transform("givens", lambda g: F.substring(g, 1, 1)))).alias("initial"))
    mine = initials.select("nid", "family", "initial", "middle")
    exact = mine.join(open_, ["family", "initial"]).select("nid", "root", "middle", "middles")
    slips = lambda c: F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    rest = mine.join(exact.select("nid").distinct(), "nid", "left_anti").where(F.length("family") > 4)
    near = (
        rest.withColumn("s", F.explode(slips(F.col("family")))).join(open_.select("root", "middles", "initial", F.col("family").alias("other"), F.explode(slips(F.col("family"))).alias("s")), ["initial", "s"])
        .where((F.levenshtein("family", "other") <= 2) & (F.abs(F.length("family") - F.length("other")) <= 1) & ((F.levenshtein("family", "other") <= 1) | (F.array_sort(F.split("family", "")) == F.array_sort(F.split("other", "")))))
        .select("nid", "root", "middle", "middles").distinct()
    )
    fit = exact.unionByName(near)
    plain_middles = F.filter("middles", lambda m: ~m.startswith("+"))
    same = F.array_contains("middles", F.col("middle")) | F.array_contains("middles", F.concat(F.lit("+"), F.col("middle")))
    rank = F.when(F.col("middle") == "", 0).when(same, 0).when(F.size(plain_middles) == 0, 1)
    fit = fit.withColumn("rank", rank).where("rank is not null")
    best = fit.groupBy("nid").agg(F.min("rank").alias("best"))
    placed = fit.join(best, "nid").where("rank = best").select("nid", "root").distinct()
    # without a person: one group per family and initials, those without a middle initial join every such group
    alone = mine.join(placed.select("nid").distinct(), "nid", "left_anti")
    heads = alone.where("middle <> ''").select("family", "initial", F.col("middle").alias("m")).distinct()
    grouped = alone.join(heads, ["family", "initial"], "left").where((F.col("middle") == "") | (F.col("middle") == F.col("m")))
    lone = grouped.select("nid", F.xxhash64("family", "initial", F.coalesce("m", F.lit(""))).alias("root"))
    return placed.unionByName(lone)


def _attach_cut(cut: DataFrame, final: DataFrame) -> DataFrame:
    """``(nid, root)``: titles whose end is cut off, at every title that begins so; else with those cut off alike."""
    first = lambda words: F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    mine = cut.where(F.size("words") > 1).select("nid", "kind", "words", first(F.col("words")).alias("key"))
    whole = final.where("kind <> 'person' and size(slots) > 1").select("kind", F.col("pid").alias("root"), "slots", first(F.transform("slots", lambda s: s[0])).alias("letters"))
    whole = whole.select("kind", "root", "slots", F.explode(F.transform(F.sequence(F.lit(2), F.size("slots")), lambda i: F.substring("letters", F.lit(1), i))).alias("key"))
    k = F.size("words")
    fits = lambda i: F.when(i < k, F.array_contains(F.element_at("slots", i), F.element_at("words", i))).otherwise(F.exists(F.element_at("slots", i), lambda y: y.startswith(F.element_at("words", i))))
    placed = mine.join(whole, ["kind", "key"]).where(F.forall(F.sequence(F.lit(1), k), fits)).select("nid", "root").distinct()
    alone = cut.join(placed.select("nid").distinct(), "nid", "left_anti")
    return placed.unionByName(alone.select("nid", F.xxhash64("kind", "words", F.lit("cut")).alias("root")))
