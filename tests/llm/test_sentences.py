import itertools
import random

import pytest

from papyrine.llm.sentences import Splitter, sentence_ends

S = Splitter(frozenset({"univ"}), frozenset())


def cut(text):
    at, out = 0, []
    for e in S.ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Lee saw Fig. 3. It ended at 4 p.m. Then we left.", ["Dr. Lee saw Fig. 3.", "It ended at 4 p.m.", "Then we left."]),
        ("Values, e.g. 3.5 and p = .04, fell. E. coli grew.", ["Values, e.g. 3.5 and p = .04, fell.", "E. coli grew."]),
        ("The dose was 10.5 mg... then 6 mg. “Was it late?” asked one.", ["The dose was 10.5 mg... then 6 mg.", "“Was it late?” asked one."]),
        ("The label read “Keep cool.” “We stopped,” they said.", ["The label read “Keep cool.”", "“We stopped,” they said."]),
        ("It matched.[9,937] We agree [5]. End", ["It matched.[9,937]", "We agree [5].", "End"]),
        ("They came home.The rest stayed in the U.K. and left.", ["They came home.", "The rest stayed in the U.K. and left."]),
        ("Background\nIt was\nlate. 2.1 Study", ["Background", "It was\nlate.", "2.1 Study"]),
        ("Am 3. 8. 2021 wurden u. a. Dosen erfasst. Der 2. Versuch ergab z. B. Zellen.", ["Am 3. 8. 2021 wurden u. a. Dosen erfasst.", "Der 2. Versuch ergab z. B. Zellen."]),
        ("La notice précise : « Garder au frais. » Quel écart ! Fin", ["La notice précise : « Garder au frais. »", "Quel écart !", "Fin"]),
        ("En EE. UU. se usó (v. pág. 661, núm. 9). ¿Son raras? Sí.", ["En EE. UU. se usó (v. pág. 661, núm. 9).", "¿Son raras?", "Sí."]),
        ("В 2014 г. им. Lee центр собрал 300 тыс. образцов. Итог!", ["В 2014 г. им. Lee центр собрал 300 тыс. образцов.", "Итог!"]),
        ("“为什么？”北京的医生问道。他写道：“没有。”结果1.5倍！", ["“为什么？”北京的医生问道。", "他写道：“没有。”", "结果1.5倍！"]),
        ("「悪化したか？」と医師が尋ねた。次である。", ["「悪化したか？」と医師が尋ねた。", "次である。"]),
        ("यह अच्छा है। डॉ. Lee ने 7.1 मि.ग्रा. Zube देखा।", ["यह अच्छा है।", "डॉ. Lee ने 7.1 मि.ग्रा. Zube देखा।"]),
        ("قال الطبيب: «توقف.» هل يسبب؟ نعم.", ["قال الطبيب: «توقف.»", "هل يسبب؟", "نعم."]),
        ("เราเก็บตัวอย่าง 6 คน เพื่อศึกษา ยีน AB7 ดี", ["เราเก็บตัวอย่าง 6 คน", "เพื่อศึกษา", "ยีน AB7 ดี"]),
        ("บทนำ\nเราเก็บตัวอย่าง\nผู้วิจัยพบยา\nAbc มาก", ["บทนำ", "เราเก็บตัวอย่าง", "ผู้วิจัยพบยา\nAbc มาก"]),
        ("The patient said no. Then she left the clinic.", ["The patient said no.", "Then she left the clinic."]),
        ("He likes modern art. The art is in the museum.", ["He likes modern art.", "The art is in the museum."]),
        ("See No. 4 and Fig. A for vitamin A. It is shown in vitamin A only.", ["See No. 4 and Fig. A for vitamin A.", "It is shown in vitamin A only."]),
        ("Dr Lee met Dr. Roe of art. Then Vol. XII came.", ["Dr Lee met Dr. Roe of art. Then Vol. XII came."]),
        ("Univ. hospital data from Univ. Lee centre.", ["Univ. hospital data from Univ. Lee centre."]),
    ],
)
def test_cases(text, want):
    assert cut(text) == want


def test_positions_and_odd_texts(spark):
    rows = [(1, "Go. C\U0001f600d. ", "x"), (2, "", None), (3, " \n", None), (4, None, None), (None, "A.", None), (5, "no end", None), (6, "...", None), (7, "Go on. " * 20000, None), (1, "Go. C\U0001f600d. ", "x")]
    df = spark.createDataFrame(rows, "section_id long, content string, kind string")
    got = {}
    for r in sentence_ends([("section", df, "section_id", "content")]).collect():
        got.setdefault(r["id"], []).append(r["end_pos"])
    assert sorted(set(got[1])) == [3, 8] and len(got[1]) == 4 and got[5] == [6] and got[6] == [3] and len(got[7]) == 20000
    assert set(got) == {1, 5, 6, 7}
    assert sentence_ends([("s", df.limit(0), "section_id", "content")]).count() == 0


def units(frame, **kw):
    got = {}
    for r in sentence_ends([("s", frame, "id", "text")], **kw).collect():
        got.setdefault(r["id"], []).append(r["end_pos"])
    return {k: sorted(v) for k, v in got.items()}


def test_lexicon_of_more_entries_than_are_sent(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(w) for w in itertools.islice(itertools.product("wxyz", letters, letters, letters), 60_000)]
    taught = [(-i, " ".join(f"{w}. and" for w in words[i : i + 200] for _ in range(5))) for i in range(0, len(words), 200)]
    taught += [(-1 - i, "Yzza zyzzy:\nIt was") for i in range(5)]
    asking = [(1 + i, f"We saw Lee at {w}. Lee left.") for i, w in enumerate([words[0], words[30_000], words[-1], "zzzzzz"])]
    asking += [(5, "Yzza zyzzy\nIt was late."), (6, "It went. Yzza zyzzy\nIt was late."), (6, "It went. Yzza zyzzy\nIt was late."), (7, "Yzzb zyzzy\nIt was late.")]
    got = {k: v for k, v in units(spark.createDataFrame(taught + asking, "id long, text string")).items() if k > 0}
    assert got == {1: [29], 2: [29], 3: [29], 4: [21, 31], 5: [10, 23], 6: [8, 8, 19, 19, 32, 32], 7: [23]}


def test_same_units_however_few_entries_are_sent(spark):
    rows = [(1 + i, "See qab. and wab. and Next\nIt was.") for i in range(5)]
    rows += [(10 + i, t) for i, t in enumerate(["We saw Lee at qab. Lee at Wab. Lee left.", "End.Next\nGo on.", "No blank.qab. Lee saw Lee.", None, " "])] * 2
    df = spark.createDataFrame(rows, "id long, text string")
    want = units(df)
    assert want[10] == [40, 40]
    for most in (0, 1, 2):
        assert units(df, most=most) == want


def test_words_without_period_count_in_every_task(spark):
    rows = [(i, "See qab. and go") for i in range(5)] + [(5, "Here qab is " * 9 + "it, etc. and on")] * 4 + [(6, "We saw Lee at qab. Lee left.")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "id long, text string")
    assert units(df)[6] == units(df.coalesce(1))[6] == [18, 28]


def test_asked_names_all_that_is_looked_up():
    class Every(set):
        def __contains__(self, entry):
            looked.add(entry)
            return draw.random() < 0.5

    draw = random.Random(4)
    bits = ["Qab", "wx", "q.w", "U", "İx", "ΑΣ", "12", "3.5", ".", ". ", ".\n", "\n", " ", "!", "? ", "…", "...", "”", "“", "’", "»", " »", "« ", "[3]", "²", "⁴,⁵", "、", "。", "中文", "ยา", "ยา ยา",
            "\u200b", ":", ": ", "\n\n", "• ", "1. ", "(ii) ", " lee", " Lee", "(", ")", "-", "/", "=", "है", "।"]
    seen = 0
    for _ in range(20_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(2, 24)))
        looked = set()
        splitter = Splitter(frozenset(), frozenset())
        asked = splitter.asked(text)
        splitter.ends(text, Every())
        can = {e for e in looked if e[0] == "w" and 1 < len(e) <= 9 and not any(c.isdecimal() or c == "_" for c in e) or e[0] == "h" and 0 < len(e[1:].split()) <= 4}
        assert can <= asked, (text, can - asked)
        seen += len(can)
    assert seen > 5_000
