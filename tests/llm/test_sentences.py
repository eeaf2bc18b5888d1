"""Sentence units on hand-made texts in many scripts."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from caselode.llm import sentences as module
from caselode.llm.sentences import best_spans, build_evidence, count_evidence, sentence_spans, sentences

CASES = [
    ["Dr. A. Kent left at 5:51 a.m. and noted it.", "No. 36 on the list matched.", "Really?!", "Wait... the log is 3.5 MB."],
    ["“It matched,” she said, “so log it.”", "Jo said: “We left. Then we rested.”", "(We checked: it shows no edits.)", "“Is it intact?” asked Teo on the phone."],
    ["She works for Halden Ltd.", "Mr. Berg agreed.", "A visitor from Norvale Inc. never came.", "The clerk left at 7:28 p.m.", "Traffic stopped on 15 Mar. 2016.", "eSATA ports were taped shut."],
    ["Z. B. fehlt die Größe von a.db völlig.", "Am 17. Okt. 2020 prüfte Fa. Berg jun. den Beutel.", "Das sind ca. 5,3 GB, d. h. 800 Sektoren.", "„Ist sie zu?“ fragte Mira leise."],
    ["« Où est la pièce no 13 ? » demanda Teo.", "C’est réglé !", "Cette pièce, p. ex. a.csv, reste intacte…", "Voir p. 37 et art. 13.95 du rapport.", "L’exécution a duré 3,2 s, etc.", "Mme Berg a écrit : « Arrêtez. »"],
    ["¿Quién abrió a.db a las 3:45?", "Véase la pág. 6 del informe.", "El 24 de oct. de 2022, la Sra. Berg salió."],
    ["«Где ключ?» — спросил дежурный.", "4 марта 2016 г. журнал открыли.", "См. рис. 58 и стр. 92 отчёта.", "И т. п. ошибок не было."],
    ["قال: «أوقف النسخ الآن.»", "هل فتح د. Berg الكيس؟", "الحجم 45.41 غيغابايت."],
    ["डॉ. Berg ने 34.15 GB की प्रति बनाई।", "उसने कहा, “अभी रुको।”", "Notes.pdf किसने खोली?"],
    ["그는 “복사를 멈추세요.”라고 말했습니다.", "2020. 7. 23. 에 로그 이상이 없습니다.", "잠깐만요... 디스크가 없습니다!"],
]
TIGHT = [
    ["他写道：“立即停止。”", "“硬盘还在吗？”她问道。", "等等……邮箱已经核对。", "（附注：没有变化。）", "共有457个碎片；其中日志缺少。"],
    ["担当者は「止めてください。」と言いました。", "「無事でした。」", "昨日、3.5GBを確認しましたか？", "まさか……端末は無事でした。"],
]


def texts(text, **k):
    return [text[a:b] for a, b in sentence_spans(text, **k)]


@pytest.mark.parametrize("want", CASES)
def test_parted_by_blanks_and_line_breaks(want):
    for gap in (" ", "\n", "\r\n", "\n\n", "  ", "\t", " "):
        assert texts(gap.join(want)) == want


@pytest.mark.parametrize("want", TIGHT)
def test_without_blanks(want):
    for gap in ("", "　", "\n", "\n\n"):
        assert texts(gap.join(want)) == want


def test_missing_blank():
    assert texts("It was taped shut.Really?! We left.Then Dr. Berg came.") == ["It was taped shut.", "Really?!", "We left.", "Then Dr. Berg came."]


def test_wrapped_lines():
    assert texts("The list holds\n5 items of Dr.\nBerg. Next\r\none.") == ["The list holds\n5 items of Dr.\nBerg.", "Next\r\none."]


def test_units_by_line():
    text = "All is well.\nFindings\n\n- copy of a.dll\n• one sealed bag\n3) No. 14, unopened\n\nDone."
    assert texts(text) == ["All is well.", "Findings", "- copy of a.dll", "• one sealed bag", "3) No. 14, unopened", "Done."]
    assert texts("[2:40] ann: ok will do\n[12:07] bob: Wait. No!\n") == ["[2:40] ann: ok will do", "[12:07] bob: Wait.", "No!"]
    log = "2019-01-18 2:31 ERROR timed out. See a.txt\n2019-01-18 2:32 INFO ok"
    assert texts(log) == log.split("\n") == texts(log, line_units=True)


def test_thai():
    assert texts("ใครเปิดไฟล์ a.db เมื่อวานนี้ ทีมงานส่งคืน 12 รายการ\nขนาดใหญ่") == ["ใครเปิดไฟล์ a.db เมื่อวานนี้", "ทีมงานส่งคืน 12 รายการ", "ขนาดใหญ่"]


@given(st.text(alphabet="aB.!? \n“”\"'()…。」「»«-1", max_size=80))
def test_spans_are_ordered_and_trimmed(text):
    spans, end = sentence_spans(text), 0
    for a, b in spans:
        assert end <= a < b and text[a:b] == text[a:b].strip()
        end = b
    assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x", 5), (1, "One. Two.", "x", 5), (2, None, "x", 5), (3, "", None, 5), (4, "A. b\nC. d", "tool_logs", 5), (None, "Hi there.", None, 5), (6, "Yes. " * 50_000, "x", 5)], "doc_id bigint, text string, source string, start_pos int")
    got = sentences(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 4, 4: 2, None: 1, 6: 50_000}
    assert sentences(df.limit(0)).columns == ["doc_id", "start_pos", "end_pos"]


#: Invented paragraphs: names, an abbreviation on no list, and sentences known by construction.
def corpus(n, seed=3):
    rng = random.Random(seed)
    names, verbs, things = ["Arno", "Bela", "Cleo", "Dora", "Egon"], ["moved", "sealed", "copied"], ["the box", "a disk", "the old file", "two bags"]
    sentence = lambda: rng.choice([
        f"{rng.choice(names)} {rng.choice(verbs)} {rng.choice(things)}.",
        f"Then Hptm. {rng.choice(names)} {rng.choice(verbs)} {rng.choice(things)}.",
        f"Hptm. {rng.choice(names)} met Hptm. {rng.choice(names)} near {rng.choice(things)}.",
        f"It weighs {rng.randint(2, 9)} Zent. {rng.randint(2, 9)} or less.",
        f"They {rng.choice(verbs)} {rng.choice(things)} for {rng.choice(names)}.",
    ])
    return [[sentence() for _ in range(rng.randint(1, 5))] for _ in range(n)]


def evidence_of(paragraphs):
    return build_evidence(np.array([(*k, n) for k, n in count_evidence([" ".join(p) for p in paragraphs]).items()]))


def right(paragraphs, evidence=module._LISTS):
    found = [[t[a:b] for a, b in sentence_spans(t, evidence=evidence)] for t in map(" ".join, paragraphs)]
    return sum(a == b for a, b in zip(found, paragraphs, strict=True)) / len(paragraphs)


def test_abbreviations_are_learned():
    evidence = evidence_of(corpus(600))
    assert right(corpus(200, 4), evidence) > 0.98  # other paragraphs
    assert right(corpus(200, 4)) < 0.4


def test_whole_spans_decide(monkeypatch):
    """Cutting at every boundary of positive score, without the program, is worse where little was counted."""
    learned = [evidence_of(corpus(10, seed)) for seed in range(3, 11)]
    held_out = corpus(100, 40)
    whole = [right(held_out, e) for e in learned]

    def local(text, begin, at, own, cost):
        for k, e in enumerate(at):
            if own[k] >= 0 or k == len(at) - 1:
                yield begin, e
                begin = e

    monkeypatch.setattr(module, "best_spans", local)
    assert sum(whole) > sum(right(held_out, e) for e in learned)


@given(st.lists(st.tuples(st.integers(1, 30), st.floats(-6, 6)), min_size=1, max_size=9), st.integers(0, 1))
def test_program_is_best(pieces, marks):
    text, at, own = "", [], []
    for n, s in pieces:
        text += ('"' if marks and n % 3 == 0 else "") + "a" * n
        at.append(len(text))
        own.append(s)
    own[-1] = 0.0
    cost = [min(0.0, -3 + 0.5 * i) for i in range(module.SLOTS)]

    def score(cuts):
        begin, out = 0, 0.0
        for k in cuts:
            piece = text[begin : at[k]]
            out += cost[module._slot(len(piece))] + own[k] + (module.ODD if piece.count('"') % 2 else 0)
            begin = at[k]
        return out

    n = len(at)
    best = max(score([*c, n - 1]) for r in range(n) for c in combinations(range(n - 1), r))
    got = [at.index(b) for _, b in best_spans(text, 0, at, own, cost)]
    assert score(got) == pytest.approx(best)
