"""Sentence units by semi-Markov dynamic programming (problem 8).

A text is cut into blocks at blank lines and around lines that are units by themselves. In a block
every terminator and Thai space is a candidate boundary. Dynamic programming then chooses whole
spans between candidates. What a span scores is learned from all texts, counted first:

* its length: how rare so short or so long a sentence is in its script, after blocks of one sentence,
* its closing word: from how often texts and paragraphs end with the word and its full stop, the
  number of true ends is estimated; full stops beyond that are those of an abbreviation,
* its opening word: how often the word stands at sure beginnings and within sentences,
* its quotations and brackets: a span must not begin or end inside a matched pair, and straight
  quotation marks must be even in number; a span without a letter or digit is none.

Lists of abbreviations serve as a start only, as if seen a few times. The counts are hashed to a fixed
number of buckets, so what reaches the driver and the tasks is bounded. Afterwards each text is
handled alone.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.session import spread

#: Abbreviations that do not end a sentence before a word (titles, Latin and other phrases).
TITLES = frozenset(
    "dr prof mr mrs ms lt sgt capt col gen rev hon st messrs mme mlle me m sr sra srta dra d dña herr fr fa hr jun u.s u.k e.u "
    "i.e e.g cf vs incl approx viz al resp ca bzw ggf evtl inkl z.b d.h u.a o.ä z.t usw.a p.ex c.-à-d env p.ej aprox núm "
    "проф г гг г-н г-жа д-р им ул рис стр см т.е т.п т.д т.к тов акад др डॉ श्री د أ ver abb nr anm art tel".split()
)
#: Abbreviations that do not end a sentence before a number.
BEFORE_NUMBER = frozenset(
    "no nos nr n p pp fig figs sec sect ch vol art par pág pag págs núm n.º num approx ca env aprox tel ver abb anl vs cf ca min max "
    "jan feb mar apr jun jul aug sep sept oct nov dec okt dez mär рис стр п гл ст см с ext rm bl".split()
)
#: Abbreviations before a lower-case word only; before a capital they end the sentence.
MAY_END = frozenset("ltd inc co bros corp llc jr etc a.m p.m usw cie plc".split())
#: German month names, which follow an ordinal with a full stop.
MONTHS = re.compile(r"(?:Jan(?:uar)?|Feb(?:ruar)?|März?|Apr(?:il)?|Mai|Juni?|Juli?|Aug(?:ust)?|Sept?(?:ember)?|Okt(?:ober)?|Nov(?:ember)?|Dez(?:ember)?)\b")

_OPEN = "“„«‘(（「『[【《〈"
_CLOSE = "”“»’)）」』]】》〉"
_PAIR = {"”": "“", "»": "«", ")": "(", "）": "（", "」": "「", "』": "『", "]": "[", "】": "【", "》": "《", "〉": "〈"}
_END = "。！？!?؟।．｡॥"
#: A run of terminators with the closing marks after it.
_CANDIDATE = re.compile(r"(?P<t>(?:\.{2,}|…+|[.。！？!?؟।．｡॥])(?:[.。！？!?؟।．｡॥…])*)(?P<c>(?:[”“»’)）」』\]】》〉\"]|[   ]»)*)")
_BREAK = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
_CHAT = re.compile(r"\[\d{1,2}:\d{2}(?::\d{2})?\] ?[^\s:]+:")
_ITEM = re.compile(r"[ \t　]*(?:[-*•‣◦▪·]|\d{1,3}\)|\([a-z0-9]{1,2}\))[ \t 　]")
_LOG = re.compile(r"[ \t]*\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}(?::\d{2}\S*)? +\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b")
_WORD_BEFORE = re.compile(r"[^\s(（“”„«»\"'‘¿¡\[—–/]+$")
_THAI = re.compile(r"[฀-๿]")
_SPACES = re.compile(r"[^\S\r\n  \x0b\x0c\x85]+|\s+")
_SAID_ZH = re.compile(r"[^。！？：“”\s]{0,12}(?:问道|说道|答道|写道|喊道|叫道|回答|说|问|喊)[。，！？]")
_SAID_JA = re.compile(r"(?:と|って)")

_ALNUM = re.compile(r"[^\W_]")
INSIDE = -9.0  # beginning or ending inside a quotation or bracket
ODD = -4.0  # an odd number of straight quotation marks
EMPTY = -9.0  # no letter or digit
#: Weight of the length, and the most that an unusual length costs.
LENGTH = 0.6
LONGEST_COST = -6.0
#: Counters of words, whatever the number of texts; each script has a part of them.
PART = 1 << 15
BUCKETS = 8 * PART
#: Ends added to those counted, so that few full stops without an end make no abbreviation yet.
DOUBT = 0.5
#: What a full stop, another terminator and one of a script of its own say by themselves, and a missing blank behind it.
STOP, MARK, SURE_MARK, GAPLESS = 0.5, 4.0, 7.0, -3.0

#: A word with its full stop; tried at the beginnings of words only, so that a text takes linear time.
_DOTTED = re.compile(r"(?<![^\s(（“”„«»\"'‘¿¡\[—–/])([^\s(（“”„«»\"'‘¿¡\[—–/]++)(?<=[^.]\.)(?=(\s+|$)(\S{0,12}))")
_STARTS = re.compile(r"(?:\A|[?!][”\"»)]?\s+)([^\W\d_]{1,24}[’':.]?|[“„«¿¡(])")
_WITHIN = re.compile(r"[^\W\d_],?[ \n]([^\W\d_]{1,24}[’':.]?|[“„«¿¡(])")
_BLOCKS = re.compile(r"\n[ \t\r]*\n\s*")
_TERMINATORS = re.compile(r"[.。！？!?؟।．…]+")
_SCRIPT = re.compile(r"(?P<thai>[\u0e00-\u0e7f])|(?P<east>[\u3040-\u30ff\u3400-\u9fff])|(?P<hangul>[\uac00-\ud7af])|(?P<deva>[\u0900-\u097f])|(?P<arab>[\u0600-\u06ff])|(?P<cyr>[\u0400-\u04ff])|(?P<latin>[A-Za-z\u00c0-\u024f])")
SCRIPTS = ("thai", "east", "hangul", "deva", "arab", "cyr", "latin")
#: Lengths are told apart by half powers of two.
SLOTS = 40


def _bucket(word: str, script: int) -> int:
    return script * PART + zlib.crc32(word.encode("utf-8", "surrogatepass")) % PART


_DIGIT = re.compile(r"\d")


def _masked(word: str) -> str:
    """The closing word in lower case, digits alike."""
    return word.lower() if word.isalpha() else _DIGIT.sub("0", word.lower())


def _slot(length: int) -> int:
    return min(SLOTS - 1, int(2 * log(max(length, 1), 2)))


_OTHER = re.compile(r"[\u0400-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _script(text: str) -> int:
    """The script of a stretch: the first other than Latin if a tenth of the characters are of such."""
    if text.isascii() or 10 * len(_OTHER.findall(text)) < len(text):
        return SCRIPTS.index("latin")
    return SCRIPTS.index(_SCRIPT.search(_OTHER.search(text)[0]).lastgroup)


#: What is counted of words: a full stop at a sure end, before a lower-case letter, a digit, another sign; at a sure beginning; within.
END, LOWER, DIGIT, UPPER, START, WITHIN = range(6)


def count_evidence(texts: list[str]) -> Counter:
    """(kind, bucket) -> blocks that show it; kind 6 and 7 count beginnings and words within by letter case, kind 8 lengths by script."""
    closing, starts, within, out = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        for block in _BLOCKS.split(text):
            block = block.strip()
            if not block:
                continue
            script = _script(block)
            # once for each block, so that one that repeats itself has no more say than others
            for word, _, after in set(_DOTTED.findall(block)):
                if not (word[:-1].isdigit() and MONTHS.match(after)):  # an ordinal says nothing of other numbers
                    closing[END if not after else DIGIT if after[0].isdigit() else LOWER if after[0].islower() or after[0] in ",;:" else UPPER, word[:-1], script] += 1
            starts.update({(word, script) for word in _STARTS.findall(block)})
            within.update({(word, script) for word in _WITHIN.findall(block)})
            ends = _TERMINATORS.search(block)
            if ends and ends.end() >= len(block) - 1:
                out[8, script * SLOTS + _slot(len(block))] += 1
    for (kind, word, script), n in closing.items():
        out[kind, _bucket(_masked(word), script)] += n
    for kind, words in ((START, starts), (WITHIN, within)):
        for (word, script), n in words.items():
            out[kind, _bucket(word, script)] += n
            out[kind + 2, int(word[0].islower())] += n
    return out


@dataclass
class Evidence:
    """Counts by kind and bucket, made into scores. Without counts the lists alone speak."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((6, 0), np.float32))
    cases: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS), SLOTS)))

    def __post_init__(self) -> None:
        #: By script, the share of the true ends that stand at a sure end.
        self.sure = [0.5] * len(SCRIPTS)
        if self.counts.shape[1]:
            for i in range(len(SCRIPTS)):
                end, other = self.counts[END, i * PART : (i + 1) * PART], self.counts[UPPER, i * PART : (i + 1) * PART] + self.counts[DIGIT, i * PART : (i + 1) * PART]
                common = end > 0.05 * (end + other)
                self.sure[i] = float((end[common].sum() + 1) / (end[common].sum() + other[common].sum() + 2))
        upper_start, lower_start = self.cases[0] + (3, 0.05)
        upper_within, lower_within = self.cases[1] + (1, 3)
        self.rare = float(upper_start + 1) / float(upper_within + 1)  # beginnings over words within, of those with a capital
        self.small = min(-2.0, log(lower_start / (upper_start + lower_start)) - log(lower_within / (upper_within + lower_within)))
        self.closings: dict[tuple[str, int, int], float] = {}
        self.openings: dict[tuple[str, int], float] = {}
        smooth = self.lengths + 0.25 * (np.roll(self.lengths, 1, 1) + np.roll(self.lengths, -1, 1)) + 0.5
        self.costs = [self._costs(row) for row in smooth]

    def _costs(self, row: np.ndarray) -> list[float]:
        if row.sum() < 50:  # next to nothing seen: only the shortest spans are unusual
            return [min(0.0, -3.0 + 0.5 * i) * LENGTH for i in range(SLOTS)]
        shares = np.log(row / row.max())
        at = int(np.argmax(row))
        # a rare length between common ones is no fault
        fall = np.concatenate([np.maximum.accumulate(shares[: at + 1]), np.maximum.accumulate(shares[at:][::-1])[::-1][1:]])
        return (LENGTH * np.maximum(fall, LONGEST_COST)).tolist()

    def closing(self, word: str, kind: int, script: int) -> float:
        """How much the full stop after the word, before a digit or another sign, is an end and not that of an abbreviation."""
        key = (word, kind, script)
        if key not in self.closings:
            if len(self.closings) > 50_000:
                self.closings.clear()
            end, lower, digit, upper = self.counts[:4, _bucket(word, script)].tolist() if self.counts.shape[1] else (0.0,) * 4
            ends, other = _start(word, kind)
            seen = upper + digit
            sure = self.sure[script]
            true = min(1.0, ((end + DOUBT) / sure - end) / seen) if seen else 1.0  # share of ends among the full stops within texts
            n = digit if kind == DIGIT else upper
            # before small letters a full stop is hardly ever an end: it speaks for an abbreviation
            self.closings[key] = max(-8.0, min(6.0, log((true * n + ends) / ((1 - true) * n + other + (0.2 * lower if end < lower else 0.0)))))
        return self.closings[key]

    def opening(self, word: str, script: int) -> float:
        """How much the word, apart from its case, begins sentences."""
        key = (word, script)
        if key not in self.openings:
            if len(self.openings) > 50_000:
                self.openings.clear()
            start, within = self.counts[START : WITHIN + 1, _bucket(word, script)].tolist() if self.counts.shape[1] else (0.0, 0.0)
            self.openings[key] = max(-4.0, min(4.0, log((start + 1) / (within * self.rare + 1))))
        return self.openings[key]


def _start(word: str, kind: int) -> tuple[float, float]:
    """As if the word had been seen so often at the end of a sentence, and not at its end."""
    plain = word.isalpha() and len(word) == 1 and not _caseless(word)
    if kind == DIGIT:
        return (0.05, 2.0) if word in BEFORE_NUMBER or word in TITLES or plain else (2.0, 0.1)
    if word in MAY_END:
        return 3.0, 0.2
    if word in TITLES or plain:
        return 0.05, 2.0
    return (0.3, 1.0) if re.fullmatch(r"(?:\w\.)+\w", word) else (4.0, 0.1)


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


def _depths(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Extents (first inner position, position of the closing mark) of matched quotations and brackets."""
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # open marks by kind, so that a mark without a partner costs nothing
    out = []
    for m in re.finditer(r"[“”„«»()（）「」『』\[\]【】《》〈〉]", text[lo:hi]):
        ch, at = m[0], lo + m.start()
        if ch == "“" and held["„"]:
            want = "„"
        elif ch in _PAIR:
            want = "„" if ch == "”" and not held["“"] and held["„"] else _PAIR[ch]
        else:
            stack.append((ch, at))
            held[ch] += 1
            continue
        while held[want]:
            mark, begin = stack.pop()
            held[mark] -= 1
            if mark == want:
                out.append((begin + 1, at))
                break
    return out


def _end(text: str, m: re.Match, lo: int) -> int:
    """Where the closing marks of candidate ``m`` end: “ closes only after „, a straight mark only if one is open."""
    at = m.end("t")
    if at == m.end():
        return at
    while at < m.end():
        ch = text[at]
        if ch == "“" and text.rfind("„", lo, at) <= text.rfind("“", lo, at) or ch == '"' and text.count('"', lo, at) % 2 == 0:
            break
        at += 1
    return at if text[at - 1] not in " \u00a0\u202f" else at - 1


def _score(text: str, m: re.Match, at: int, hi: int, lo: int, ev: Evidence, script: int) -> float:
    """Closing and opening evidence of the candidate boundary ``m`` that ends at ``at``, apart from length and balance."""
    mark, closers = m["t"], text[m.end("t") : at]
    k = at
    while k < hi and text[k].isspace():
        k += 1
    if k >= hi:
        return 9.0
    gap, nxt = text[at:k], text[k]
    word = _OPENING.match(text, k, hi)
    first = word[0] if word else ""
    camel = first[:1].islower() and _CAMEL.match(first) is not None
    lower = nxt.islower() and not camel
    upper = nxt.isupper()
    caseless = not nxt.isascii() and _caseless(nxt)
    hangul = "가" <= nxt <= "힣"
    if nxt in ",;:、，；：،" or nxt in "—–-" and _DASH.match(text, k) and not _DASH_CAPITAL.match(text, k):
        return -9.0
    if closers:
        quoted = any(c in "”“»」』\"’" for c in closers)
        if quoted and (hangul and not gap or _SAID_JA.match(text, k) and closers[-1] in "」』"):
            return -9.0
        if quoted and caseless and _SAID_ZH.match(text, k) and not text[max(lo, text.rfind("“", lo, m.start()) - 1)] == "：":
            return -9.0
        if lower:
            return -9.0
    opening = (ev.opening(first, script) if first and not caseless else 0.0) + (ev.small if lower else 0.0)
    if mark.startswith(("..", "…")) and not any(c in _END for c in mark):
        return -9.0 if (lower or caseless or camel) and not closers else SURE_MARK
    if not mark.isascii() and any(c in "。！？؟।॥｡．" for c in mark):
        return SURE_MARK
    if mark[-1] in "!?" or "?" in mark or "!" in mark:
        return MARK + (min(opening, 1.0) if lower else max(opening, -2.0)) + (0.0 if gap or upper or caseless or nxt in _OPEN + "¿¡\"" else GAPLESS if nxt.isdigit() else 3 * GAPLESS)
    # a full stop
    before = _WORD_BEFORE.search(text, max(lo, m.start() - 40), m.start()) if not closers else None
    w = before[0] if before else ""
    w = w if w.isalnum() else _GLUED.split(w)[-1]  # a missing blank before it
    low = _masked(w)
    if not gap:
        if closers:
            return MARK if upper or caseless or camel or nxt in _OPEN + "¿¡" else GAPLESS
        if not (upper or caseless or camel or nxt in _OPEN + "¿¡") or len(w) < 2 or "." in w and len(w) < 5:
            return -9.0
        if upper and (w[-1:].isupper() and not w.isdigit() and len(w) < 4):
            return -6.0
        if caseless and w[-1:].isascii() and not w[-1:].isdigit() and hangul and not re.search(r"\.[a-z0-9]{2,7}$", w):
            return -1.0
        return max(GAPLESS, 0.5 * GAPLESS + ev.closing(low, UPPER, script)) + STOP + max(opening, 0.0)
    if closers:
        return MARK + max(opening, -2.0)
    if nxt.isdigit():
        if w.isdigit() and len(w) in (1, 2, 4) and _DATED.match(text, k):  # 2020. 7. 23.
            return -9.0
        return STOP + ev.closing(low, DIGIT, script)
    if w.isdigit() and len(w) <= 2 and hangul and _KOREAN_DAY.match(text, k):
        return -9.0
    closing = ev.closing(low, UPPER, script)
    if w.isdigit() and len(w) <= 2 and MONTHS.match(text, k):
        closing = min(closing, -3.0)
    if lower:
        return STOP + min(closing, 1.0) + min(opening, -2.0)
    if nxt in "(（" and _BRACKETED.match(text, k):
        return -6.0 + min(closing, 0.0)
    return STOP + closing + opening


_OPENING = re.compile(r"[^\W\d_]{1,24}[’':.]?|[“„«¿¡(]")
_CAMEL = re.compile(r"[a-z]{1,2}[A-Z]")
_DASH = re.compile(r"[—–-]+\s*\w")
_DASH_CAPITAL = re.compile(r"[—–-]+\s*[A-ZА-ЯÀ-Þ]")
_GLUED = re.compile(r"(?<=[^\W\d_]{2})[.!?…](?=[A-ZÀ-ÞА-Я])")
_DATED = re.compile(r"\d{1,2}\.")
_KOREAN_DAY = re.compile(r"(에|일|부터|까지|경)")
_BRACKETED = re.compile(r"[(（][^A-Z]")


def _thai_gaps(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    for m in re.finditer(r"\s+", text[lo:hi]):
        a, b = lo + m.start(), lo + m.end()
        if a == lo or b >= hi:
            continue
        p, n = text[a - 1], text[b]
        touches = lambda c: c.isdigit() or c.isascii() and c.isalpha() or "À" <= c <= "ɏ"
        if (_THAI.match(p) or _THAI.match(n)) and not touches(p) and not touches(n):
            yield a, b


def _block(text: str, lo: int, hi: int, ev: Evidence) -> Iterator[tuple[int, int]]:
    """Units of a block, a stretch that no unit crosses: the best division into whole spans."""
    ends: dict[int, float] = {}
    script = _script(text[lo:hi])
    for m in _CANDIDATE.finditer(text, lo, hi):
        at = _end(text, m, lo)
        ends[at] = _score(text, m, at, hi, lo, ev, script)
    if _THAI.search(text, lo, hi):
        for a, _ in _thai_gaps(text, lo, hi):
            ends[a] = max(ends.get(a, 0.0), SURE_MARK)
    ends[hi] = 0.0
    at = sorted(ends)
    n = len(at)
    if n == 1:
        yield lo, hi
        return
    own = [ends[e] for e in at]
    pairs = _depths(text, lo, hi)
    if pairs:
        starts, stops = sorted(a for a, _ in pairs), sorted(b for _, b in pairs)
        for k in range(n - 1):
            if bisect_left(starts, at[k]) > bisect_left(stops, at[k]):
                own[k] += INSIDE
    yield from best_spans(text, lo, at, own, ev.costs[script])


def best_spans(text: str, begin: int, at: list[int], own: list[float], cost: list[float]) -> Iterator[tuple[int, int]]:
    """The division of text[begin:at[-1]] into spans that end at members of ``at`` with the highest sum of
    the boundaries' scores ``own`` and the spans' for length, straight quotation marks and letters.

    Spans beyond the length from which the cost stays the same are compared through a running maximum, so the
    time grows with the number of candidates and not with its square.
    """
    n = len(at)
    straight = text.count('"', begin, at[-1]) > 0
    edges, marks, letters = [begin, *at], [0], [0]  # straight marks mod 2 and pieces with a letter or digit so far
    firsts = [begin]  # where a span that begins at an edge has its first sign
    for a, e in zip(edges, at):  # noqa: B905
        sign = e
        while sign < at[-1] and text[sign].isspace():
            sign += 1
        firsts.append(sign)
        marks.append(marks[-1] + text.count('"', a, e) & 1 if straight else 0)
        letters.append(letters[-1] + (firsts[-2] < e and text[firsts[-2]].isalpha() or _ALNUM.search(text, a, e) is not None))
    flat = SLOTS - 1
    while flat and cost[flat - 1] == cost[-1]:
        flat -= 1
    reach = 2 ** ((flat + 1) / 2) + 1  # spans longer than that cost the same
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    far: list[tuple[float, int]] = [(float("-inf"), 0)] * 2  # of the starts out of reach, by straight marks
    low = 0
    for j in range(1, n + 1):
        e, mj, lj = edges[j], marks[j], letters[j]
        while e - edges[low] > reach and low < j - 1:
            if best[low] > far[marks[low]][0]:
                far[marks[low]] = (best[low], low)
            low += 1
        i, value = 0, float("-inf")
        for parity in (0, 1):
            v = far[parity][0] + cost[-1] + (ODD if parity != mj else 0.0)
            if v > value:
                i, value = far[parity][1], v
        for k in range(low, j):
            length = e - firsts[k]
            v = best[k] + cost[_SLOT[length] if 0 <= length < 4096 else _slot(length)]
            if marks[k] != mj:
                v += ODD
            if letters[k] == lj:
                v += EMPTY
            if v >= value:
                i, value = k, v
        best[j], back[j] = value + own[j - 1], i
    cuts, j = [], n
    while j:
        cuts.append((edges[back[j]], edges[j]))
        j = back[j]
    yield from reversed(cuts)


_SLOT = [_slot(n) for n in range(4096)]
_LISTS = Evidence()


def sentence_spans(text: str | None, line_units: bool = False, evidence: Evidence = _LISTS) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text in code points, in order, without outer white space.

    line_units: every line is a unit (log files). NULL, empty and blank texts have no sentence.
    evidence: what was counted over all texts; by default only the lists of abbreviations speak.
    """
    if not text:
        return []
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    blocks: list[tuple[int, int, bool]] = []  # start, end, whole
    fresh = True
    for a, b in lines:
        if not text[a:b].strip():
            fresh = True
        elif line_units or _ITEM.match(text, a, b) or _LOG.match(text, a, b):
            blocks.append((a, b, True))
            fresh = True
        elif fresh or _CHAT.match(text, a, b):
            blocks.append((a, b, False))
            fresh = False
        else:
            blocks[-1] = (blocks[-1][0], b, False)
    out = []
    for a, b, whole in blocks:
        for s, e in [(a, b)] if whole else _block(text, a, b, evidence):
            piece = text[s:e]
            bare = piece.strip()
            if bare:
                s += len(piece) - len(piece.lstrip())
                out.append((s, s + len(bare)))
    return out


def learn_evidence(texts: DataFrame) -> Evidence:
    """Evidence over a DataFrame's column ``text``: at most 6 * BUCKETS counters and a few hundred reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            sums.update(count_evidence([t for t in batch.column(0).to_pylist() if t]))
        kinds, buckets = ([k[i] for k in sums] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["kind", "bucket", "n"])

    return build_evidence(texts.select("text").mapInArrow(count, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas().to_numpy())


def build_evidence(rows: np.ndarray) -> Evidence:
    """From rows (kind, bucket, times)."""
    counts, cases, lengths = np.zeros((6, BUCKETS), np.float32), np.zeros((2, 2)), np.zeros(len(SCRIPTS) * SLOTS)
    for kind in range(9):
        some = rows[rows[:, 0] == kind]
        target = counts[kind] if kind < 6 else cases[kind - 6] if kind < 8 else lengths
        target[some[:, 1].astype(np.int64)] = some[:, 2]
    return Evidence(counts, cases, lengths.reshape(len(SCRIPTS), SLOTS))


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", line_sources: tuple[str, ...] = ("tool_logs",)) -> DataFrame:
    """``id_col``, start_pos, end_pos: one row per sentence of every text.

    Texts whose ``source_col`` is in ``line_sources`` have a unit per line. NULL, empty and blank
    texts give no row; NULL ids are kept; repeated rows give their sentences again. Texts of any
    length are handled whole. Other columns are ignored, so their names cannot clash.
    """
    kind = F.coalesce(F.col(f"`{source_col}`").isin(*line_sources), F.lit(False)) if source_col else F.lit(False)
    rows = spread(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), kind.alias("lines")).where("text is not null"))
    evidence = learn_evidence(rows.where("not lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for s, e in sentence_spans(text, line, evidence):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "start_pos", "end_pos"])

    return rows.mapInArrow(run, "id bigint, start_pos bigint, end_pos bigint").select(F.col("id").alias(id_col), "start_pos", "end_pos")
