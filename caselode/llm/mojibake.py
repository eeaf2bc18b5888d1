"""Text decoded with the wrong character encoding (problem 4).

1. A character model is counted over all texts: pairs of neighbouring characters, hashed to a fixed
   number of buckets. Clean text far outweighs garbled text, so garbled stretches score low.
2. Sentences are joined with clean near-twins: those with the same text once every non-ASCII
   character is stripped and digits are alike, and as many bytes in each gap. Of those that share a
   key the best-scoring one stands as the clean twin; aligning the characters between the shared ASCII
   ones gives the garbled form of each clean run, and the pairs of encodings (read as, written in)
   that turn one into the other are inferred. The fewest pairs that explain all twins but those that
   hardly ever occur are the learned transformations.
3. Every unit (line or cell) is read back through the learned transformations. A unit is garbled where
   reading it back raises its score enough. What the model flags as unlikely all the same is tried
   with the other known pairs under a stricter limit.
   Replacement characters mark stretches beyond recovery.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.session import cut, spread

BUCKETS = 1 << 18
#: Characters counted at a time.
CHUNK = 200_000
#: Gain of the mean log probability of a non-ASCII character pair from which a reading counts: learned and other pairs of encodings.
GAIN_LEARNED = 1.2
GAIN_OTHER = 2.2
GAIN_FEW = 4.5
#: Non-ASCII characters below which only learned pairs and strict UTF-8 count.
FEW = 4
#: A character is usual if it makes up at least this share of the non-ASCII ones, but need not occur oftener than UNUSUAL times.
USUAL_SHARE = 2e-6
UNUSUAL = 2
#: Twins that make a transformation learned.
SUPPORT = 3
#: Different non-ASCII characters that a pair of twins needs to tell encodings apart.
DIFFERENT = 2
#: Mean log probability below which a unit is flagged for pairs of encodings that no twins show.
FLAGGED = -7.5
#: Mean log probability that reading back to plain ASCII counts as.
ASCII_SCORE = -7.0

WESTERN = ("cp1252", "cp437", "cp850", "mac_roman", "iso8859-15")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
WIDE = ("cp932", "euc_jp", "gbk", "big5", "cp949")
OTHER = ("cp1250", "cp1253", "cp1254", "cp1256", "cp874", "cp1255")
SINGLE = (*WESTERN, *CYRILLIC, *OTHER)


def _known_pairs() -> dict[str, tuple[str, ...]]:
    """For each encoding that texts are read as, those that they may have been written in."""
    out = {}
    for r in WESTERN:
        out[r] = ("utf-8", *(w for w in (*WESTERN, *CYRILLIC, *WIDE, *OTHER) if w != r))
    for r in CYRILLIC:
        out[r] = ("utf-8", *(w for w in (*CYRILLIC, "cp1252", "mac_roman", *WIDE, "cp1256", "cp874") if w != r))
    for r in WIDE:
        out[r] = ("utf-8", *(w for w in (*WIDE, "cp1252", "cp1251", "koi8-r") if w != r))
    for r in OTHER:
        out[r] = ("utf-8", "cp1252", "cp1251")
    return out | {"utf-16-le": ("utf-16-be",), "utf-16-be": ("utf-16-le",)}


#: (read as) -> (written in) that are tried.
KNOWN = _known_pairs()
_UNITS = re.compile(r"[^\n\r]+")
_CELLS = re.compile(r" \| | = ")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SENTENCES = re.compile(r"(?<=[.!?])[ \t]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ISLAND = re.compile(r"(?:(?<![A-Za-z])[A-Za-z]+)?[^\x00-\x7f](?:[^\x00-\x7f]|[A-Za-z]+|[\x21-\x40\x5b-\x60\x7b-\x7e ]{1,2}(?=[A-Za-z]{0,2}[^\x00-\x7f]))*")
_LATIN = {chr(b): bytes([b]) for b in range(0x80, 0xA0)}


def _encode(text: str, codec: str) -> bytes | None:
    """Bytes of ``text``; in Western code pages C1 controls stand for their own bytes, as lenient readers leave them."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1251", "cp1250", "cp1253", "cp1256", "cp874", "cp932"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if ch not in _LATIN:
                return None
            out += _LATIN[ch]
    return bytes(out)


def read_back(text: str, read_as: str, written_in: str) -> str | None:
    """The text as it was before it was read wrongly; None if it can't have come about that way."""
    data = _encode(text, read_as)
    if data is None:
        return None
    try:
        out = data.decode(written_in)
    except UnicodeDecodeError:
        return None
    return None if out == text or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�-]", out) else out


def utf8_lines(text: str) -> str:
    """The text with each line read back that is UTF-8 read as a Western code page as a whole; needs no model."""
    return "\n".join(x if x.isascii() else read_back(x, "cp1252", "utf-8") or x for x in text.split("\n"))


def _pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the neighbouring pairs with a non-ASCII character; digits are alike."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.where((a >= 48) & (a <= 57), 48, a).astype(np.uint64)
    x, y = a[:-1], a[1:]
    keep = (x > 127) | (y > 127)
    x, y = x[keep], y[keep]
    with np.errstate(over="ignore"):
        h = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64), keep


_PAIR = re.compile(r"(?=([^\x00-\x7f].|.[^\x00-\x7f]))", re.S)
_64 = (1 << 64) - 1


class _PairScores(dict):
    """Log probability of a pair of characters, worked out once; the same buckets as ``_pairs``."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp

    def __missing__(self, pair: str) -> float:
        x, y = (48 if 48 <= c <= 57 else c for c in map(ord, pair))  # digits are alike
        h = (x * 0x9E3779B97F4A7C15 & _64) ^ (y * 0xC2B2AE3D27D4EB4F & _64)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & _64
        if len(self) > 200_000:
            self.clear()
        self[pair] = value = float(self.logp[h >> 46])
        return value


class Model:
    """Log probabilities of hashed character pairs, and the non-ASCII characters that occur at all often."""

    def __init__(self, buckets: np.ndarray, counts: np.ndarray, usual: frozenset[str]):
        self.usual = usual | frozenset(map(chr, range(32, 127))) | {"\t"}
        total = max(float(counts.sum()), 1.0)
        self.logp = np.full(BUCKETS, np.log(0.3 / (total + BUCKETS)), dtype=np.float32)
        self.logp[buckets] = np.log((counts + 0.3) / (total + BUCKETS))
        self.pairs = _PairScores(self.logp)
        #: No score is above this.
        self.top = max(float(self.logp.max()), ASCII_SCORE)

    def score(self, text: str, before: str = " ", after: str = " ") -> float:
        """Mean log probability of the pairs with a non-ASCII character of a stretch between two characters."""
        pairs = _PAIR.findall(f"{before}{text}{after}")
        return sum(map(self.pairs.__getitem__, pairs)) / len(pairs) if pairs else ASCII_SCORE


def _units(text: str) -> Iterator[tuple[int, int]]:
    for m in _UNITS.finditer(text):
        if m[0].isascii():
            continue
        a = m.start()
        for c in [*_CELLS.finditer(text, m.start(), m.end()), None]:
            b = c.start() if c else m.end()
            if not text[a:b].isascii():
                yield a, b
            a = c.end() if c else b


#: A byte of two or more of UTF-8, seen through a single-byte encoding, has at least two marks side by side.
_TWO = re.compile(r"[^\x00-\x7f]{2}")


_MARK = re.compile(r"[^\x00-\x7f]")


@lru_cache(10_000)
def _readers(mark: str) -> tuple[str, ...]:
    """The encodings that can have given the character."""
    return tuple(r for r in KNOWN if _encode(mark, r) is not None)


def _lettered(text: str, out: str) -> bool:
    """Whether the marks turn into letters, or letters into quotation marks."""
    marks = [c for c in out if not c.isascii()]
    if not all(c.isalpha() or c in "’“”„«»–—…" for c in marks):
        return False
    return any(c.isalpha() for c in marks) or all(c.isalpha() for c in text if not c.isascii())


#: A mark that is no letter, a letter of another script in a Latin word or alone, a quotation mark within a word, or a change of case within a word.
_ODD = re.compile(r"(?:(?![\x00-\x7f «»¿¡‐-‧])[\W_]|[A-Za-z][^\x00-\x7f\u00c0-\u024f\u2018-\u201f]|(?![\x00-\x7f])[^\u00c0-\u024f\u2018-\u201f][A-Za-z]|[a-z][À-ÖØ-Þ]|[ß-öø-ÿ][A-Z]|[?!.,][ß-öø-ÿ]|[A-Za-z][‚„†-•]|[a-z][“”][a-zß-ÿ]|-…-|(?<![^\x00-\x7f])[Ͱ-ӿ](?![^\x00-\x7f]))")


def _least_gain(r: str, w: str, marks: int, known: bool) -> float:
    """A lower bound of the gain from which _best takes a reading, whatever the reading is."""
    if w == "utf-8":
        return -3.0 if r in SINGLE else 0.5 if r in WIDE else GAIN_OTHER
    if marks < FEW - known:
        return GAIN_LEARNED if known else GAIN_OTHER
    return GAIN_LEARNED * min(1.0, 8 / marks) if known else max(0.9, GAIN_OTHER * 4 / marks)


@lru_cache(8)
def _plan(learned: frozenset, flagged: bool) -> dict[str, list[tuple[str, bool]]]:
    """read as -> (written in, whether learned) of the pairs to try."""
    out = {r: [(w, (r, w) in learned) for w in written if flagged or (r, w) in learned] for r, written in KNOWN.items()}
    return {r: written for r, written in out.items() if written}


def _best(text: str, model: Model, learned: frozenset, before: str = " ", after: str = " ", others: bool = True) -> tuple[str, str, str] | None:
    """read_as, written_in and the reading that gains most, if one gains enough."""
    own = model.score(text, before, after)
    marks = len(text) - len(text.encode("ascii", "ignore"))
    if not marks:
        return None
    room = model.top - own + 1e-4  # what a reading can gain at most
    flagged = others and own < FLAGGED
    two = _TWO.search(text) is not None
    odd = _ODD.search(text) is not None
    best, most = None, 0.0
    plan = _plan(learned, flagged)
    for r in _readers(_MARK.search(text)[0]):
        single, written = r in SINGLE, plan.get(r)
        written = written and [w for w, known in written if _least_gain(r, w, marks, known) <= room]
        if not written:
            continue
        data = _encode(text, r)
        if data is None:
            continue
        for w in written:
            try:
                out = data.decode(w)
            except UnicodeDecodeError:
                continue
            for _ in range(2):  # garbled again and again the same way
                if w != "utf-8" or not single or model.usual.issuperset(out) or (data2 := _encode(out, r)) is None:
                    break
                try:
                    out = data2.decode(w)
                except UnicodeDecodeError:
                    break
            if not model.usual.issuperset(out) or out == text:
                continue
            known = (r, w) in learned
            if w == "utf-8":
                if single:  # does not come about by chance
                    least = -3.0 if marks >= 3 else 0.0
                elif r in WIDE:
                    if marks < 3 and not re.search(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", text):
                        continue
                    least = GAIN_OTHER if marks < 3 else 0.5
                else:
                    least = GAIN_OTHER
            elif marks < FEW - known:
                if single and w in WIDE and two and 2 * sum(not c.isascii() for c in out) == marks:
                    least = GAIN_FEW
                elif single and w in WESTERN and (known or r in WESTERN) and odd and _lettered(text, out):
                    least = GAIN_LEARNED if known else GAIN_OTHER
                else:
                    continue
            else:
                least = GAIN_LEARNED * min(1.0, 8 / marks) if known else max(0.9, GAIN_OTHER * 4 / marks)
            gain = model.score(out, before, after) - own
            if gain >= least and (best is None or gain > most + 0.05):
                best, most = (r, w, out), gain
    return best


def repair_text(text: str, model: Model, learned: frozenset, cache: dict | None = None, others: bool = True) -> tuple[str, bool]:
    """The text with its garbled stretches read back where possible, and whether it had any. others: whether flagged units are tried with pairs not learned."""
    cache = {} if cache is None else cache
    out, at, found = [], 0, "\ufffd" in text
    for a, b in _units(text):
        unit = text[a:b]
        # digits are alike to the model and in no encoding part of another character, so such a unit was decided before
        same = ("", _DIGIT.sub("0", unit))
        if same in cache:
            continue
        fixed = _repair_unit(unit, model, learned, cache, others)
        if len(cache) > 50_000:
            cache.clear()
        if fixed == unit:
            cache[same] = unit
        else:
            found = True
            out += [text[at:a], fixed]
            at = b
    return "".join([*out, text[at:]]), found


def _repair_island(text: str, model: Model, learned: frozenset, before: str, after: str, others: bool) -> str:
    for _ in range(3):
        best = _best(text, model, learned, before, after, others)
        if best is None:
            break
        text = best[2]
    return text


def _repair_unit(unit: str, model: Model, learned: frozenset, cache: dict, others: bool) -> str:
    for _ in range(3):  # text can be garbled twice
        best = _best(unit, model, learned, others=others)
        if best is None:
            break
        unit = best[2]
        if unit.isascii():
            return unit
    # stretches within a unit
    out, at = [], 0
    for m in _ISLAND.finditer(unit):
        if m[0] == unit:
            continue
        key = (unit[m.start() - 1] if m.start() else " ", m[0], unit[m.end()] if m.end() < len(unit) else " ")  # words recur
        if key not in cache:
            cache[key] = _repair_island(m[0], model, learned, key[0], key[2], others)
        text = cache[key]
        if text != m[0]:
            out += [unit[at : m.start()], text]
            at = m.end()
    return "".join([*out, unit[at:]])


def twin_keys(sentence: str) -> tuple[int, int]:
    """Keys of a sentence as it stands in a legacy encoding and in UTF-8: its text stripped of non-ASCII characters, digits alike, with the bytes of each gap."""
    bare = _DIGITS.sub("0", sentence)
    runs = _RUN.findall(bare)
    legacy = _RUN.sub(lambda m: f"\x00{sum(2 if _wide(c) else 1 for c in m[0])}\x00", bare)
    utf8 = _RUN.sub(lambda m: f"\x00{len(m[0].encode('utf-8', 'surrogatepass'))}\x00", bare) if runs else bare
    return tuple(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) for x in (legacy, utf8))


def _wide(c: str) -> bool:
    """Whether the character takes two bytes in the encodings that have it."""
    return "\u2e80" <= c <= "\ud7ff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uff60" or c in "、。「」"


def _align(garbled: str, clean: str) -> Iterator[tuple[str, str]]:
    """Runs (garbled, clean) between the ASCII characters that both share."""
    split = lambda t: re.split(r"([\x00-\x7f])", t)
    g, c = split(garbled), split(clean)
    if g[1::2] == c[1::2]:
        yield from ((x, y) for x, y in zip(g[::2], c[::2], strict=True) if x != y and x and y)


def _arrow(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def character_model(texts: DataFrame) -> Model:
    """The model over a DataFrame's column ``text``; at most BUCKETS counters and one for each Unicode character reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, chars = np.zeros(BUCKETS, np.int64), Counter()

        def add(some: list[str]) -> None:
            text = f" {' '.join(some)} "
            at, _ = _pairs(text)
            np.add(sums, np.bincount(at, minlength=BUCKETS), out=sums)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            for c, n in zip(*map(np.ndarray.tolist, np.unique(points[points > 127], return_counts=True)), strict=True):
                chars[c] += n

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size > CHUNK:
                    add(held)
                    held, size = [], 0
        add(held)
        some = np.flatnonzero(sums)
        points = np.array(sorted(chars), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, -1 - points])), pa.array(np.concatenate([sums[some], np.array([chars[c] for c in points.tolist()], np.int64)]))], names=["b", "n"])

    rows = texts.mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    b, n = rows["b"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    return build_model(b, n)


def build_model(b: np.ndarray, n: np.ndarray) -> Model:
    """From counters: buckets of pairs as they are, characters as -1 - code point."""
    chars = b < 0
    least = max(UNUSUAL, USUAL_SHARE * n[chars].sum())
    usual = frozenset(chr(-1 - int(x)) for x in b[chars & (n > least)])
    return Model(b[~chars], n[~chars], frozenset(c for c in usual if not ("\x80" <= c <= "\x9f" or c == "�" or "\ue000" <= c <= "\uf8ff")))


def learn_transformations(texts: DataFrame, model: Model, support: int = SUPPORT) -> frozenset:
    """(read_as, written_in) pairs that explain the twins, see ``fewest_pairs``; only sets of pairs and how often they occur reach the driver."""

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], set()
            for text in batch.column(0).to_pylist():
                for a, b in _units(text):
                    for x in _SENTENCES.split(text[a:b]):
                        if x.isascii() or "\ufffd" in x or x in seen:
                            continue
                        seen.add(x)
                        if len(set(x) - _ASCII) >= DIFFERENT and _BARE.search(x):
                            legacy, utf8 = twin_keys(x)
                            score = model.score(x)
                            out.append((legacy, x, score))
                            if utf8 != legacy:  # as the clean twin of one read from UTF-8
                                out.append((utf8, x, score))
            yield _arrow(["key", "sentence", "score"], [pa.int64(), pa.string(), pa.float64()], out)

    seen = cut(texts.mapInArrow(sentences, "key bigint, sentence string, score double").distinct())
    # one clean twin for each key: linear however many sentences share it
    twin = seen.groupBy("key").agg(F.max(F.struct("score", "sentence")).alias("twin"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "twin")
    pairs = seen.join(twin, "key").where(F.col("score") < F.col("twin.score") - GAIN_LEARNED / 2).select("sentence", F.col("twin.sentence").alias("clean"))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for garbled, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if names := explaining(garbled, clean):
                    out.append((" ".join(f"{r}>{w}" for r, w in names), 1))
            yield _arrow(["pairs", "n"], [pa.string(), pa.int64()], out)

    found = pairs.mapInArrow(infer, "pairs string, n bigint").groupBy("pairs").agg(F.sum("n").alias("n")).where("n > 1").collect()
    return fewest_pairs({tuple(tuple(x.split(">")) for x in r["pairs"].split(" ")): r["n"] for r in found}, support)


_ASCII = frozenset(map(chr, range(128)))
_BARE = re.compile(r"[A-Za-z0-9]")


def explaining(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The pairs of encodings that turn every run of the clean text into that of the garbled one; digits may differ."""
    runs = list(_align(_DIGITS.sub("0", garbled), _DIGITS.sub("0", clean)))
    if not runs or sum(len(set(x)) for x, _ in runs) < DIFFERENT:
        return []
    runs.sort(key=lambda r: -len(r[0]))
    return [(r, w) for r, written in KNOWN.items() for w in written if all(read_back(x, r, w) == y for x, y in runs)]


def fewest_pairs(sets: dict[tuple, int], support: int) -> frozenset:
    """Pairs, taken one after the other by how many twins they explain that no earlier one does, until that is less than ``support``."""
    left, out = dict(sets), set()
    while left:
        votes: Counter = Counter()
        for pairs, n in left.items():
            for p in pairs:
                votes[p] += n
        best, n = max(votes.items(), key=lambda kv: (kv[1], [-_ORDER[x] for x in kv[0]]))
        if n < support:
            break
        out.add(best)
        left = {pairs: n for pairs, n in left.items() if best not in pairs}
    return frozenset(out)


#: Of pairs that explain the same twins the one with the commoner encodings counts.
_ORDER = {c: i for i, c in enumerate(("utf-8", "cp1252", "cp1251", "cp437", "koi8-r", "cp866", "mac_roman", "gbk", "cp932", "euc_jp", "cp949", "big5", *KNOWN, *OTHER))}


def garbled_texts(df: DataFrame, id_col: str = "item_id", text_col: str = "text", others: bool = True) -> DataFrame:
    """``id_col``, repaired, recovered of the rows whose text holds a stretch decoded with a wrong encoding.

    repaired: the text with the stretches read back that can be; recovered: whether none is left
    over. NULL, empty and all-ASCII texts are never garbled; repeated rows come out each. Texts of
    any length are read whole. Other columns are ignored. others: whether units that the model flags
    are tried with pairs of encodings that no twins show.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    rows = spread(rows)
    texts = rows.select("text")
    model = character_model(texts)
    learned = learn_transformations(texts, model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fixed, found = repair_text(text, model, learned, cache, others)
                if found:
                    out.append((i, fixed, "�" not in fixed))
            yield _arrow(["id", "repaired", "recovered"], [pa.int64(), pa.string(), pa.bool_()], out)

    return rows.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(find, "id bigint, repaired string, recovered boolean").withColumnRenamed("id", id_col)
