"""Only the text that a mail's sender newly wrote (problem 5).

Structure first: quoted lines and the lines that introduce them, and everything from a forwarded or
original message's header block on, are the mail's embedded thread ancestors. The paragraphs left
are compressed with dictionaries formed from other mails:

* closings of all senders: the pieces of lines that stand behind a rule or the sender's name in many
  mails of several senders, and in these places rather than before them (greetings, closing phrases
  and recurring sentences stand before), and lines that end the body of many mails but never go
  before the sender's name, as closing phrases do. The sender's name, addresses and numbers are alike,
* closings of the sender: paragraphs that recur at the end of the sender's own mails, digits alike,
* thread ancestors: the embedded ones, and paragraphs of earlier messages of the same thread.

A paragraph, or the last lines of one, that compresses abnormally much better with a dictionary than
alone is suspect. It is taken away where exact overlaps with the dictionary's entries confirm it; all
else is kept, greetings and closing phrases included. There are no lists of phrases.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.session import cut, spread

#: A piece of a closing stands behind a rule or name in at least this share of the mails, at least so often, and for so many senders.
CLOSING_SHARE = 0.0005
CLOSING_LEAST = 3
SENDERS_LEAST = 3
#: Of all mails with the piece, those in which it stands behind a rule or name.
BEHIND = 0.1
#: A line that ends bodies does so in at least this share of the mails, at least so often, and this share of its times; before the sender's name it stands in at most this share.
TAIL_SHARE = 0.001
TAIL_LEAST = 12
TAIL = 0.5
NAMED = 0.03
#: A sender's own closing ends at least so many different mails in as many threads.
SENDER_LEAST = 3
#: Shortest paragraph, in characters, that can be a sender's own closing, or an ancestor's.
LONG = 40
LONG_ANCESTOR = 80
#: Share of its own compressed size that a suspect paragraph saves at least through a dictionary.
GAIN = 0.5
#: Share of its characters that exact overlaps must cover for a line to be confirmed, and the length of an overlap within a piece.
COVERED = 0.6
GRAM = 12
MAX_BROADCAST = 20_000
#: Counters of pieces before a rule or name, whatever the number of mails.
BUCKETS = 1 << 20

_QUOTED = re.compile(r"\s{0,3}[>|｜＞]")
_RULE = re.compile(r"\s*(?:[-_=*~—–─]{2,})\s*")
_HEADER = re.compile(r"\*?[^\s:：@]{1,24}(?: [^\s:：@]{1,12})?\*? ?[:：]\*?\s+\S")
_RULED = re.compile(r"[-=_*]{3,}")
_WORD = re.compile(r"\w")
_MAIL = r"(^|/)msg_\d+$"
_PIECES = re.compile(r"\s+[|•·–—-]\s+|[,;:]\s+")
NAME, ADDRESS, LINK, RULE = "<the name of the sender>", "<a mailbox>", "<a link>", "<a rule>"


@dataclass
class Mail:
    """lines; own: paragraphs (line ranges) outside embedded ancestors; ancestors: the embedded texts."""

    lines: list[str]
    sender: str = ""
    topic: str = ""
    own: list[tuple[int, int]] = field(default_factory=list)
    ancestors: list[str] = field(default_factory=list)


def _banner(line: str) -> bool:
    """Words between two rules."""
    text = line.strip()
    m = _RULED.match(text)
    return m is not None and len(text) - len(text.rstrip("-=_*")) >= 3 and _WORD.search(text, m.end(), len(text.rstrip("-=_*"))) is not None


def _introduces(line: str) -> bool:
    return line.rstrip().endswith((":", "：", ">>>", "&gt;"))


def _mailbox(line: str) -> bool:
    return any("@" in x[1:-1] for x in line.split())


def _header_block(lines: list[str], i: int) -> bool:
    """Three header lines in a row, a mail address or a date among them."""
    head = lines[i : i + 3]
    return len(head) == 3 and all(_HEADER.match(x) for x in head) and (any("@" in x for x in head) or all(x.lstrip().startswith("*") for x in head))


def _topic(subject: str) -> str:
    """The subject without reply and forward marks."""
    return re.sub(r"^(?:\s*[^\W\d_]{1,6}(?:\[\d+\])?\s*[:：])+", "", subject).strip().lower()


def parse_mail(text: str) -> Mail:
    """Splits a mail at its structure. Without a blank line the text is all preamble."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    start = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
    mail = Mail(lines, lines[1].strip() if start > 1 else "", _topic(lines[0]) if start else "")
    old = [False] * len(lines)
    i = start + 1
    while i < len(lines):
        if _QUOTED.match(lines[i]):
            old[i] = True
            at = i - 1
            if at > start and not lines[at].strip() and at - 1 > start and _introduces(lines[at - 1]) and _mailbox(lines[at - 1]):
                at -= 1  # a blank line between
            if at > start and not old[at] and lines[at].strip() and _introduces(lines[at]):
                old[at] = True
                before = lines[at - 1] if at - 1 > start else ""
                if before.strip() and not old[at - 1] and re.match(r"\s*(?:<|\S+@)", lines[at]):
                    old[at - 1] = True  # the introduction was wrapped
        elif _header_block(lines, i):
            at = i
            while at - 1 > start and lines[at - 1].strip() and (_RULE.fullmatch(lines[at - 1]) or _banner(lines[at - 1]) or _introduces(lines[at - 1])):
                at -= 1
            if at == i and at - 2 > start and not lines[at - 1].strip() and (_banner(lines[at - 2]) or _RULE.fullmatch(lines[at - 2]) or re.fullmatch(r"\s*Begin forwarded message:\s*", lines[at - 2])):
                at -= 2
            for k in range(at, len(lines)):
                old[k] = True
            break
        elif _banner(lines[i]) and re.match(r"\s*-{3,}", lines[i]):
            for k in range(i, len(lines)):
                old[k] = True
            break
        i += 1
    ancestor: list[str] = []
    begin = None
    for k in range(start + 1, len(lines) + 1):
        if k < len(lines) and not old[k] and lines[k].strip():
            # a rule or the sender's name may follow the text without a blank line
            if begin is not None and (_RULE.fullmatch(lines[k]) or _same_name(lines[k], mail.sender) and not _RULE.fullmatch(lines[k - 1])):
                mail.own.append((begin, k))
                begin = k
            begin = k if begin is None else begin
            continue
        if begin is not None:
            mail.own.append((begin, k))
            begin = None
        if k < len(lines) and old[k] and lines[k].strip():
            ancestor.append(re.sub(r"^(?:\s{0,3}[>|｜＞])+ ?", "", lines[k]))
    if ancestor:
        mail.ancestors.append("\n".join(ancestor))
    return mail


def _flat(lines: list[str]) -> str:
    return " ".join(" ".join(lines).split())


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _same_name(line: str, sender: str) -> bool:
    return bool(sender) and line.strip().casefold() == sender.casefold()


def _closing(mail: Mail) -> str | None:
    """The last own paragraph with digits alike, if others stand before it and it is long enough."""
    flat = _flat(mail.lines[slice(*mail.own[-1])]) if len(mail.own) > 1 else ""
    return re.sub(r"\d+", "0", flat) if mail.sender and len(flat) >= LONG else None


def masked(line: str, sender: str) -> str:
    """The line with the sender's name, mailboxes, links, rules and numbers alike."""
    line = line.strip()
    if _RULE.fullmatch(line):
        return RULE
    if sender and sender.casefold() in line.casefold():
        line = re.sub(re.escape(sender), NAME, line, flags=re.IGNORECASE)
    words = [ADDRESS if "@" in w[1:-1] and not w.startswith("<the") else LINK if w.startswith(("www.", "http://", "https://")) else w for w in line.split(" ")]
    return re.sub(r"\d+", "0", " ".join(words))


def pieces(line: str) -> list[str]:
    """Parts of a masked line between its separators."""
    return [x for x in (x.strip() for x in _PIECES.split(line)) if x]


def _places(mail: Mail) -> tuple[set[str], set[str], set[str], bool]:
    """Pieces of the mail's own lines before and behind the first rule or line with the sender's name, those of a single line that ends the
    part before, and whether the name comes next."""
    before, behind, tail, named, inside = set(), set(), set(), False, True
    for a, b in mail.own:
        lines = [masked(x, mail.sender) for x in mail.lines[a:b]]
        for k, text in enumerate(lines):
            if text in (NAME, RULE):
                named = named or inside and text == NAME or text == RULE and inside and lines[k + 1 : k + 2] == [NAME]
                inside = False
            elif inside:
                before.update(pieces(text))
            else:
                behind.update(pieces(text))
        if inside:
            tail = set(pieces(lines[0])) if len(lines) == 1 else set()
        elif lines[0] not in (NAME, RULE) and not behind:
            tail = set()  # the part before ends within this paragraph
    return before, behind, tail, named


def closes(behind: int, tails: int, named: int, before: int, n_mails: int) -> bool:
    """Whether a piece seen so often behind a rule or name, at the end of a body, there before the sender's name, and before a rule or name at all is one of closings."""
    if behind >= max(CLOSING_LEAST, CLOSING_SHARE * n_mails) and behind >= BEHIND * (behind + before):
        return True
    return tails >= max(TAIL_LEAST, TAIL_SHARE * n_mails) and tails >= TAIL * before and named <= NAMED * tails


def _packed(**more) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, **more)


class Closings:
    """A dictionary of closings: pieces of masked lines."""

    def __init__(self, entries: list[str]):
        self.entries = frozenset(entries) | {NAME, RULE, ADDRESS, LINK}
        text = "\n".join(sorted(self.entries, key=lambda x: (len(x), x)))
        self.grams = {x[i : i + GRAM] for x in self.entries for i in range(len(x) - GRAM + 1)}
        self.alone, self.given = _packed(), _packed(dict_data=_dictionary(text))

    def gain(self, text: str) -> float:
        return _gain(text, self.alone, self.given)

    def covers(self, line: str) -> bool:
        """Whether exact overlaps confirm a masked line."""
        covered = total = 0
        for x in pieces(line):
            total += len(x)
            if x in self.entries:
                covered += len(x)
            elif len(x) > GRAM:
                end = 0
                for i in range(len(x) - GRAM + 1):
                    if x[i : i + GRAM] in self.grams:
                        covered += i + GRAM - max(i, end)
                        end = i + GRAM
        return total > 0 and covered >= COVERED * total


def _dictionary(text: str) -> zstandard.ZstdCompressionDict:
    data = text.encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressionDict(data if len(data) >= 8 else data.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _gain(text: str, alone: zstandard.ZstdCompressor, given: zstandard.ZstdCompressor) -> float:
    data = text.encode("utf-8", "surrogatepass")
    size, less = (len(c.compress(data)) - 4 for c in (alone, given))  # without the frame
    return (size - less) / max(size, 1)


def compression_gain(text: str, dictionary: str) -> float:
    """Share of the compressed size that the dictionary saves."""
    return _gain(text, _packed(), _packed(dict_data=_dictionary(dictionary)))


def new_lines(mail: Mail, closings: Closings, ancestors: set[int], closing: bool = False, gain: float = GAIN) -> list[int]:
    """Numbers of the lines that the sender newly wrote.

    closings: those of all senders; ancestors: keys of paragraphs that earlier messages of the thread hold;
    closing: whether the last own paragraph is one of the sender's recurring closings.
    """
    old = [_flat(x.split("\n")) for x in mail.ancestors]
    embedded = _packed(dict_data=_dictionary("\n".join(mail.ancestors))) if mail.ancestors else None
    out = []
    for a, b in mail.own[:-1] if closing else mail.own:
        flat = _flat(mail.lines[a:b])
        if len(flat) >= LONG_ANCESTOR:
            if _key(flat) in ancestors:  # an earlier message as dictionary holds it word for word
                continue
            if embedded and _gain(flat, closings.alone, embedded) >= gain and any(flat in x for x in old):
                continue
        lines = [masked(x, mail.sender) for x in mail.lines[a:b]]
        known = [closings.covers(x) for x in lines]
        keep = len(lines)
        if known[0] and known[-1] and closings.gain("\n".join(lines)) >= gain:
            keep = 0
        elif known[-1]:
            k = len(lines)
            while k and known[k - 1]:
                k -= 1
            if closings.gain("\n".join(lines[k:])) >= gain:
                keep = k
        out += range(a, a + keep)
    return out


_SURVEY = ("item_id", "thread", "par", "seq", "whole", "who", "closing", "piece", "before", "named")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SURVEY)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "piece" else pa.int64()) for n, x in zip(_SURVEY, columns, strict=True)], names=list(_SURVEY))


def _bucket(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % BUCKETS


def mails(items: DataFrame, subpath_col: str = "subpath") -> DataFrame:
    """The rows of mail messages, told by their subpath."""
    return items.where(F.col(f"`{subpath_col}`").rlike(_MAIL))


def newly_written(items: DataFrame, repair=None) -> DataFrame:
    """item_id, line_no of every line newly written by a mail's sender.

    items: item_id, container_path, subpath, text; other columns are ignored. Rows that are no mail,
    NULL and empty texts give no line. Copies of a mail are no ancestors of each other. NULL
    containers form one container. repair: text -> text, applied before reading a mail (line
    numbers must survive; a repair that changes their number is not used).
    """
    rows = mails(items).where("text is not null").select("item_id", F.xxhash64("container_path").alias("box"), F.regexp_extract("subpath", r"msg_(\d+)$", 1).cast("bigint").alias("seq"), "text")
    rows = spread(rows)

    def read(text: str) -> Mail:
        if repair is not None and not text.isascii():
            fixed = repair(text)
            if fixed.count("\n") == text.count("\n"):
                text = fixed
        return parse_mail(text)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before_counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for item, box, seq, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                mail = read(text)
                thread, whole, who = _key(f"{box}\x1f{mail.topic}"), _key(text), _key(mail.sender.casefold())
                closing = _closing(mail)
                for a, b in mail.own:
                    flat = _flat(mail.lines[a:b])
                    if len(flat) >= LONG:
                        out.append((item, thread, _key(flat), seq, whole, who, _key(closing) if closing and (a, b) == mail.own[-1] else None, None, None, None))
                before, behind, tail, named = _places(mail)
                out += [(None, None, None, None, None, who, None, x, None, None) for x in behind]
                out += [(None, None, None, None, None, who, None, x, None, int(named)) for x in tail]
                at = np.array([_bucket(x) for x in before - behind], np.int64)
                np.add.at(before_counts, at, 1)
            yield _rows(out)
        some = np.flatnonzero(before_counts)
        yield _rows([(None, None, int(k), None, None, None, None, None, int(n), None) for k, n in zip(some, before_counts[some], strict=True)])

    seen = cut(rows.mapInArrow(survey, ", ".join(f"{n} {'string' if n == 'piece' else 'bigint'}" for n in _SURVEY)))

    n_mails = rows.count()
    tail = F.col("named").isNotNull()
    count = lambda where: F.count(F.when(where, 1))
    places = seen.where("piece is not null").groupBy("piece").agg(F.approx_count_distinct("who").alias("senders"), count(~tail).alias("behind"), count(tail).alias("tails"), F.sum("named").alias("named"))
    # at most (pieces behind a rule or name, or at an end, of a mail) / CLOSING_SHARE can reach the support
    often = (F.col("behind") >= F.lit(max(CLOSING_LEAST, CLOSING_SHARE * n_mails))) | (F.col("tails") >= F.lit(max(TAIL_LEAST, TAIL_SHARE * n_mails)))
    frequent = places.where(often & (F.col("senders") >= SENDERS_LEAST)).collect()
    spark = items.sparkSession
    wanted = spark.createDataFrame([(_bucket(r["piece"]),) for r in frequent], "par bigint").distinct()  # no more than these
    before = {r["par"]: r["n"] for r in seen.where("before is not null").join(F.broadcast(wanted), "par").groupBy("par").agg(F.sum("before").alias("n")).collect()}
    entries = sorted(r["piece"] for r in frequent if closes(r["behind"], r["tails"], r["named"] or 0, before.get(_bucket(r["piece"]), 0), n_mails))

    seen = seen.where("item_id is not null")
    first = seen.groupBy("thread", "par").agg(F.min(F.struct("seq", "whole")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = cut(
        seen.join(first, ["thread", "par"]).where((F.col("f.whole") != F.col("whole")) & (F.col("f.seq") < F.col("seq"))).groupBy("item_id").agg(F.collect_set("par").alias("ancestors"))
    )  # a set holds paragraphs of one mail
    n_later = later.limit(MAX_BROADCAST + 1).count()
    if n_later:
        rows = rows.join(F.broadcast(later) if n_later <= MAX_BROADCAST else later, "item_id", "left")
    else:
        rows = rows.withColumn("ancestors", F.lit(None).cast("array<bigint>"))

    last = seen.where("closing is not null").select("item_id", "thread", "whole", "who", "closing")
    own = last.groupBy("who", "closing").agg(F.countDistinct("whole").alias("mails"), F.countDistinct("thread").alias("threads"))
    own = own.where((F.col("mails") >= SENDER_LEAST) & (F.col("threads") >= SENDER_LEAST)).select("who", "closing")
    closed = cut(last.join(own, ["who", "closing"]).select("item_id").distinct().withColumn("closing", F.lit(True)))
    n_closed = closed.limit(MAX_BROADCAST + 1).count()
    rows = rows.join(F.broadcast(closed) if n_closed <= MAX_BROADCAST else closed, "item_id", "left") if n_closed else rows.withColumn("closing", F.lit(False))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closings = Closings(entries)
        for batch in batches:
            ids, numbers = [], []
            for item, text, ancestors, closing in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for k in new_lines(read(text), closings, set(ancestors or ()), bool(closing)):
                    ids.append(item)
                    numbers.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], names=["item_id", "line_no"])

    return rows.select("item_id", "text", "ancestors", "closing").mapInArrow(lines, "item_id bigint, line_no bigint")
