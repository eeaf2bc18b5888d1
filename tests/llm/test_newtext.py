"""Newly written lines of hand-made mails."""

import random

from caselode.llm import newtext
from caselode.llm.newtext import LONG_ANCESTOR, Closings, compression_gain, new_lines, newly_written, parse_mail

HEAD = "RE: plan\nAnn Berg\nplan\nFrom: Ann Berg <a@b.test>\n\n"
LEGAL = "This footer belongs to every mail of the house and says nothing new to anybody."


def mail(body, head=HEAD):
    return head + body


MAILS = {
    1: (mail("Hi Bo,\n\nThe disk is sealed.\n\nThanks, Ann\n\nAnn Berg\nClerk, House Ltd.\nT +999 123 4567\n\nOn May 5, 2020, at 1:05 AM, Bo <bo@x.test> wrote:\n> Hi\n> > older\n"), ["Hi Bo,", "The disk is sealed.", "Thanks, Ann"]),
    2: (mail("> quoted first\n\nReply one.\n\n> quoted two\n\nReply two.\n-- \nAnn Berg\nClerk\n\n" + LEGAL), ["Reply one.", "Reply two."]),
    3: (mail("See below.\n\n-----Original Message-----\nFrom: Bo <bo@x.test>\nSent: May 5\nTo: Ann\nSubject: plan\n\nOld text.\n\nBo"), ["See below."]),
    4: (mail("Begin.\r\n\r\n________________________________\r\nDe: Bo <bo@x.test>\r\nEnviado: 5/5\r\nPara: Ann\r\nAsunto: plan\r\n\r\nViejo."), ["Begin."]),
    5: (mail("On Monday Bo wrote: the seal is fine. I disagree.\nFrom: what I saw, it is complete.\n____ is the field to fill in on page 3.\nSent from the desk to the vault: 9 boxes.\nTel. 9370 rang out twice.\n\nSent from my handset\n\n" + LEGAL),
        ["On Monday Bo wrote: the seal is fine. I disagree.", "From: what I saw, it is complete.", "____ is the field to fill in on page 3.", "Sent from the desk to the vault: 9 boxes.", "Tel. 9370 rang out twice."]),
    6: (mail("Le 5 mai 2020 à 1:05, Bo\n<bo@x.test> a écrit :\n| Vieux.\n\nNeuf."), ["Neuf."]),
    7: ("only a preamble\nAnn Berg", []),
    8: (mail(""), []),
    9: (mail("x " * 60_000), [("x " * 60_000)]),
}


def run(spark, rows):
    df = spark.createDataFrame(rows, "item_id bigint, container_path string, subpath string, text string, line_no string")
    out = {}
    for r in newly_written(df).collect():
        out.setdefault(r["item_id"], []).append(r["line_no"])
    return {k: sorted(v) for k, v in out.items()}


def others(n=48):
    """Mails of other senders, from which signatures, device tags and the house's footer are learned."""
    rng, rows = random.Random(5), []
    for k in range(n):
        who = f"{rng.choice(['Cy', 'Di', 'Ed', 'Flo', 'Gus'])} {rng.choice(['Dorn', 'Ems', 'Falk'])}{k % 7}"
        text = f"s{k}\n{who}\n\nHi all,\n\nNote {k} of {rng.choice(['the vault', 'a box', 'our list'])} is {rng.choice(['here', 'gone', 'late'])} {rng.choice(['now', 'again', 'still'])} as {who[:2]} said.\n\nThanks, {who.split()[0]}\n"
        text += f"\n{who}\n{'Clerk, House Ltd.' if k % 4 else 'Clerk'}\nT +999 {k} {k * 7}\n" if k % 2 else "\nSent from my handset\n"
        rows.append((1000 + k, f"/o{k}.pst", "Inbox/msg_0", text + (f"\n-----\n{LEGAL}\n" if k % 3 == 0 else ""), ""))
    return rows


def test_mails(spark):
    rows = others() + [(i, f"/c{i}.pst", f"Inbox/msg_{i}", t, "clash") for i, (t, _) in MAILS.items()]
    rows += [(200, "/e", "table:t", "x\n\ny", ""), (201, "/e", "Inbox/msg_1", None, ""), (202, None, "Inbox/msg_1", mail("No container."), ""), (203, "/e", "Inbox/msg_1", "", "")]
    got = run(spark, rows)
    for i, (text, want) in MAILS.items():
        lines = text.split("\n")
        assert [lines[k].rstrip("\r") for k in got.get(i, [])] == want, i
    assert all(got[r[0]] == [3, 5, 7] for r in others()) and set(got) - set(MAILS) - {r[0] for r in others()} == {202}


def learned():
    entries = ["Clerk", "House Ltd.", "T +0 0 0", LEGAL, "Sent from my handset"]
    return Closings(entries)


def test_compression_decides():
    """A line with a piece of a closing in it is taken without the gain, and kept with it."""
    text = "Then the lorry left. Please do not forget the other nine keys\nT +999 123 4567 is the number on the old blue crate, Clerk, House Ltd."
    parsed = parse_mail(mail("Begin.\n\n" + text + "\n\nAnn Berg\nClerk, House Ltd."))
    assert new_lines(parsed, learned(), set()) == [5, 7, 8]
    assert new_lines(parsed, Closings([]), set()) != [5, 7, 8]  # nothing learned: the signature stays
    lorry = parse_mail(mail("Begin.\n\nThen the lorry left the yard at noon with all of the boxes but one\nClerk"))
    assert new_lines(lorry, learned(), set(), gain=0.5) == [5, 7, 8] and new_lines(lorry, learned(), set(), gain=-99) == [5, 7]


def test_thread_ancestors(spark):
    par = "This whole paragraph was written by somebody else earlier in the thread and pasted without marks."
    assert len(par) >= LONG_ANCESTOR
    old = mail(par, "plan\nBo Kant\n\n")
    rows = [(1, "/c", "Inbox/msg_0", old, ""), (2, "/c", "Inbox/msg_3", mail("Mine.\n\n" + par), ""), (3, "/other", "Inbox/msg_3", mail("Mine.\n\n" + par), ""), (4, "/c", "Inbox/msg_5", old, "")]
    got = run(spark, rows)
    assert got[1] == [3] and got[4] == [3]  # an exact copy of a mail keeps its text
    assert got[2] == [5] and got[3] == [5, 7]


def test_empty(spark):
    assert run(spark, []) == {}


def test_parts():
    assert parse_mail("a\nb\n\nc").own == [(3, 4)] and parse_mail("").own == []
    text = "a rather long paragraph that stands in the dictionary as well, word for word"
    assert compression_gain(text, text) > 0.7 > 0.1 > compression_gain(text, "quite another thing altogether 123")


def test_large_dictionaries():
    """Neither the number of closings nor the length of a quoted history cuts a dictionary."""
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip()
    kept = "Zwölf Kartons stehen jetzt im Keller."
    closings = Closings([LEGAL.upper(), *(noise(200) for _ in range(2000))])
    body = mail(f"{kept}\n\n{LEGAL.upper()}\n\n{kept}\n{LEGAL.upper()}")
    assert new_lines(parse_mail(body), closings, set()) == [5, 9]
    for size in (30_000, 300_000):
        late = noise(size)
        for part in (late[:400], late[-400:]):
            assert new_lines(parse_mail(mail(kept + "\n\n" + part.strip() + "\n\n> " + late)), Closings([]), set()) == [5]


def test_wrapped_closing_is_covered():
    words = LEGAL.split()
    wrapped = " ".join(words[:8]) + "\n" + " ".join(words[8:])
    assert new_lines(parse_mail(mail("New.\n\n" + wrapped)), learned(), set()) == [5]


def test_phrases_are_no_closings():
    assert newtext.closes(40, 0, 0, 5, 1000) and not newtext.closes(40, 0, 0, 5000, 1000)
    assert newtext.closes(0, 40, 0, 50, 1000) and not newtext.closes(0, 40, 9, 50, 1000) and not newtext.closes(0, 40, 0, 500, 1000)


def test_sender_closings(spark):
    notice = "Our counter on the quay opens at {n} in the morning and closes when the last box is locked."
    note = "Box {n} went to the vault today, as agreed with the keeper."
    text = lambda k, who, end: f"s{k}\n{who}\n\nNote on {k}.\n\n{end}"
    rows = [(k, f"/c{k}", "Inbox/msg_0", text(k, "Ann Berg", notice.format(n=k)), "") for k in range(4)]
    rows += [(10 + k, f"/d{k}", "Inbox/msg_0", text(10 + k, "Bo Kant", note.format(n=k)), "") for k in range(2)]
    rows += [(20, "/e", "Inbox/msg_0", text(20, "Cy Dorn", notice.format(n=9)), "")]
    got = run(spark, rows)
    assert all(got[k] == [3] for k in range(4))  # recurs at the end of the sender's own mails
    assert all(got[k] == [3, 5] for k in (10, 11, 20))  # too rare, or another sender's
