"""Scalar functions, indicators, rules and search against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselode.functions import patterns, scalars
from caselode.functions.digests import WORDS, digest_columns, digest_distance
from caselode.operators import findings, known, rules, search

TEXT = """mail a.b@c-d.org or x@y, http://h.example/p?q=1, 10.0.0.1 and 1.2.3.4.5, 256.1.1.1, host.co.uk, fe80:0:0:1::, 2001:db8:1:2:3:4:5:6,
02:74:37:8a:8b:d8, card 4111 1111 1111 1111 and 4111 1111 1111 1112, call +49 30 1234567 or 0000 123456 or 1111111111,
1BoatSLRHtKNngkdXEeobR76b53LETtpyT bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq """ + "a" * 56 + ".onion"


def model(kind, text):
    out = re.findall("(?:" + patterns.PATTERNS[kind] + ")", text, re.ASCII)
    digits = lambda v: re.sub(r"\D", "", v)
    if kind == "phone":
        out = [v for v in out if 7 <= len(digits(v)) <= 15 and len(set(digits(v))) > 1 and not digits(v).startswith("0000")]
    if kind == "cc":

        def luhn(d):
            return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

        out = [v for v in out if 13 <= len(digits(v)) <= 19 and luhn(digits(v))]
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.:-+() @abcdef/xñ", max_size=60), min_size=20, max_size=40))
def test_indicators(spark, texts):
    texts = [TEXT, "", None, *texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r["i"], r["kind"], r["value"]) for r in patterns.indicators(df, "t", "i").collect())
    assert got == sorted((i, k, v) for i, t in enumerate(texts) for k in patterns.KINDS for v in model(k, t or ""))


def test_all_kinds_occur(spark):
    df = spark.createDataFrame([(TEXT,)], "t string")
    assert {r["kind"] for r in patterns.indicators(df, "t").collect()} == set(patterns.KINDS)
    assert patterns.indicators(df, "t", kinds=("ipv4",), most=1).count() == 1


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, scalars.origin_of, "/(carved)/jpeg/0x1a2b3c") == "carved"
    assert one(spark, scalars.origin_of, "/(raw)/0x0") == "raw/unalloc"
    assert one(spark, scalars.origin_of, "/a/b.pst#Inbox/msg_1") == "in container"
    assert one(spark, scalars.origin_of, "/Windows/x.dll") == "file"
    assert [one(spark, scalars.csv_safe, v) for v in ("=1", "+1", "-1", "@a", "\ta", "\ra", "a", None)] == ["'=1", "'+1", "'-1", "'@a", "'\ta", "'\ra", "a", None]
    assert [one(spark, scalars.segment_index, v) for v in (".E01", "EAA", "Ex01", "L99", "EBA", "t1x", "E1")] == [1, 100, 1, 99, 126, -1, -1]
    assert spark.range(1).select(scalars.expected_extension(F.lit(100), F.lit("E")).alias("a"), scalars.expected_extension(F.lit(7), F.lit("E")).alias("b")).first() == ("EAA", "E07")
    assert one(spark, scalars.normalise_hash, " 'AB" + "0" * 30 + "' ") == ("md5", "ab" + "0" * 30)
    assert one(spark, scalars.normalise_hash, "xyz") is None
    assert one(spark, scalars.filetime_to_unix, 116444736010000000, "bigint") == pytest.approx(1.0)
    assert one(spark, scalars.filetime_to_unix, 0, "bigint") is None
    assert one(spark, scalars.nanos_to_unix, 1_500_000_000_000_000_000, "bigint") == 1.5e9
    assert [one(spark, scalars.header_date, v) for v in ("1319391001", "1319391001000", "2011 10 3 1 2 3", "n/a", None)] == ["2011-10-23 17:30:01 UTC", "2011-10-23 17:30:01 UTC", "2011-10-03 01:02:03", "n/a", ""]
    assert [one(spark, scalars.size_text, v, "bigint") for v in (None, 0, 12, 2048, 5 << 30)] == ["", "", "12 B", "2.00 KB", "5.00 GB"]
    assert one(spark, scalars.safe_name, "C:\\a\\b?.txt") == "b_.txt" and one(spark, scalars.safe_name, "/") == "export.bin"
    assert one(spark, scalars.tidy_text, " a\u00a0\t b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, scalars.tokens, "Ab-c Déjà 12") == ["ab", "c", "déjà", "12"]
    assert scalars.normalise_query(unicodedata.normalize("NFD", "É")) == "é"
    assert [one(spark, scalars.composed, v) for v in (unicodedata.normalize("NFD", "Élan"), "Élan", "plain", None)] == ["Élan", "Élan", "plain", None]
    want = int.from_bytes(hashlib.blake2b(b"a\x1fb", digest_size=8).digest(), "big") & (2**63 - 1)
    assert spark.range(1).select(scalars.stable_doc_id(F.lit("a"), F.lit("b")).alias("x")).first()["x"] == want


def distance_model(a, b):
    def parse(t):
        t = t.upper().removeprefix("T1")
        sw = lambda x: int(x[::-1], 16)
        codes = [int(t[6:], 16) >> 2 * i & 3 for i in range(128)]
        return sw(t[0:2]), sw(t[2:4]), sw(t[4:6]), codes

    (ca, la, qa, xa), (cb, lb, qb, xb) = parse(a), parse(b)
    ring = lambda p, q, n: min(abs(p - q), n - abs(p - q))
    d = ring(la, lb, 256)
    out = d if d <= 1 else 12 * d
    for s in (0, 4):
        d = ring(qa >> s & 15, qb >> s & 15, 16)
        out += d if d <= 1 else 12 * (d - 1)
    return out + (ca != cb) + sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(p - q)] for p, q in zip(xa, xb, strict=True))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("0123456789abcdefABCDEF", min_size=70, max_size=70), st.text("0123456789abcdef", min_size=70, max_size=70)), min_size=10, max_size=20))
def test_digest_distance(spark, pairs):
    pairs = [*pairs, ("T1" + pairs[0][0], pairs[0][0])]
    df = spark.createDataFrame(pairs, "a string, b string")
    side = lambda c: {k: v for k, v in digest_columns(F.col(c)).items()}
    cols = df.select("a", "b", *[v.alias("a" + k) for k, v in side("a").items()], *[v.alias("b" + k) for k, v in side("b").items()])
    names = (*WORDS, "hd")
    got = cols.select("a", "b", digest_distance({n: F.col("a" + n) for n in names}, {n: F.col("b" + n) for n in names}).alias("d")).collect()
    assert [r["d"] for r in got] == [distance_model(r["a"], r["b"]) for r in got]


def test_rules(spark):
    pe = b"MZ" + b"\0" * 58 + (64).to_bytes(4, "little") + b"PE\0\0"
    data = [(1, b"x -----BEGIN PRIVATE KEY----- y"), (2, b"AKIA" + b"A" * 16), (3, pe), (4, b"\x7fELF.."), (5, b"Bitcoin wallet.DAT"), (6, b"bitcoin"), (7, b"SMTP_Password"), (8, b""), (9, None), (10, b"xMZ"), (11, b"MZ short")]
    df = spark.createDataFrame(data, "i int, content binary")
    got = {(r["i"], r["rule"]) for r in rules.rule_matches(df, "content", "i").collect()}
    assert got == {(1, "Contains_Private_Key"), (2, "Contains_AWS_Key"), (3, "Windows_PE_Executable"), (4, "ELF_Executable"), (5, "Bitcoin_Wallet_Strings"), (7, "Email_Credentials_Config")}
    with pytest.raises(ValueError, match="Odd"):
        rules.rule_matches(df, "content", "i", rules='rule Odd {\n strings: $a = "x"\n condition: #a > 3\n}')


def test_known(spark):
    files = spark.createDataFrame([(1, "m1", "s1"), (2, "m2", None), (3, None, "s3"), (4, None, None), (5, "m5", "s1")], "id int, md5 string, sha256 string")
    sets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "~staging~x")], "id bigint, name string")
    hashes = spark.createDataFrame([(2, "sha256", "s1"), (1, "md5", "m1"), (1, "sha256", "s1"), (2, "md5", "m2"), (3, "sha256", "s3"), (9, "md5", "m5")], "set_id bigint, algo string, hash string")
    got = {r["id"]: r["label"] for r in known.label_files(files, hashes, sets).collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None, 5: "a"}
    assert known.orphans(hashes, sets).count() == 1 and known.sweep_orphans(hashes, sets).count() == 5
    lines = spark.createDataFrame([("# note",), ("AB" + "0" * 30 + "  file",), ("ab" + "0" * 30,), ("nonsense",), ("",), (None,)], "value string")
    got, bad = known.import_hashes(lines)
    assert [tuple(r) for r in got.collect()] == [("md5", "ab" + "0" * 30)] and bad.first()["skipped"] == 1


def test_findings(spark):
    f = spark.createDataFrame([(1, 1, "ioc", "email", "a%b", 5), (2, 1, "ioc", "email", "AxB", None), (3, 2, "yara", "r", "A_b", 5)], "id bigint, evidence_id bigint, kind string, subtype string, value string, count bigint")
    assert {r["id"] for r in findings.findings_filter(f, search="A%B").collect()} == {1}
    assert {r["id"] for r in findings.findings_filter(f, search="a%b", raw_like=True).collect()} == {1, 2, 3}
    top, total = findings.top_with_total(f, "count", 2)
    assert [r["id"] for r in top.collect()] == [1, 3] and total == 3
    kept, cut = findings.capped(f, ["id"], 1)
    assert kept.count() == 1 and tuple(cut.first()) == (True, 5)


def test_search(spark):
    docs = spark.createDataFrame([(1, "e1", "Alpha beta beta"), (2, "e1", "gamma"), (3, "e2", "beta"), (4, "e2", None), (5, "e2", "")], "id bigint, ev string, text string")
    got = [r["doc"] for r in search.keyword_search(docs, "id", "ev", "text", "BETA zeta").collect()]
    assert sorted(got) == [1, 3]
    assert search.keyword_search(docs, "id", "ev", "text", "  ").count() == 0
    found, again = search.keyword_fallback(docs, "id", "ev", "text", "gam ma")
    assert again and [r["doc"] for r in found.collect()] == [2]
    with pytest.raises(ValueError):
        search.checked_pattern(r"(a)\1")
    paths = spark.createDataFrame([(1, "/a/Report-final.txt", "Report-final.txt"), (2, "/b/x", "x")], "id int, path string, name string")
    assert [r["id"] for r in search.regex_search(paths, "path", "name", "^REPORT$").collect()] == [1]
    assert [r["id"] for r in search.name_search(paths, "path", "name", "POR").collect()] == [1]
    dup = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c")], "k string, o int, v string")
    assert sorted(r["v"] for r in search.keep_first(dup, ["k"], [F.col("o")]).collect()) == ["a", "c"]


def test_header_date_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, scalars.header_date, "1319391001") == "2011-10-23 17:30:01 UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
