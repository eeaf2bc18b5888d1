"""Timestamp normalisation against a plain Python reading with zoneinfo."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselode.functions.times import utc_seconds, wall_instant
from caselode.operators.instants import file_instants, header_instants

CASES = [
    ("2010-01-19 09:15:28.196", "UTC", 1263892528),
    ("2010-01-19T20:48:18.999Z", None, 1263934098),
    ("20100313021327+0100 ", None, 1268442807),
    ("20100214T060702Z", None, 1266127622),
    ("01.06.2020 05:43:30", "Europe/Berlin", 1590983010),
    ("1264432087230364", None, 1264432087),
    ("129074461120535327", None, 1262972512),
    ("1269737993909", None, 1269737993),
    ("April 12, 2016 04:28:03", "Asia/Tokyo", 1460402883),
    ("2010-03-12 23:43:16 Europe/London", "Asia/Tokyo", 1268437396),
    ("2010-03-04T07:16+01:00", None, 1267683360),
    ("Fri Aug 16 14:09:56 2024", "UTC", 1723817396),
    ("Thu Aug 16 14:09:56 2024", "UTC", None),  # weekday and date disagree
    ("01-Jul-2017 04:02:54 PDT", None, 1498906974),
    ("01-May-2018 21:06:47 +05:30", None, 1525189007),
    ("1/12/2010 4:26:24 PM", "UTC", 1263313584),
    ("1/12/2010 12:26:24 AM", "UTC", 1263255984),
    ("1/12/2010 0:26:24 AM", "UTC", None),
    ("2019 13 1 25 61 0", "UTC", None),
    ("2010 3 28 2 31 12", "Europe/Berlin", None),  # never shown
    ("2010 10 31 2 31 12", "Europe/Berlin", None),  # shown twice
    ("2010 10 31 2 31 12", "UTC", 1288492272),
    ("2009-01", "UTC", None),
    ("99999999999999", "UTC", None),
    ("0", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("unknown", "UTC", None),
    ("1989-12-31 23:59:59 UTC", None, None),
    ("2010-01-19 09:15:28", None, None),
    ("2010-01-19 09:15:28", "Mars/Base", None),
    ("2010-01-19 23:59:60", "UTC", None),
    ("2010-01-19 24:00:00", "UTC", None),
    ("2010-02-30 01:00:00", "UTC", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_cascade(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
        got = {r["i"]: r["t"] for r in df.select("i", utc_seconds(F.col("v"), F.col("z")).alias("t")).collect()}
        assert [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]] == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def model(wall: int, zone: str):
    naive, z = datetime(1970, 1, 1) + timedelta(seconds=wall), ZoneInfo(zone)
    at = {naive.replace(tzinfo=z, fold=f).astimezone(UTC) for f in (0, 1)}
    at = [a for a in at if a.astimezone(z).replace(tzinfo=None) == naive]
    return int(at[0].timestamp()) if len(at) == 1 else None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(700_000_000, 2_000_000_000), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Los_Angeles"])), min_size=50, max_size=80))
def test_wall_clock(spark, cases):
    # around the changes of 2015 as well
    cases = cases + [(1427592600 + 1800 * k, "Europe/Berlin") for k in range(12)] + [(1445731200 + 1800 * k, "Europe/Berlin") for k in range(12)]
    df = spark.createDataFrame([(i, w, z) for i, (w, z) in enumerate(cases)], "i int, w bigint, z string")
    got = {r["i"]: r["t"] for r in df.select("i", wall_instant(F.col("w"), F.col("z")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [model(w, z) for w, z in cases]


def test_files(spark):
    files = spark.createDataFrame(
        [(1, 1, "v1", 1.5e9), (2, 1, "v1", 1.5e12), (3, 1, "v1", 1.5e15), (4, 1, "v1", 1.5e18), (5, 1, "v1", 1.3e17), (6, 1, "v2", 1.5e9), (7, 1, "v2/vss1", 1.5e9), (8, 1, "v3", 1.5e9), (9, 1, "v4", 1.5e9),
         (10, 1, None, 1.5e12), (11, None, "v1", 1.5e12), (12, 1, "v1", None), (13, 1, "v1", float("nan")), (14, 1, "v1", 1e30), (15, 1, "v1", -1.0), (16, 1, "v2", 1.5e12)],
        "id bigint, evidence_id bigint, volume_label string, mtime double",
    ).withColumn("tz", F.lit("clash"))
    clock = spark.createDataFrame([(1, "v2", "Europe/Berlin"), (1, "v2", "Europe/Berlin"), (1, "v3", "Nowhere/At_All"), (1, "v4", "UTC"), (1, "v4", "Asia/Tokyo")], "evidence_id bigint, volume_label string, tz string")
    got = {r["id"]: r["utc_s"] for r in file_instants(files, clock).collect()}
    ms = 1_500_000_000
    assert got == {2: ms, 3: ms, 4: ms, 5: 1_355_526_400, 6: ms - 7200, 7: ms - 7200, 10: ms, 11: ms, 16: ms - 7200}


def test_headers(spark):
    rows = [
        (1, "a", "ExaminerName", "  B. JONES "), (2, "a", "AcquiredDate", "2010 1 5 10 0 0"), (3, "a", "AcquiredDate", "2010 1 5 10 0 0"), (4, "b", "AcquiredDate", "2010 1 5 10 0 0"),
        (5, "c", "ExaminerName", "nobody"), (6, "c", "SystemDate", "2010 1 5 10 0 0"), (7, None, "SystemDate", "2010-01-05T10:00:00Z"), (8, "a", "SystemDate", None), (9, "a", "Notes", "2010 1 5 10 0 0"),
        (10, "d", "ExaminerName", "B. Jones"), (11, "d", "ExaminerName", "A. Berg"), (12, "d", "SystemDate", "2010 1 5 10 0 0"),
    ]
    meta = spark.createDataFrame(rows, "meta_id bigint, image_set string, metadata_field string, value string").withColumn("tz", F.lit("clash"))
    zones = spark.createDataFrame([("B. Jones", "Asia/Tokyo"), ("A. Berg", "Europe/Berlin"), (None, "UTC")], "examiner string, tz string")
    at = 1262653200
    assert {r["meta_id"]: r["utc_s"] for r in header_instants(meta, zones).collect()} == {2: at, 3: at, 7: at + 9 * 3600}
    assert header_instants(meta.limit(0), zones).count() == 0
    assert header_instants(meta, zones.limit(0)).count() == 1
