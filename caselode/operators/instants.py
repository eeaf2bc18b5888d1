"""One unambiguous instant for header dates and file times (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.functions.times import epoch_seconds, epoch_unit, in_range, let, utc_seconds, wall_instant

DATE_FIELDS = ("AcquiredDate", "SystemDate")


def _one_zone(df: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """One row per key; its zone is NULL where the rows disagree."""
    return df.groupBy(*keys).agg(F.when(F.min(zone) == F.max(zone), F.min(zone)).alias("tz"))


def header_instants(case_metadata: DataFrame, examiner_zone: DataFrame, fields: tuple[str, ...] = DATE_FIELDS) -> DataFrame:
    """meta_id, utc_s of every header row of ``fields`` that denotes exactly one instant.

    The default zone is that of the image set's examiner (outer blanks and case ignored). No zone:
    no examiner row, an unknown examiner, NULL or empty names, or examiners of differing zones for
    one image set. Repeated rows come out once each. Empty tables give an empty result.
    """
    key = F.lower(F.trim(F.regexp_replace("examiner", r"\s+", " ")))
    zones = _one_zone(examiner_zone.select(key.alias("who"), "tz").where("who is not null and tz is not null"), ["who"], "tz")
    named = (
        case_metadata.where(F.col("metadata_field") == "ExaminerName")
        .select("image_set", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("who"))
        .where("image_set is not null and who <> ''")
        .distinct()
    )
    # an unknown second examiner makes the zone uncertain as well
    sets = named.join(zones, "who", "left").groupBy("image_set").agg(
        F.when((F.min("tz") == F.max("tz")) & (F.count("tz") == F.count(F.lit(1))), F.min("tz")).alias("tz")
    )
    dates = case_metadata.where(F.col("metadata_field").isin(*fields)).select("meta_id", "image_set", "value")
    return dates.join(sets, "image_set", "left").select("meta_id", utc_seconds(F.col("value"), F.col("tz")).alias("utc_s")).where("utc_s is not null")


def file_instants(files: DataFrame, volume_clock: DataFrame, column: str = "mtime") -> DataFrame:
    """id, utc_s of every file row whose ``column`` is not already Unix seconds in UTC and denotes one instant.

    The unit follows from the magnitude. On a volume of ``volume_clock`` (or a snapshot of it) the
    number is the local wall clock and goes through the zone. NULL, NaN and values outside every
    unit's window are no case; nor are wall-clock readings shown twice or never, or volumes listed
    with two zones or an unknown one.
    """
    clocks = _one_zone(volume_clock.select("evidence_id", F.col("volume_label").alias("volume"), "tz"), ["evidence_id", "volume"], "tz").withColumn("local", F.lit(True))
    x = F.col(f"`{column}`")
    rows = files.select("id", "evidence_id", F.split("volume_label", "/").getItem(0).alias("volume"), F.col(f"`{column}`").alias("t")).where(~F.isnan("t") & epoch_unit(F.col("t")).isNotNull())

    def instant(c):
        seconds = epoch_seconds(F.floor(c["t"]).cast("bigint"), c["unit"])
        return F.when(c["local"].isNotNull(), let(seconds, lambda s: wall_instant(s, c["tz"]))).when(c["unit"] != "unix_s", seconds)

    fields = F.struct("t", epoch_unit(F.col("t")).alias("unit"), "local", "tz")
    return (
        rows.join(clocks, ["evidence_id", "volume"], "left")
        .select("id", let(fields, lambda c: let(instant(c), in_range)).alias("utc_s"))
        .where("utc_s is not null")
    )


def instants(case_metadata: DataFrame, examiner_zone: DataFrame, files: DataFrame, volume_clock: DataFrame) -> DataFrame:
    """rec_table, rec_id, utc_s over both tables."""
    a = header_instants(case_metadata, examiner_zone).select(F.lit("case_metadata").alias("rec_table"), F.col("meta_id").alias("rec_id"), "utc_s")
    b = file_instants(files, volume_clock).select(F.lit("files").alias("rec_table"), F.col("id").alias("rec_id"), "utc_s")
    return a.unionByName(b)
