"""Findings: recording, filters, summaries, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions.patterns import indicators


def _like(text: str, escape: bool) -> str:
    return "%" + (text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else text) + "%"


def findings_filter(findings: DataFrame, kind: str | None = None, subtype: str | None = None, search: str | None = None, raw_like: bool = False) -> DataFrame:
    """Rows of the kind and subtype whose value contains ``search``, letter case ignored. % and _ are ordinary characters unless raw_like."""
    for name, value in (("kind", kind), ("subtype", subtype)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings if search is None else findings.where(F.col("value").ilike(_like(search, not raw_like)))


def carved_filter(files: DataFrame, search: str | None = None) -> DataFrame:
    """Carved files whose name or SHA-256 contains ``search``."""
    out = files.where(F.col("path").startswith("/(carved)/"))
    return out if search is None else out.where(F.col("name").ilike(_like(search, True)) | F.col("sha256").ilike(_like(search, True)))


def top(df: DataFrame, by: str, k: int, tie: str = "id") -> DataFrame:
    """The k rows of largest ``by``; ties go to the smaller ``tie``."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc()).limit(k)


def top_with_total(df: DataFrame, by: str, k: int, tie: str = "id") -> tuple[DataFrame, int]:
    """The k first rows and how many there are without the limit."""
    return top(df, by, k, tie), df.count()


def findings_summary(findings: DataFrame) -> DataFrame:
    """Sum of counts by kind and subtype."""
    return findings.groupBy("kind", "subtype").agg(F.sum("count").alias("total"))


def known_counts(files: DataFrame) -> DataFrame:
    """Files with a known label and files with a digest, in one pass."""
    filled: Column = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return files.agg(F.count_if(filled("known_set")).alias("known"), F.count_if(filled("sha256")).alias("hashed"))


def indicator_findings(docs: DataFrame, text: str, evidence: str, position: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """evidence, kind 'ioc', subtype, value, count, first_offset over the texts: one row for each value of an evidence item."""
    hits = indicators(docs, text, evidence, position, **({"kinds": kinds} if kinds else {}))
    return (
        hits.groupBy(evidence, F.col("kind").alias("subtype"), "value")
        .agg(F.count(F.lit(1)).alias("count"), F.min(position).alias("first_offset"))
        .select(evidence, F.lit("ioc").alias("kind"), "subtype", "value", "count", "first_offset")
    )


def capped(df: DataFrame, order: list[str], most: int, weight: str = "count") -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows in ``order``, and one row telling whether rows were cut and what weight they had."""
    kept = df.orderBy(*order).limit(most)
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("w"))
    part = kept.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("k"))
    return kept, whole.crossJoin(part).select((F.col("n") > most).alias("truncated"), (F.col("w") - F.col("k")).alias("dropped"))  # one row each
