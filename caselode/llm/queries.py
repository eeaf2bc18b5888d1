"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions.digests import WORDS, digest_columns, digest_distance
from caselode.llm import frequent, mixing, mojibake, neardup, newtext, packing, sentences, tokens
from caselode.session import cut
from caselode.sources.tables import table

#: Share of the sum over all findings from which a value counts as frequent.
FREQUENT_SHARE = 0.003


def indicator(column: str = "value"):
    """The indicator without outer white space, in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_copies(table(spark, d, "files"))


def p3_frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_items(table(spark, d, "findings"), indicator(), ["subtype"], F.col("count"), share=FREQUENT_SHARE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_frequent(spark, d).select("subtype", "value")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 heaviest indicators with their exact counts (ties with the last kept)."""
    return frequent.frequent_items(table(spark, d, "findings"), indicator(), ["subtype"], F.col("count"), k=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_texts(table(spark, d, "artifact_items")).select("item_id")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the garbled items, read back where possible."""
    return mojibake.garbled_texts(table(spark, d, "artifact_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.newly_written(table(spark, d, "artifact_items"), mojibake.utf8_lines)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", "source"))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    """Where every document (or piece of one larger than the pack) lies, for each capacity."""
    return packing.pack_all(_sizes(spark, d), table(spark, d, "pack_sizes")).withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Packs used against the least possible number, the room left, and what the configuration program did."""
    return packing.pack_report(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each occurs."""
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares really reached, and how far tokens and documents lie from the plan."""
    return mixing.mix_report(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Pairs found that are no near copies of one image by the published distance, or equal in content."""
    f = table(spark, d, "files").where("tlsh is not null").select("id", "evidence_id", F.lower("sha256").alias("sha"), *[c.alias(n) for n, c in digest_columns(F.col("tlsh")).items()]).dropDuplicates(["id"])
    side = lambda s: f.select(*[F.col(c).alias(f"{c}_{s}") for c in f.columns])
    both = p2_found(spark, d).join(side("a"), "id_a").join(side("b"), "id_b")
    far = digest_distance(*({n: F.col(f"{n}_{s}") for n in (*WORDS, "hd")} for s in "ab"))
    return both.agg(F.count_if((far > 40) | (F.col("evidence_id_a") != F.col("evidence_id_b")) | (F.col("sha_a") == F.col("sha_b")) | (F.col("id_a") >= F.col("id_b"))).alias("wrong"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: documents placed, packs beyond their capacity, and documents divided without need."""
    packs = cut(p6_packs(spark, d))
    over = packs.groupBy("pack_name", "capacity_tokens", "pack_no").agg(F.sum("n_tokens").alias("n")).groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    docs = packs.groupBy("pack_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    once = docs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))).alias("divided"))
    return once.join(over, "pack_name").select("pack_name", "documents", "overfull", "divided")


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """By source: whether no document is used more often than allowed."""
    return p7_report(spark, d).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every text put together, without white space: none of the text is lost or taken twice."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    spans = p8_found(spark, d).join(docs, "doc_id").select("doc_id", "start_pos", F.substring("text", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "s"))), lambda x: x["s"])  # one text's sentences
    return spans.groupBy("doc_id").agg(F.md5(F.regexp_replace(F.concat_ws("", parts), _BLANK, "").cast("binary")).alias("digest"))


_BLANK = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}\x{2028}\x{2029}\x{1680}\x{1c}-\x{1f}]+"
_WEIGHED = r"""select subtype, lower(regexp_replace(value, '^\s+|\s+$', '', 'g')) as value, cast(sum(greatest(coalesce("count", 1), 0)) as bigint) as total
    from findings where value is not null group by 1, 2"""


def queries() -> dict:
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_frequent": p3_frequent, "p3_top": p3_top, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p6_packs": p6_packs, "p6_report": p6_report, "p7_mixture": p7_mixture, "p7_report": p7_report, "p8_found": p8_found, "p2_check": p2_check, "p6_check": p6_check, "p7_check": p7_check, "p8_check": p8_check}


def oracle_sql() -> dict[str, str]:
    whole = f"(select {FREQUENT_SHARE} * sum(greatest(coalesce(\"count\", 1), 0)) from findings)"
    return {
        "p3_found": f"select subtype, value from ({_WEIGHED}) where total >= {whole}",
        "p3_frequent": f"select subtype, value, total from ({_WEIGHED}) where total >= {whole}",
        "p2_check": "select cast(0 as bigint) as wrong",
        "p6_check": "select pack_name, (select count(*) from documents) as documents, cast(0 as bigint) as overfull, cast(0 as bigint) as divided from pack_sizes",
        "p7_check": "select source, true as within from mix_targets",
        "p8_check": f"select doc_id, md5(regexp_replace(text, '{_BLANK}', '', 'g')) as digest from documents where regexp_replace(text, '{_BLANK}', '', 'g') <> ''",
        "p3_top": f"select subtype, value, total from ({_WEIGHED}) qualify rank() over (order by total desc) <= 20",
    }
