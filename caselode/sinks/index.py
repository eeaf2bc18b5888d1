"""A written inverted index: postings by evidence item, sorted by term, with document and collection sizes.

Files are laid out so that a query reads the row groups of its terms only (terms are sorted within
files, and parquet keeps their minima and maxima). Ranges of (evidence, term) keep a large item from meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions.scalars import composed, tokens
from caselode.operators.search import B, K1, postings, query_words


def write_index(docs: DataFrame, path: str, doc: str, evidence: str, text: str, mode: str = "overwrite") -> None:
    """postings and sizes under ``path``. mode 'append' adds further evidence items; one that is indexed already is an error, as its terms would count twice."""
    if mode == "append":
        there = docs.sparkSession.read.parquet(f"{path}/sizes").select(F.col("evidence").cast("string"))
        again = docs.select(F.col(evidence).cast("string").alias("evidence")).distinct().join(there, "evidence", "left_semi").take(1)
        if again:
            raise ValueError(f"{again[0]['evidence']} is in the index already")
    posts = postings(docs.where(F.col(f"`{text}`").isNotNull()), doc, evidence, text)
    posts.repartitionByRange("evidence", "term").sortWithinPartitions("evidence", "term").write.mode(mode).partitionBy("evidence").parquet(f"{path}/postings")
    sizes = docs.select(F.col(evidence).alias("evidence"), F.size(tokens(composed(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).alias("dl")).groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    sizes.write.mode(mode).parquet(f"{path}/sizes")


def doc_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: documents and evidence items of the index."""
    return spark.read.parquet(f"{path}/sizes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.countDistinct("evidence").alias("items"))


def search_index(spark: SparkSession, path: str, query: str, k: int = 50) -> DataFrame:
    """evidence, doc, score: as keyword_search, from the index. An empty query finds nothing."""
    words = query_words(query)
    hits = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(*words) if words else F.lit(False)).withColumn("evidence", F.col("evidence").cast("string"))
    sizes = spark.read.parquet(f"{path}/sizes").withColumn("evidence", F.col("evidence").cast("string"))
    df = hits.groupBy("evidence", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(df, ["evidence", "term"]).join(sizes, "evidence").groupBy("evidence", "doc").agg(F.round(F.sum(part), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(k)
