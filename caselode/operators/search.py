"""Search over index documents: keyword with relevance, regular expression, substring, digest prefix, similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions.digests import WORDS, digest_columns, digest_distance
from caselode.functions.scalars import composed, normalise_query, tokens

#: Published defaults of the relevance formula.
K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, evidence: str, text: str) -> DataFrame:
    """evidence, doc, term, tf, dl: one row for each term of a document."""
    t = docs.select(F.col(evidence).alias("evidence"), F.col(doc).alias("doc"), tokens(composed(F.col(f"`{text}`"))).alias("terms")).withColumn("dl", F.size("terms"))
    return t.select("evidence", "doc", "dl", F.explode("terms").alias("term")).groupBy("evidence", "doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """evidence, term, df: documents of an evidence item that hold the term."""
    return posts.groupBy("evidence", "term").agg(F.count(F.lit(1)).alias("df"))


def query_words(query: str) -> list[str]:
    """The terms of a query, as the index has them."""
    return sorted({w for w in re.split(r"[\W_]+", normalise_query(query)) if w and len(w.encode()) < 40})


def keyword_search(docs: DataFrame, doc: str, evidence: str, text: str, query: str, k: int = 50) -> DataFrame:
    """The k best documents for any of the query's words: evidence, doc, score rounded to 4 decimals.

    Statistics are those of each evidence item, as if each had its own index. Only documents with a
    query word are scored, and only the query's words are counted: the terms are filtered before
    they are exploded. An empty query finds nothing.
    """
    words = query_words(query)
    base = docs.select(F.col(evidence).alias("evidence"), F.col(doc).alias("doc"), tokens(composed(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("terms")).withColumn("dl", F.size("terms"))
    size = base.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = (
        base.select("evidence", "doc", "dl", F.explode(F.filter("terms", lambda t: t.isin(*words) if words else F.lit(False))).alias("term"))
        .groupBy("evidence", "doc", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = hits.groupBy("evidence", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(df, ["evidence", "term"]).join(size, "evidence").groupBy("evidence", "doc").agg(F.round(F.sum(part), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(k)


def keyword_fallback(docs: DataFrame, doc: str, evidence: str, text: str, query: str, k: int = 50) -> tuple[DataFrame, bool]:
    """As keyword_search; a query with blanks that finds nothing is tried again without them. The flag tells whether it was."""
    first = keyword_search(docs, doc, evidence, text, query, k)
    if " " not in query.strip() or first.limit(1).count():
        return first, False
    return keyword_search(docs, doc, evidence, text, query.replace(" ", ""), k), True


def checked_pattern(pattern: str) -> str:
    """The pattern if it has neither back references nor look-around, which make matching time explode."""
    if re.search(r"\\[1-9]|\(\?[=!<]", pattern):
        raise ValueError("back references and look-around are not allowed")
    re.compile(pattern)
    return pattern


def regex_search(docs: DataFrame, path: str, name: str, pattern: str) -> DataFrame:
    """Rows whose path, or a term of whose name, matches; letter case is ignored in names, ^ and $ stand for a term's ends."""
    p = checked_pattern(pattern)
    return docs.where(F.col(path).rlike(p) | F.exists(tokens(F.coalesce(F.col(name), F.lit(""))), lambda t: t.rlike("(?i)" + p)))


def name_search(docs: DataFrame, path: str, name: str, text: str) -> DataFrame:
    """Rows whose path, or a term of whose name, contains the text in lower case."""
    low = text.lower()
    return docs.where(F.exists(tokens(F.coalesce(F.col(name), F.lit(""))), lambda t: t.contains(low)) | F.lower(path).contains(low))


def digest_prefix(docs: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose digest begins so (pushed down to the scan)."""
    return docs.where(F.col(column).startswith(prefix.lower()))


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``.

    An aggregate with a partial step before the shuffle, so that a hot key leaves one row a task. Spark
    runs it as a sort aggregate, since whole rows are no fixed-width buffer: partitions are sorted by key, and spill.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(rest, F.struct(*order)).alias("__r"))
    return first.select(*[F.col("__r").getField(c).alias(c) for c in df.columns])


def union_hits(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All hits without repeats of ``keys``; earlier parts win."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(n))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, keys, [F.col("__part"), *map(F.col, order)]).drop("__part")


def similar_files(files: DataFrame, digest: str, most: int = 80, k: int = 300) -> DataFrame:
    """id, path, distance of the k files nearest to ``digest``, at most ``most`` away; a scan, as the digest is one."""
    spark = files.sparkSession
    q = spark.createDataFrame([(digest,)], "d string").select(*[c.alias(n) for n, c in digest_columns(F.col("d")).items()]).first()
    if q["hd"] is None:
        raise ValueError("malformed digest")
    query = {n: F.lit(q[n]).cast("int" if n == "hd" else "bigint") for n in (*WORDS, "hd")}
    # a generated row keeps the optimizer from writing the parsing out once for each use of a field
    rows = files.select("id", "path", F.inline(F.array(F.struct(*[c.alias(n) for n, c in digest_columns(F.col("tlsh")).items()])))).where("hd is not null")
    near = rows.select("id", "path", digest_distance({n: F.col(n) for n in (*WORDS, "hd")}, query).cast("int").alias("distance")).where(F.col("distance") <= most)
    return near.orderBy("distance", "id").limit(k)
