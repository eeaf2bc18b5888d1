"""Known-file sets: exact joins of digests with imported hash sets. Nothing here drops rows of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselode.functions.scalars import normalise_hash

#: A label comes from the strongest digest that matches.
PRIORITY = ("sha256", "sha1", "md5")


def import_hashes(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(algo, hash) without repeats of a hash list's lines, and one row with the number of unreadable lines.

    A line's first word counts; blank lines and those beginning # are skipped.
    """
    words = lines.select(F.split(F.trim(column), r"\s+").getItem(0).alias("w")).where("w <> '' and w not like '#%'").select(normalise_hash(F.col("w")).alias("h"))
    return words.where("h is not null").select("h.*").distinct(), words.agg(F.count_if(F.col("h").isNull()).alias("skipped"))


def unpivot_hashes(df: DataFrame) -> DataFrame:
    """(algo, hash) of the columns that name an algorithm, letter case and - ignored."""
    names = {c.lower().replace("-", ""): c for c in df.columns}
    columns = [names[a] for a in ("md5", "sha1", "sha256") if a in names]
    if not columns:
        raise ValueError("no column names md5, sha1 or sha256")
    return df.select(F.explode(F.array(*[normalise_hash(F.col(f"`{c}`")) for c in columns])).alias("h")).where("h is not null").select("h.*").distinct()


def set_totals(hash_set: DataFrame) -> DataFrame:
    """Hashes in all visible sets; 0 if there are none."""
    return hash_set.where(~F.col("name").startswith("~staging~")).agg(F.coalesce(F.sum("n_hashes"), F.lit(0)).alias("total"))


def orphans(known_hash: DataFrame, hash_set: DataFrame) -> DataFrame:
    """Hashes whose set is gone."""
    return known_hash.join(hash_set.select(F.col("id").alias("set_id")), "set_id", "left_anti")


def sweep_orphans(known_hash: DataFrame, hash_set: DataFrame) -> DataFrame:
    return known_hash.join(hash_set.select(F.col("id").alias("set_id")), "set_id", "left_semi")


def label_files(files: DataFrame, known_hash: DataFrame, hash_set: DataFrame) -> DataFrame:
    """files with ``label``: the name of the set that knows the file, by the strongest digest, the smallest set id among equals.

    Each digest is one equi-join against one row for each hash, so files are never repeated.
    Unfinished sets (staging) are invisible. Files without digests get NULL.
    """
    visible = hash_set.where(~F.col("name").startswith("~staging~")).select(F.col("id").alias("set_id"), "name")
    # sets that are not visible must not hide visible ones
    one = known_hash.join(visible, "set_id").groupBy("algo", "hash").agg(F.min(F.struct("set_id", "name")).alias("s"))
    out = files
    found = []
    for algo in PRIORITY:
        if algo in files.columns:
            part = one.where(F.col("algo") == algo).select(F.col("hash").alias(algo), F.col("s.name").alias(f"__{algo}"))
            out = out.join(part, algo, "left")
            found.append(F.col(f"__{algo}"))
    label = F.coalesce(*found) if found else F.lit(None).cast("string")
    return out.withColumn("label", label).select(*[F.col(f"`{c}`") for c in files.columns], "label")


def hide_known_counted(hits: DataFrame, known_paths: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What hide_known shows, and one row with the number of hits that it hides: a filtered list is never taken for the whole."""
    hidden = hits.join(known_paths.select(*keys).distinct(), keys, "left_semi")
    return hide_known(hits, known_paths, keys), hidden.agg(F.count(F.lit(1)).alias("hidden"))


def hide_known(hits: DataFrame, known_paths: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose container is not a known file; ``known_paths`` has the keys."""
    return hits.join(known_paths.select(*keys).distinct(), keys, "left_anti")
