"""Registered queries of the core package: name -> (spark, folder) -> DataFrame, and their SQL.

Every query runs over its whole tables. Where no SQL says the same (byte-level operators, custom
UDFs, streaming) none is given, and tests compare with a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.functions import extract, patterns, scalars
from caselode.operators import ingest as ingest_ops
from caselode.operators import audit, findings, instants, known, provenance, rules, search, snapshots
from caselode.plans import byte_queries
from caselode.plans.instants_sql import P1_FOUND
from caselode.session import cut, shared_folder, spread
from caselode.sources import segments
from caselode.sources.tables import table
from caselode.streaming import ingest

#: Parameters of the search queries.
WORDS = "server image checksum"
NAME_PART = "invoice"
PATH_PATTERN = r"(^LETTER$|\.ost$)"
PREFIX = "a1"
#: A rule whose strings occur in the texts.
USER_RULES = """
rule Long_Hash_Mention {
    meta: category = "hashes"
    strings:
        $a = /hash begins with [0-9a-f]{12}/
        $b = "carvex" nocase
    condition: $a or $b
}
rule Two_Tools {
    meta: category = "tools"
    strings:
        $a = "hivedump"
        $b = "imgwalk"
        $c = "snaplist"
    condition: 2 of them and not $a
}
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.instants(table(spark, d, "case_metadata"), table(spark, d, "examiner_zone"), table(spark, d, "files"), table(spark, d, "volume_clock"))


def _ioc(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return findings.indicator_findings(spread(table(spark, d, "documents").select("doc_id", "evidence_uuid", "text")), "text", "evidence_uuid", "doc_id", (kind,))

    return run


def _values(kind: str):
    """The same over the recorded values, which hold kinds that the texts lack."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return findings.indicator_findings(table(spark, d, "findings"), "value", "evidence_id", "id", (kind,))

    return run


def ioc_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Hits and distinct values of all ten kinds in one pass over the texts."""
    return patterns.indicators(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id").groupBy("kind").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("value").alias("distinct_values"))


def findings_summary(spark, d):
    return findings.findings_summary(table(spark, d, "findings"))


def findings_top(spark, d):
    """The 2000 findings of highest count (a report's limit)."""
    return findings.top(table(spark, d, "findings").select("id", "evidence_id", "kind", "subtype", "value", "count"), "count", 2000)


def findings_filter(spark, d):
    return findings.findings_filter(table(spark, d, "findings"), "ioc", "email", "REPORT").select("id", "evidence_id", "value", "count")


def findings_count(spark, d):
    return table(spark, d, "findings").groupBy("kind", "subtype").agg(F.count(F.lit(1)).alias("findings"), F.count("count").alias("counted"))


def findings_dedup(spark, d):
    """Recorded twice under one id: the earlier record stays."""
    f = table(spark, d, "findings").select("id", "evidence_id", "kind", "subtype", "value", "count", "first_offset")
    return search.keep_first(f, ["id"], [F.col("evidence_id")])


def indicator_rollup(spark, d):
    """Value occurrences over images: sum, images and first offset by normalised value."""
    f = table(spark, d, "findings").where("kind = 'ioc'")
    return f.groupBy("subtype", F.lower(F.trim("value")).alias("indicator")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("total"), F.countDistinct("evidence_id").alias("images"), F.min("first_offset").alias("first_offset"))


def carved_top(spark, d):
    """The 2000 largest carved files (a report's limit)."""
    return findings.top(findings.carved_filter(table(spark, d, "files")).select("id", "evidence_id", "path", "size_bytes", "sha256"), "size_bytes", 2000)


def carved_search(spark, d):
    return findings.carved_filter(table(spark, d, "files"), "0xA").select("id", "path", "sha256")


def known_counts(spark, d):
    return findings.known_counts(table(spark, d, "files"))


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hash sets derived from the labelled files, and an orphan set that no longer exists."""
    files = table(spark, d, "files")
    sets = spark.createDataFrame([(1, "os-baseline", 0), (2, "reviewed", 0), (3, "~staging~half", 7)], "id bigint, name string, n_hashes bigint")
    labelled = files.where("known_set is not null").join(F.broadcast(sets.select(F.col("id").alias("set_id"), F.col("name").alias("known_set"))), "known_set")
    orphan = files.where("is_allocated = false and sha256 is not null").select(F.lit(9).cast("bigint").alias("set_id"), F.lit("sha256").alias("algo"), F.col("sha256").alias("hash"))
    pairs = labelled.select("set_id", F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), F.col(a).alias("hash")) for a in ("sha256", "md5")])).alias("h")).select("set_id", "h.algo", "h.hash")
    return sets, pairs.unionByName(orphan).where("hash is not null").distinct()


def hashset_dedup(spark, d):
    return _known(spark, d)[1].groupBy("set_id", "algo").agg(F.count(F.lit(1)).alias("hashes"))


def orphan_hashes(spark, d):
    sets, hashes = _known(spark, d)
    return known.orphans(hashes, sets).select("set_id", "algo", "hash")


def orphan_sweep(spark, d):
    sets, hashes = _known(spark, d)
    return known.sweep_orphans(hashes, sets).groupBy("set_id").agg(F.count(F.lit(1)).alias("hashes"))


def set_totals(spark, d):
    sets, _ = _known(spark, d)
    return known.set_totals(sets)


def known_label(spark, d):
    sets, hashes = _known(spark, d)
    return known.label_files(table(spark, d, "files").select("id", "md5", "sha256"), hashes, sets).where("label is not null").select("id", "label")


def sha256_prefix_search(spark, d):
    return search.digest_prefix(table(spark, d, "files"), "sha256", PREFIX.upper()).select("id", "path", "sha256")


def name_substring_search(spark, d):
    return search.name_search(table(spark, d, "files"), "path", "name", NAME_PART.upper()).select("id", "path")


def regex_path_search(spark, d):
    return search.regex_search(table(spark, d, "files").select("id", "path", "name"), "path", "name", PATH_PATTERN).select("id", "path")


def search_union(spark, d):
    h = table(spark, d, "hits").select("hit_id", "evidence_uuid", "path", "name", "score")
    parts = [h.where(F.col("name").contains("report")), h.where(F.col("path").contains("report"))]
    return search.union_hits(parts, ["evidence_uuid", "path", "name"], ["hit_id"])


def hits_best(spark, d):
    """Hits repeated for a document: the best score, the smaller id among equals."""
    h = table(spark, d, "hits").select("hit_id", "case_doc_id", "path", "score")
    return search.keep_first(h, ["case_doc_id"], [-F.col("score"), F.col("hit_id")])


def path_lookup(spark, d):
    """First file of each path in its image."""
    f = table(spark, d, "files").select("id", "evidence_id", "path", "size_bytes")
    return search.keep_first(f, ["evidence_id", "path"], [F.col("id")])


def snapshot_dedup(spark, d):
    return snapshots.snapshot_dedup(table(spark, d, "files").select("id", "evidence_id", "volume_offset", "path", "size_bytes", "mtime", "vss_snapshot_id")).select("id", "evidence_id", "path")


def snapshot_stats(spark, d):
    return snapshots.snapshot_stats(table(spark, d, "files"))


def keyword_search(spark, d):
    """The 50 most relevant documents for WORDS (a report's limit)."""
    return search.keyword_search(table(spark, d, "documents"), "doc_id", "evidence_uuid", "text", WORDS)


def term_stats(spark, d):
    return search.term_stats(search.postings(table(spark, d, "documents"), "doc_id", "source", "text"))


def hide_known(spark, d):
    """Hits whose container is no known file of its image."""
    ev = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "evidence_uuid")
    marked = table(spark, d, "files").where("known_set is not null").join(ev, "evidence_id").select("evidence_uuid", F.col("path").alias("container"))
    hits = table(spark, d, "hits").select("hit_id", "evidence_uuid", "path", scalars.container_of(F.col("path")).alias("container"))
    return known.hide_known(hits, marked, ["evidence_uuid", "container"]).select("hit_id", "evidence_uuid", "path")


def hidden_known(spark, d):
    """How many hits the known-file filter shows and hides."""
    ev = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "evidence_uuid")
    marked = table(spark, d, "files").where("known_set is not null").join(ev, "evidence_id").select("evidence_uuid", F.col("path").alias("container"))
    hits = table(spark, d, "hits").select("hit_id", "evidence_uuid", scalars.container_of(F.col("path")).alias("container"))
    shown, hidden = known.hide_known_counted(hits, marked, ["evidence_uuid", "container"])
    return shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(hidden)  # one row each


def ingest_eligibility(spark, d):
    """Files by what is done with them, if a megabyte of each was read."""
    f = table(spark, d, "files").select("name", "size_bytes", F.when(F.col("size_bytes").isNotNull(), F.least("size_bytes", F.lit(1 << 20))).alias("read_bytes"), F.col("is_allocated").alias("is_regular"))
    return ingest_ops.eligibility(f).groupBy("kind", "hash_it", "extract_it").agg(F.count(F.lit(1)).alias("files"))


def ingest_kinds(spark, d):
    return ingest_ops.stats(table(spark, d, "files"))


def audit_latest(spark, d):
    """The 500 newest entries of a log (a list's limit)."""
    return audit.latest(table(spark, d, "events").select("event_id", "user_id", "event_type"), 500, "event_id")


def hit_evidence(spark, d):
    """Hits by image file name."""
    ev = table(spark, d, "evidence").select("evidence_uuid", F.element_at(F.split("path", "/"), -1).alias("image"))
    return table(spark, d, "hits").join(ev, "evidence_uuid", "left").groupBy("image").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 5).alias("best"))


def hit_items(spark, d):
    """Hits in artifact items, on the document id."""
    items = table(spark, d, "artifact_items").groupBy("case_doc_id").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
    return table(spark, d, "hits").join(items, "case_doc_id").select("hit_id", "item_id", "copies")


def container_items(spark, d):
    """Documents and characters in each container, with the container's file."""
    items = table(spark, d, "artifact_items").groupBy("file_id", "container_path").agg(F.count(F.lit(1)).alias("items"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"))
    return items.join(table(spark, d, "files").select(F.col("id").alias("file_id"), "evidence_id", "size_bytes"), "file_id", "left").select("file_id", "container_path", "items", "characters", "evidence_id", "size_bytes")


def item_meta(spark, d):
    """Entries of the items' metadata maps by key."""
    return table(spark, d, "artifact_items").select(F.explode("meta").alias("k", "v")).groupBy("k").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("v").alias("distinct_values"))


def provenance_describe(spark, d):
    return provenance.describe(table(spark, d, "hits").select("hit_id", "path", "evidence_uuid"), table(spark, d, "files"), table(spark, d, "evidence").select("evidence_uuid", "id", "path"))


def origin_counts(spark, d):
    return provenance.origin_counts(table(spark, d, "documents"))


def csv_safe_export(spark, d):
    f = table(spark, d, "findings")
    return f.select("id", scalars.csv_safe(F.col("value")).alias("value"), F.concat(F.lit("0x"), F.lower(F.hex("first_offset"))).alias("offset_hex"))


def document_hashes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return extract.file_hashes(docs)


def tidy_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(scalars.tidy_text(F.col("text"))).alias("characters"))


def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scalars.tokens(F.col("text"))).alias("terms"))


def rtf_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.rtf_text(F.concat(F.lit(r"{\rtf1\ansi "), F.regexp_replace("text", r"[{}\\]", " "), F.lit(r"\par}"))).cast("binary")).alias("digest"))


def rule_matches(spark, d):
    return rules.rule_matches(table(spark, d, "documents"), "text", "doc_id", rules=USER_RULES)


def builtin_rule_counts(spark, d):
    """The built-in rules over all texts and recorded values."""
    texts = table(spark, d, "documents").select(F.lit("document").alias("place"), "text").unionByName(table(spark, d, "findings").select(F.lit("finding").alias("place"), F.col("value").alias("text")))
    return rules.rule_counts(rules.rule_matches(spread(texts), "text", "place"), "place")


def rule_counts(spark, d):
    return rules.rule_counts(rules.rule_matches(table(spark, d, "documents"), "text", "source", rules=USER_RULES), "source")


def artifact_kinds(spark, d):
    """Files by the kind of container that their name tells (no content is at hand)."""
    from caselode.sources.containers import artifact_kind

    return table(spark, d, "files").select(artifact_kind(F.col("name"), F.lit(None).cast("binary")).alias("kind"), "size_bytes").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def findings_capped(spark, d):
    """The 5,000 first findings (a list's limit), with whether some are left out and the weight of those."""
    kept, note = findings.capped(table(spark, d, "findings").select("id", "evidence_id", "first_offset", "count"), ["id", "evidence_id", "first_offset"], 5000)
    return kept.crossJoin(F.broadcast(note))  # one row


def header_dates(spark, d):
    m = table(spark, d, "case_metadata").where(F.col("metadata_field").isin("AcquiredDate", "SystemDate"))
    return m.select("meta_id", scalars.header_date(F.col("value")).alias("iso"))


def file_sizes(spark, d):
    return table(spark, d, "files").select("id", scalars.size_text(F.col("size_bytes")).alias("size"))


def safe_names(spark, d):
    return table(spark, d, "files").select("id", scalars.safe_name(F.col("path")).alias("name"))


def hash_types(spark, d):
    h = table(spark, d, "files").select("id", F.explode(F.array(F.concat(F.lit(" '"), F.upper("md5"), F.lit("' ")), "sha256", "name")).alias("h"))
    return h.select("id", scalars.normalise_hash(F.col("h")).alias("n")).where("n is not null").select("id", "n.algo", "n.hash")


def segment_numbers(spark, d):
    m = table(spark, d, "case_metadata").select("image_set", "first_segment", "last_segment").distinct()
    ext = lambda c: F.regexp_extract(c, r"\.([^.]+)$", 1)
    return m.select("image_set", scalars.segment_index(ext("first_segment")).alias("first_number"), scalars.segment_index(ext("last_segment")).alias("last_number"))


def segment_gaps(spark, d):
    """Numbers without a file between a set's first and last named segment."""
    return segments.missing_segments(segment_numbers(spark, d).select("image_set", F.explode(F.array("first_number", "last_number")).alias("number")))


def metadata_pivot(spark, d):
    """One row for each image set: chosen header fields, the first reading of each."""
    m = table(spark, d, "case_metadata").select("image_set", "metadata_field", "value", "read_at", "meta_id")
    one = search.keep_first(m, ["image_set", "metadata_field"], [F.col("read_at"), F.col("meta_id")])
    return one.groupBy("image_set").pivot("metadata_field", ["CaseNumber", "EvidenceNumber", "Model", "SerialNumber"]).agg(F.first("value"))


def evidence_formats(spark, d):
    return table(spark, d, "evidence").groupBy("format").agg(F.count(F.lit(1)).alias("items"), F.sum("size_bytes").alias("bytes"), F.count("acquired_md5").alias("hashed"))


def ingest_stats(spark, d):
    return table(spark, d, "files").groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("files"), F.count("sha256").alias("hashed"), F.count("known_set").alias("known"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("path").startswith("/(carved)/")).alias("carved")
    )


def audit_chain_heads(spark, d):
    return audit.chain(table(spark, d, "events"), "user_id", "event_id", ["user_id", "event_type", "props"])


def event_gaps(spark, d):
    """Previous event of a user, by event id."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lag("event_id", 1, 0).over(w).alias("previous_id"), F.row_number().over(w).alias("place"))


def doc_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.stable_doc_id(F.col("evidence_uuid"), F.col("path")).alias("case_doc_id"))


def tlsh_similar(spark, d):
    """The 300 files nearest to the digest of the file of smallest id that has one (a report's limit)."""
    files = table(spark, d, "files")
    seed = files.where("tlsh is not null").agg(F.min_by("tlsh", "id").alias("t")).first()["t"]
    return search.similar_files(files, seed, most=250)


def keyword_fallback(spark, d):
    """Two words that no text holds, but their joined form does."""
    return search.keyword_fallback(table(spark, d, "documents"), "doc_id", "evidence_uuid", "text", "img walk")[0]


def stream_event_counts(spark, d):
    """Hourly counts of the events read as a stream until its end, with a watermark: every window's last state, open ones included."""
    run = shared_folder(spark, "stream")
    schema = table(spark, d, "events").schema
    # the reader of a stream takes folders, so a pattern names the one file
    stream = ingest.stream_table(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.windowed_counts(stream, "ts", "event_type", "1 hour", "1 hour").select(F.unix_seconds("start").alias("start_s"), "event_type", "n", "total")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{run}/out/part={n}")  # a batch run again takes its own place

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", run + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.schema("start_s bigint, event_type string, n bigint, total double, batch int").parquet(f"{run}/out")
    return cut(states.groupBy("start_s", "event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 6).alias("total")))


def queries() -> dict:
    own = [
        p1_found, ioc_all_kinds, findings_summary, findings_top, findings_filter, findings_count, findings_dedup, indicator_rollup, carved_top, carved_search, known_counts, hashset_dedup,
        orphan_hashes, orphan_sweep, set_totals, known_label, sha256_prefix_search, name_substring_search, regex_path_search, search_union, hits_best, path_lookup, snapshot_dedup, snapshot_stats,
        keyword_search, term_stats, hide_known, hit_evidence, hit_items, container_items, item_meta, provenance_describe, origin_counts, csv_safe_export, document_hashes, tidy_documents, token_counts,
        rtf_texts, rule_matches, rule_counts, builtin_rule_counts, artifact_kinds, findings_capped, header_dates, file_sizes, safe_names, hash_types, segment_numbers, segment_gaps, metadata_pivot, evidence_formats, ingest_stats, ingest_eligibility, ingest_kinds, hidden_known, audit_latest, audit_chain_heads,
        event_gaps, doc_ids, tlsh_similar, keyword_fallback, stream_event_counts,
    ]
    return {f.__name__: f for f in own} | byte_queries.queries() | {f"ioc_{k}_findings": _ioc(k) for k in ("email", "ipv4", "phone")} | {f"ioc_{k}_values": _values(k) for k in ("url", "ipv6", "mac", "btc", "onion", "cc")}


def _ioc_sql(kind: str, values: str) -> str:
    return f"""select evidence_uuid, 'ioc' as kind, '{kind}' as subtype, value, count(*) as count, min(doc_id) as first_offset
        from (select evidence_uuid, doc_id, unnest({values}) as value from documents) group by all"""


def _values_sql(kind: str, values: str) -> str:
    return f"""select evidence_id, 'ioc' as kind, '{kind}' as subtype, value, count(*) as count, min(id) as first_offset
        from (select evidence_id, id, unnest({values.replace("text", "value")}) as value from findings) group by all"""


_KIND = """select *, case when ext in ('crypt12', 'crypt14', 'crypt15') then 'whatsapp_encrypted' when ext in ('mem', 'vmem', 'raw', 'lime', 'dmp', 'core') then 'memory' when ext in ('pcap', 'pcapng', 'cap') then 'pcap'
    when low in ('ntuser.dat', 'usrclass.dat', 'system', 'software', 'sam', 'security', 'default', 'components', 'drivers', 'bcd') then 'registry' when ext in ('pst', 'ost', 'pab') then 'pst' when ext in ('edb', 'ese') then 'esedb'
    when ext in ('db', 'sqlite', 'sqlite3', 'db3') then 'sqlcipher' when contains(low, 'quarantine') and ext in ('', 'dat') then 'defender_quarantine' else '' end as kind
    from (select *, lower(coalesce(name, '')) as low, case when contains(name, '.') then regexp_extract(lower(name), '[^.]*$') else '' end as ext from files)"""
_CYCLE = "least(abs({a} - {b}), {n} - abs({a} - {b}))"
_LENGTH = _CYCLE.format(a="(16 * x[4] + x[3])", b="(16 * y[4] + y[3])", n=256)
_QUARTILE = [_CYCLE.format(a=f"x[{i}]", b=f"y[{i}]", n=16) for i in (5, 6)]
_CODE = "(case when abs({a} - {b}) = 3 then 6 else abs({a} - {b}) end)"
#: The published digest distance over lists x and y of 70 hex digits.
_TLSH = (
    f"(case when {_LENGTH} <= 1 then {_LENGTH} else 12 * {_LENGTH} end) + " + " + ".join(f"(case when {q} <= 1 then {q} else 12 * ({q} - 1) end)" for q in _QUARTILE)
    + " + (case when x[1] <> y[1] or x[2] <> y[2] then 1 else 0 end) + list_sum(list_transform(range(7, 71), lambda i: " + _CODE.format(a="x[i] // 4", b="y[i] // 4") + " + " + _CODE.format(a="x[i] % 4", b="y[i] % 4") + "))"
)
_DIGITS = r"regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) between 13 and 19 and list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: (case when i % 2 = 0 then (2 * cast({_DIGITS}[-i] as int)) // 10 + (2 * cast({_DIGITS}[-i] as int)) % 10 else cast({_DIGITS}[-i] as int) end))) % 10 = 0"
_RUNS = "list_filter(regexp_extract_all(coalesce(text, ''), '{run}'), lambda x: regexp_full_match(x, '{full}'))"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SETS = "(select * from (values (1, 'os-baseline', 0), (2, 'reviewed', 0), (3, '~staging~half', 7)) as t(id, name, n_hashes))"
_HASHES = f"""(select distinct set_id, algo, hash from (
    select s.id as set_id, unnest(['sha256', 'md5']) as algo, unnest([f.sha256, f.md5]) as hash from files f join {_SETS} s on s.name = f.known_set
    union all select 9, 'sha256', sha256 from files where is_allocated = false and sha256 is not null) where hash is not null)"""
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '' and strlen(t) < 40)"
_ORIGIN = r"case when regexp_matches(path, '^/\(carved\)/[^/]+/0x[0-9a-fA-F]+$') then 'carved' when regexp_matches(path, '^/\(raw\)/0x[0-9a-fA-F]+$') then 'raw/unalloc' when contains(path, '#') then 'in container' else 'file' end"
_SAFE = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(regexp_replace(replace({path}, '\', '/'), '/+$', ''), '[^/]*$'), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), ''), 'export.bin')"""
_SEG = r"regexp_replace(upper(regexp_extract({c}, '\.([^.]+)$', 1)), '^([EL])X', '\1')"
_NUMBER = (
    "case when regexp_full_match({e}[2:], '[0-9]{{2}}') then cast({e}[2:] as int) when regexp_full_match({e}[2:], '[A-Z]{{2}}') then 100 + (ascii({e}[2:2]) - 65) * 26 + ascii({e}[3:3]) - 65 else -1 end"
)
_NUMBERS = f"""select distinct image_set, cast({_NUMBER.format(e="f")} as int) as first_number, cast({_NUMBER.format(e="l")} as int) as last_number
    from (select image_set, {_SEG.format(c="first_segment")} as f, {_SEG.format(c="last_segment")} as l from case_metadata)"""


def oracle_sql() -> dict[str, str]:
    tidy = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t" + " " + r"]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    rtf = r"regexp_replace(regexp_replace(regexp_replace('{\rtf1\ansi ' || regexp_replace(text, '[{}\\]', ' ', 'g') || '\par}', '\\''[0-9a-fA-F]{2}', '', 'g'), '\\[a-zA-Z]+-?[0-9]* ?', ' ', 'g'), '[{}\\]', ' ', 'g')"
    tidy_rtf = tidy.replace("(text,", f"({rtf},")
    words = ", ".join(f"'{w}'" for w in sorted(WORDS.split()))
    return byte_queries.oracle_sql() | {
        "p1_found": P1_FOUND,
        "ioc_email_findings": _ioc_sql("email", r"regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}')"),
        "ioc_ipv4_findings": _ioc_sql("ipv4", _RUNS.format(run="[0-9.]+", full=rf"(?:{_OCTET}\.){{3}}{_OCTET}")),
        "ioc_url_values": _values_sql("url", r"regexp_extract_all(coalesce(text, ''), '(?:https?|ftp)://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+')"),
        "ioc_ipv6_values": _values_sql("ipv6", _RUNS.format(run="[0-9A-Fa-f:]+", full="(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}")),
        "ioc_mac_values": _values_sql("mac", _RUNS.format(run="[0-9A-Fa-f:]+", full="(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}")),
        "ioc_btc_values": _values_sql("btc", _RUNS.format(run="[A-Za-z0-9]+", full="[13][A-HJ-NP-Za-km-z1-9]{25,34}|bc1[a-z0-9]{11,71}")),
        "ioc_onion_values": _values_sql("onion", r"list_transform(regexp_extract_all(coalesce(text, ''), '(?:^|[^a-z2-7])[a-z2-7]{56}\.onion(?:[^a-z2-7]|$)'), lambda x: regexp_extract(x, '[a-z2-7]{56}\.onion'))"),
        "findings_summary": "select kind, subtype, cast(sum(count) as bigint) as total from findings group by all",
        "findings_top": "select id, evidence_id, kind, subtype, value, count from findings order by count desc nulls last, id limit 2000",
        "findings_filter": "select id, evidence_id, value, count from findings where kind = 'ioc' and subtype = 'email' and value ilike '%REPORT%'",
        "findings_count": "select kind, subtype, count(*) as findings, count(count) as counted from findings group by all",
        "findings_dedup": "select id, evidence_id, kind, subtype, value, count, first_offset from findings qualify row_number() over (partition by id order by evidence_id) = 1",
        "indicator_rollup": "select subtype, lower(trim(value)) as indicator, cast(sum(coalesce(count, 1)) as bigint) as total, count(distinct evidence_id) as images, min(first_offset) as first_offset from findings where kind = 'ioc' group by all",
        "carved_top": "select id, evidence_id, path, size_bytes, sha256 from files where path like '/(carved)/%' order by size_bytes desc nulls last, id limit 2000",
        "carved_search": "select id, path, sha256 from files where path like '/(carved)/%' and (name ilike '%0xA%' or sha256 ilike '%0xA%')",
        "known_counts": "select count(*) filter (coalesce(known_set, '') <> '') as known, count(*) filter (coalesce(sha256, '') <> '') as hashed from files",
        "hashset_dedup": f"select cast(set_id as bigint) as set_id, algo, count(*) as hashes from {_HASHES} group by all",
        "orphan_hashes": f"select cast(set_id as bigint) as set_id, algo, hash from {_HASHES} h where not exists (select 1 from {_SETS} s where s.id = h.set_id)",
        "orphan_sweep": f"select cast(set_id as bigint) as set_id, count(*) as hashes from {_HASHES} h where exists (select 1 from {_SETS} s where s.id = h.set_id) group by 1",
        "set_totals": f"select cast(coalesce(sum(n_hashes), 0) as bigint) as total from {_SETS} where name not like '~staging~%'",
        "known_label": f"""with one as (select algo, hash, min_by(name, set_id) as name from {_HASHES} h join {_SETS} s on s.id = h.set_id where s.name not like '~staging~%' group by all)
            select f.id, coalesce(a.name, b.name) as label from files f left join one a on a.algo = 'sha256' and a.hash = f.sha256 left join one b on b.algo = 'md5' and b.hash = f.md5 where coalesce(a.name, b.name) is not null""",
        "sha256_prefix_search": f"select id, path, sha256 from files where starts_with(sha256, '{PREFIX}')",
        "name_substring_search": rf"""select id, path from files where contains(lower(path), '{NAME_PART}')
            or len(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) < 40 and contains(t, '{NAME_PART}'))) > 0""",
        "regex_path_search": rf"""select id, path from files where regexp_matches(path, '{PATH_PATTERN}')
            or len(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' and strlen(t) < 40 and regexp_matches(t, '(?i){PATH_PATTERN}'))) > 0""",
        "search_union": """select hit_id, evidence_uuid, path, name, score from (
            select *, 0 as part from hits where contains(name, 'report') union all select *, 1 from hits where contains(path, 'report'))
            qualify row_number() over (partition by evidence_uuid, path, name order by part, hit_id) = 1""",
        "hits_best": "select hit_id, case_doc_id, path, score from hits qualify row_number() over (partition by case_doc_id order by -score, hit_id) = 1",
        "path_lookup": "select id, evidence_id, path, size_bytes from files qualify row_number() over (partition by evidence_id, path order by id) = 1",
        "snapshot_dedup": """select id, evidence_id, path from files qualify row_number() over (
            partition by evidence_id, volume_offset, path, size_bytes, coalesce(try_cast(trunc(mtime) as bigint), 0) order by coalesce(vss_snapshot_id, ''), id) = 1""",
        "snapshot_stats": """select evidence_id, count(*) as unique_files, cast(sum(n - 1) as bigint) as duplicates from (
            select evidence_id, count(*) as n from files group by evidence_id, volume_offset, path, size_bytes, coalesce(try_cast(trunc(mtime) as bigint), 0)) group by 1""",
        "keyword_search": f"""with t as (select evidence_uuid as evidence, doc_id as doc, {_TERMS} as terms from documents), s as (select evidence, count(*) as n, avg(len(terms)) as avgdl from t group by 1),
            h as (select evidence, doc, dl, term, count(*) as tf from (select evidence, doc, len(terms) as dl, unnest(terms) as term from t) where term in ({words}) group by all),
            f as (select evidence, term, count(*) as df from h group by all)
            select evidence, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) as score
            from h join f using (evidence, term) join s using (evidence) group by evidence, doc order by score desc, doc limit 50""",
        "term_stats": f"select evidence, term, count(*) as df from (select distinct source as evidence, doc_id, unnest({_TERMS}) as term from documents) group by all",
        "hide_known": """select hit_id, evidence_uuid, path from hits h where not exists (select 1 from files f join evidence e on e.id = f.evidence_id
            where f.known_set is not null and e.evidence_uuid = h.evidence_uuid and f.path = split_part(h.path, '#', 1))""",
        "hit_evidence": "select regexp_extract(e.path, '[^/]*$') as image, count(*) as hits, round(max(score), 5) as best from hits h left join evidence e using (evidence_uuid) group by 1",
        "hit_items": "select hit_id, item_id, copies from hits join (select case_doc_id, min(item_id) as item_id, count(*) as copies from artifact_items group by 1) using (case_doc_id)",
        "container_items": """select file_id, container_path, items, characters, evidence_id, size_bytes from (
            select file_id, container_path, count(*) as items, cast(sum(coalesce(length(text), 0)) as bigint) as characters from artifact_items group by all) i left join files f on f.id = i.file_id""",
        "item_meta": "select k, count(*) as items, count(distinct v) as distinct_values from (select e.key as k, e.value as v from (select unnest(map_entries(meta)) as e from artifact_items)) group by 1",
        "provenance_describe": f"""with one as (select evidence_id, path as file_path, id as file_id from files qualify row_number() over (partition by evidence_id, path order by coalesce(vss_snapshot_id, ''), id) = 1),
            h as (select hit_id, path, evidence_uuid, {_ORIGIN} as origin, split_part(path, '#', 1) as file_path from hits)
            select h.hit_id, h.path, h.evidence_uuid, origin, e.id as evidence_id, e.path as image, file_id, e.path is not null and (file_id is not null or origin = 'raw/unalloc') as exportable,
            case when e.path is null then 'unknown evidence item' when origin = 'raw/unalloc' then 'raw page: exported as a byte range' when file_id is null then 'no file of that path in the case'
            when origin = 'in container' then 'exported as its whole container' else '' end as note, {_SAFE.format(path="h.file_path")} as suggested_name
            from h left join evidence e using (evidence_uuid) left join one on one.evidence_id = e.id and one.file_path = h.file_path""",
        "origin_counts": f"select {_ORIGIN} as origin, count(*) as documents from documents group by 1",
        "csv_safe_export": r"select id, case when regexp_matches(value, '^[=+\-@\t\r]') then '''' || value else value end as value, '0x' || lower(to_hex(first_offset)) as offset_hex from findings",
        "document_hashes": "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents",
        "rtf_texts": rf"select doc_id, md5({tidy_rtf}) as digest from documents where text is not null union all select doc_id, null from documents where text is null",
        "file_sizes": "select id, case when coalesce(size_bytes, 0) <= 0 then '' " + " ".join(
            f"when size_bytes < {1024 ** (k + 1)} then " + (f"printf('%.2f {u}', floor(size_bytes / {1024 ** k}::double * 100 + 0.5) / 100)" if k else "printf('%d B', size_bytes)") for k, u in enumerate(("B", "KB", "MB", "GB", "TB"))
        ) + " end as size from files",
        "keyword_fallback": f"""with t as (select evidence_uuid as evidence, doc_id as doc, {_TERMS} as terms from documents), s as (select evidence, count(*) as n, avg(len(terms)) as avgdl from t group by 1),
            u as (select evidence, doc, len(terms) as dl, unnest(terms) as term from t), w as (select case when exists (select 1 from u where term in ('img', 'walk')) then ['img', 'walk'] else ['imgwalk'] end as words),
            h as (select evidence, doc, dl, term, count(*) as tf from u where list_contains((select words from w), term) group by all), f as (select evidence, term, count(*) as df from h group by all)
            select evidence, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) as score
            from h join f using (evidence, term) join s using (evidence) group by evidence, doc order by score desc, doc limit 50""",
        "tlsh_similar": rf"""with f as (select id, path, upper(regexp_replace(tlsh, '^T1', '', 'i')) as t from files where regexp_full_match(upper(tlsh), '(T1)?[0-9A-F]{{70}}')),
            v as (select id, path, list_transform(range(1, 71), lambda i: instr('0123456789ABCDEF', substr(t, i, 1)) - 1) as x from f), q as (select x as y from v where id = (select min(id) from files where tlsh is not null)),
            d as (select id, path, cast({_TLSH} as int) as distance from v, q) select id, path, distance from d where distance <= 250 order by distance, id limit 300""",
        "ioc_cc_values": rf"""select evidence_id, 'ioc' as kind, 'cc' as subtype, value, count(*) as count, min(id) as first_offset from (
            select evidence_id, id, unnest(list_filter(regexp_extract_all(coalesce(value, ''), '(?:^|[^0-9A-Za-z])([0-9][0-9 \-]{{11,21}}[0-9])(?:[^0-9A-Za-z]|$)', 1), lambda v: {_LUHN})) as value from findings) group by all""",
        "tidy_documents": f"select doc_id, length({tidy}) as characters from documents",
        "token_counts": f"select doc_id, cast(len({_TERMS}) as int) as terms from documents",
        "rule_matches": r"""select doc_id, 'Long_Hash_Mention' as rule, 'hashes' as category from documents where regexp_matches(text, 'hash begins with [0-9a-f]{12}') or contains(lower(text), 'carvex')
            union all select doc_id, 'Two_Tools', 'tools' from documents where contains(text, 'hivedump')::int + contains(text, 'imgwalk')::int + contains(text, 'snaplist')::int >= 2 and not contains(text, 'hivedump')""",
        "rule_counts": r"""select rule, source, count(*) as count from (select source, 'Long_Hash_Mention' as rule from documents where regexp_matches(text, 'hash begins with [0-9a-f]{12}') or contains(lower(text), 'carvex')
            union all select source, 'Two_Tools' from documents where contains(text, 'hivedump')::int + contains(text, 'imgwalk')::int + contains(text, 'snaplist')::int >= 2 and not contains(text, 'hivedump')) group by all""",
        "hidden_known": """with k as (select distinct e.evidence_uuid, f.path from files f join evidence e on e.id = f.evidence_id where f.known_set is not null), h as (select hit_id, k.path is not null as hidden from hits h
            left join k on k.evidence_uuid = h.evidence_uuid and k.path = split_part(h.path, '#', 1)) select count(*) filter (not hidden) as shown, count(*) filter (hidden) as hidden from h""",
        "ingest_eligibility": f"""with k as ({_KIND}) select kind, coalesce(is_allocated, false) and coalesce(size_bytes, 0) > 0 and size_bytes <= 1048576 as hash_it,
            coalesce(is_allocated, false) and coalesce(size_bytes, 0) > 0 and kind = '' and not (low like '%-wal' or low like '%-shm') as extract_it, count(*) as files from k group by all""",
        "ingest_kinds": f"""with k as ({_KIND}) select evidence_id, kind, count(*) as files, count(sha256) as hashed, count(known_set) as known, count(*) - count(sha256) as skipped, round(100.0 * count(known_set) / count(*), 2) as known_percent from k group by all""",
        "audit_latest": "select event_id, user_id, event_type from events order by event_id desc limit 500",
        "artifact_kinds": """with f as (select lower(name) as low, case when contains(lower(name), '.') then regexp_extract(lower(name), '[^.]*$') else '' end as ext, size_bytes from files)
            select case when ext in ('crypt12', 'crypt14', 'crypt15') then 'whatsapp_encrypted' when ext in ('mem', 'vmem', 'raw', 'lime', 'dmp', 'core') then 'memory' when ext in ('pcap', 'pcapng', 'cap') then 'pcap'
            when low in ('ntuser.dat', 'usrclass.dat', 'system', 'software', 'sam', 'security', 'default', 'components', 'drivers', 'bcd') then 'registry' when ext in ('pst', 'ost', 'pab') then 'pst'
            when ext in ('edb', 'ese') then 'esedb' when ext in ('db', 'sqlite', 'sqlite3', 'db3') then 'sqlcipher' when contains(low, 'quarantine') and ext in ('', 'dat') then 'defender_quarantine' else '' end as kind,
            count(*) as files, cast(sum(size_bytes) as bigint) as bytes from f group by 1""",
        "findings_capped": """with k as (select id, evidence_id, first_offset, count from findings order by id, evidence_id, first_offset nulls first limit 5000)
            select k.*, (select count(*) from findings) > 5000 as truncated, cast((select coalesce(sum(count), 0) from findings) - (select coalesce(sum(count), 0) from k) as bigint) as dropped from k""",
        "header_dates": r"""with m as (select meta_id, trim(coalesce(value, '')) as v, try_cast(trim(value) as bigint) as n, regexp_split_to_array(trim(value), '\s+') as p from case_metadata where metadata_field in ('AcquiredDate', 'SystemDate')),
            s as (select *, case when length(v) = 13 then n // 1000 else n end as s from m)
            select meta_id, case when regexp_full_match(v, '\d{1,18}') and s > 0 and s < 4102444800 then strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC'
            when regexp_matches(v, '^\d{1,4}( +\d{1,2}){5}( |$)') then lpad(p[1], 4, '0') || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') || ' ' || lpad(p[4], 2, '0') || ':' || lpad(p[5], 2, '0') || ':' || lpad(p[6], 2, '0')
            else v end as iso from s""",
        "safe_names": f"select id, {_SAFE.format(path='path')} as name from files",
        "hash_types": """select id, case length(h) when 32 then 'md5' when 40 then 'sha1' else 'sha256' end as algo, h as hash from (
            select id, lower(regexp_replace(unnest([' ''' || upper(md5) || ''' ', sha256, name]), '^[\\s"'']+|[\\s"'']+$', '', 'g')) as h from files) where regexp_full_match(h, '[0-9a-f]+') and length(h) in (32, 40, 64)""".replace("\\\\s", "\\s"),
        "segment_numbers": _NUMBERS,
        "segment_gaps": f"""with n as ({_NUMBERS}), h as (select image_set, first_number as number from n where first_number > 0 union select image_set, last_number from n where last_number > 0)
            select image_set, cast(number as int) as number, case when number < 100 then 'E' || lpad(cast(number as varchar), 2, '0') else 'E' || chr(cast(65 + (number - 100) // 26 as int)) || chr(cast(65 + (number - 100) % 26 as int)) end as extension
            from (select image_set, unnest(range(1, max(number) + 1)) as number from h group by 1) e where not exists (select 1 from h where h.image_set = e.image_set and h.number = e.number)""",
        "metadata_pivot": """with o as (select * from case_metadata qualify row_number() over (partition by image_set, metadata_field order by read_at, meta_id) = 1)
            select image_set, max(value) filter (metadata_field = 'CaseNumber') as "CaseNumber", max(value) filter (metadata_field = 'EvidenceNumber') as "EvidenceNumber",
            max(value) filter (metadata_field = 'Model') as "Model", max(value) filter (metadata_field = 'SerialNumber') as "SerialNumber" from o group by 1""",
        "evidence_formats": "select format, count(*) as items, cast(sum(size_bytes) as bigint) as bytes, count(acquired_md5) as hashed from evidence group by 1",
        "ingest_stats": "select evidence_id, count(*) as files, count(sha256) as hashed, count(known_set) as known, cast(sum(size_bytes) as bigint) as bytes, count(*) filter (path like '/(carved)/%') as carved from files group by 1",
        "audit_chain_heads": """with recursive r as (select user_id, row_number() over (partition by user_id order by event_id) as n,
            coalesce(cast(user_id as varchar), '') || '|' || coalesce(event_type, '') || '|' || coalesce(props, '') as t from events),
            c as (select user_id, 0 as n, repeat('0', 64) as h from (select distinct user_id from events) union all select c.user_id, r.n, sha256(r.t || '|' || c.h) from c join r on r.user_id = c.user_id and r.n = c.n + 1)
            select user_id, max(n) as entries, max_by(h, n) as head from c group by 1""",
        "stream_event_counts": """with w as (select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, event_type, count(*) as n, sum(value) as total from events group by 1, 2)
            select start_s, event_type, n, round(total, 6) as total from w""",
        "event_gaps": "select event_id, user_id, lag(event_id, 1, 0) over w as previous_id, row_number() over w as place from events window w as (partition by user_id order by event_id)",
    }
