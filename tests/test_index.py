"""The written index answers as the scan does; jobs can be cancelled."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from caselode.functions.scalars import duration_text
from caselode.operators.search import keyword_search
from caselode.session import cancel, job_group
from caselode.sinks.index import search_index, write_index
from caselode.sources.tables import table
from tests.helpers import FOLDER


def test_index(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    path = str(tmp_path / "index")
    write_index(docs, path, "doc_id", "source", "text")
    for query in ("server image checksum", "die Größe", "", "nothing-like-this"):
        a, b = ([(r["evidence"], r["doc"], r["score"]) for r in df.collect()] for df in (search_index(spark, path, query, 20), keyword_search(docs, "doc_id", "source", "text", query, 20)))
        assert a == b
    plan = search_index(spark, path, "server")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [server])" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term,server)]" in plan


def test_cancel(spark):
    failed = []

    def run():
        with job_group(spark, "slow"):
            try:
                spark.range(1_000_000_000_000).select(F.sum(F.rand())).collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=run)
    t.start()
    began = time.time()
    while t.is_alive() and time.time() - began < 60:
        time.sleep(0.5)
        cancel(spark, "slow")
    t.join(5)
    assert failed and not t.is_alive()


@pytest.mark.parametrize(("s", "want"), [(5, "0:05"), (65.9, "1:05"), (3723, "1:02:03"), (None, ""), (-1, "")])
def test_duration(spark, s, want):
    assert spark.createDataFrame([(s if s is None else float(s),)], "s double").select(duration_text(F.col("s"))).first()[0] == want
