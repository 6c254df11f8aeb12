"""Streams give what batches give, also after a restart."""

import pandas as pd

from sheaf.operators import chunking
from sheaf.operators.analytics import log_windows
from sheaf.sources.tables import corpus, search_log
from sheaf.streaming import jobs


def test_ingest_resumes(spark, sf, tmp_path):
    docs = corpus(spark, sf).select("document_id", "content")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda: jobs.ingest_stream(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    docs.where("document_id = '5'").write.mode("append").parquet(str(tmp_path / "in"))  # a file with a document that is there
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = chunking.smart_chunks(docs)
    assert first == found.count() == expected.count()
    assert found.select("chunk_id", "content").exceptAll(expected.select("chunk_id", "content")).count() == 0


def test_log_windows(spark, sf, tmp_path):
    log = search_log(spark, sf)
    log = log.withColumn("ts", log.ts.cast("timestamp"))
    log.write.parquet(str(tmp_path / "in"))
    jobs.log_stream(spark, str(tmp_path / "in"), log.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed, batch = spark.read.parquet(str(tmp_path / "out")), log_windows(log)
    last = log.selectExpr("max(ts) - interval 1 hour").first()[0]
    closed = batch.where(batch.window_start < last.replace(minute=0, second=0, microsecond=0))
    assert streamed.exceptAll(batch).count() == 0 and closed.exceptAll(streamed).count() == 0 and closed.count() > 0


def test_batches_read_no_history(spark, tmp_path):
    """Whether a document is there is known from state: chunks and folders of earlier batches may be gone."""
    schema = "document_id string, content string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.ingest_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    put(("a", "zeta text"), ("a", "alpha text"), ("b", "beta text"))
    run()
    assert {r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"alpha text", "beta text"}
    (tmp_path / "out").rename(tmp_path / "elsewhere")
    put(("b", "another"), ("c", "gamma"), (None, "no id"))
    run()
    assert {r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"gamma", "no id"}


def test_reuse_stream_expires_answers(spark, tmp_path):
    """Over many batches and a restart, with answers that grow too old between them, as the plain rule says."""
    from tests.test_tables import as_frame, plain_reuse, some_requests

    requests = sorted(some_requests(240), key=lambda r: (r[2], r[0]))
    cut = [requests[i : i + 40] for i in range(0, 240, 40)]
    schema = as_frame(spark, requests[:1]).schema
    run = lambda: jobs.reuse_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), 600, "10 minutes", 1).awaitTermination()
    for i, part in enumerate(cut):
        as_frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (2, 5):
            run()
    found = {r["request_id"]: (r["from_cache"], r["stored_by"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == plain_reuse(requests, 600)


def test_a_call_lets_many_documents_through(spark, tmp_path):
    """One call of the processor takes a group of documents; ids and contents that are null are kept as ids and contents."""
    there = {}

    class State:
        containsKey = staticmethod(there.__contains__)  # noqa: N815
        updateValue = staticmethod(there.__setitem__)  # noqa: N815

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return State()

    new = jobs.NewDocuments()
    new.init(Handle())
    call = lambda *rows: [x for out in new.handleInputRows((1,), iter([pd.DataFrame(list(rows[i : i + 2]), columns=["document_id", "content"], dtype=object) for i in range(0, len(rows), 2)]), None) for x in out.itertuples(index=False, name=None)]
    assert call(("a", "z"), ("b", None), ("a", "y"), (None, "q"), ("c", "x"), ("b", "w")) == [("a", "y"), ("b", "w"), (None, "q"), ("c", "x")]
    assert call(("a", "b"), ("d", None), (None, None)) == [("d", None)] and call(("a", "a")) == []

    schema = "document_id string, content string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.ingest_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    put((None, "no id, later text"), (None, "no id, first text"), ("c", None))
    run()
    put((None, "no id, again"), ("e", "e text"))
    run()
    found = {(r["document_id"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (None, "no id, first text") in found and ("e", "e text") in found and "no id, again" not in {c for _, c in found}
