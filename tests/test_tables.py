"""Stored tables with upserts by bucket, and reuse of answers."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import fusion, tables


def files(path):
    return {f for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit("old").alias("value"))
    assert len(tables.upsert(first, path, "key", buckets=16)) == 16
    before = files(path)
    touched = tables.upsert(spark.createDataFrame([("7", "new"), ("x", "new")], "key string, value string"), path, "key", buckets=3)  # the table's own number of buckets stays
    after = files(path)
    assert 1 <= len(touched) <= 2 and {f for f in before - after} == {f for b in touched for f in before if f"_bucket={b}/" in f}
    assert {f for f in before if not any(f"_bucket={b}/" in f for b in touched)} <= after
    found = {r["key"]: r["value"] for r in tables.rows(spark, path).collect()}
    assert len(found) == 201 and found["7"] == found["x"] == "new" and sum(v == "new" for v in found.values()) == 2


def test_nothing_changes_nothing(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], "key string, value int")
    assert tables.upsert(none, path, "key") == [] and tables.about(spark, path) is None
    tables.upsert(spark.createDataFrame([("a", 1), (None, 2)], "key string, value int"), path, "key")
    before = files(path)
    assert tables.upsert(none, path, "key") == [] and files(path) == before and tables.rows(spark, path).count() == 1


def test_the_last_of_a_key_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(spark.createDataFrame([("a", 1, "z"), ("a", 3, "b"), ("a", 2, "c"), ("b", None, "x")], "key string, at int, value string"), path, "key", order="at")
    assert sorted(tuple(r) for r in tables.rows(spark, path).select("key", "at", "value").collect()) == [("a", 3, "b"), ("b", None, "x")]
    with pytest.raises(ValueError, match="kept by key"):
        tables.upsert(spark.createDataFrame([("a", "b")], "key string, value string"), path, "value")


def test_vectors_keep_the_tables_dimension(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *v: spark.createDataFrame(list(v), "id string, embedding array<double>")
    tables.upsert(rows(("a", [1.0, 2.0])), path, "id", vector="embedding")
    with pytest.raises(ValueError, match="3 to 3 dimensions for a table of 2"):
        tables.upsert(rows(("b", [1.0, 2.0, 3.0])), path, "id", vector="embedding")
    with pytest.raises(ValueError, match="1 to 2 dimensions"):
        tables.upsert(rows(("b", [1.0]), ("c", [1.0, 2.0])), path, "id", vector="embedding")
    tables.upsert(rows(("b", [3.0, 4.0])), path, "id", vector="embedding")
    assert tables.rows(spark, path).count() == 2 and tables.about(spark, path) == tables.About("id", 64, 2)


def plain_reuse(requests, ttl):
    out, stored = {}, {}
    for request, key, ts in sorted(requests, key=lambda r: (r[2], r[0])):
        hit = key in stored and (ts - stored[key][0]) / np.timedelta64(1, "s") < ttl
        if not hit:
            stored[key] = (ts, request)
        out[request] = (hit, stored[key][1])
    return out


def some_requests(n=300, seed=3):
    rng = np.random.default_rng(seed)
    start = np.datetime64("2024-01-01T00:00:00")
    return [(f"r{i:04d}", "abc"[rng.integers(0, 3)], start + np.timedelta64(int(rng.integers(0, 40_000)) // 50 * 50, "s")) for i in range(n)]


def as_frame(spark, requests):
    return spark.createDataFrame([(r, k, t.item()) for r, k, t in requests], "request_id string, cache_key string, ts timestamp")


def test_reuse_of_answers(spark):
    requests = some_requests()
    found = {r["request_id"]: (r["from_cache"], r["stored_by"]) for r in fusion.reuse_log(as_frame(spark, requests).repartition(5), 600).collect()}
    assert found == plain_reuse(requests, 600) and 30 < sum(h for h, _ in found.values()) < 290


def test_misses_are_answered_once(spark):
    requests = as_frame(spark, some_requests(60))
    asked = []

    def answer(queries):
        asked.append(sorted(r["query_id"] for r in queries.collect()))
        return queries.select("query_id", F.concat(F.lit("answer of "), "query_id").alias("answer"))

    rows = fusion.answer_requests(requests, 5000, answer).collect()
    assert len(rows) == 60 and asked == [sorted(r["request_id"] for r in rows if not r["from_cache"])]
    assert all(r["answer"] == f"answer of {r['stored_by']}" for r in rows)


def test_keys_tell_requests_apart(spark):
    rows = spark.createDataFrame([("q", "hybrid", 10, None), ("q", "vector", 10, None), ("q", "hybrid", 5, None), ("q", "hybrid", 10, "label=1"), ("q", "hybrid", 10, None)], "q string, m string, k int, f string")
    assert rows.select(fusion.cache_key(F.col("q"), F.col("m"), F.col("k"), F.col("f")).alias("key")).distinct().count() == 4


def test_an_upsert_writes_its_folders_only_and_deals_rows_once(spark, tmp_path):
    import os

    from sheaf.sources.scratch import scratch_dir

    held = lambda: set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    before, path = held(), str(tmp_path / "t")
    tables.upsert(spark.createDataFrame([("a", 1), ("a", 3), ("b", 9), (None, 1)], "k string, v int"), path, "k")
    tables.upsert(spark.createDataFrame([("b", 2), ("c", 1), ("c", 0)], "k string, v int"), path, "k")
    assert sorted((r["k"], r["v"]) for r in tables.rows(spark, path).collect()) == [("a", 3), ("b", 2), ("c", 1)]
    assert held() == before  # no copy of the rows beside the table
