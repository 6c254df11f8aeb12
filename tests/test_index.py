"""The stored index, refreshes, cells and block-wise neighbour search against plain searches."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.operators import bm25, index, vectors
from sheaf.plans import search
from sheaf.sources import scratch

WORDS = [f"w{i}" for i in range(60)]


def some_chunks(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, 61)
    rows = [(f"c{first + i:05d}", f"d{(first + i) // 3}", " ".join(WORDS[j] for j in rng.choice(60, rng.integers(0, 40), p=weight / weight.sum()))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string")


def asked(spark, n=25, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, " ".join(WORDS[j] for j in rng.integers(0, 60, rng.integers(1, 6)))) for i in range(n)] + [(n, "nothing here"), (n + 1, ""), (n + 2, "W0 w0 w1")], "query_id long, query string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_counts_in_a_row(spark):
    df = spark.createDataFrame([("a", "B a  b\nB"), ("b", ""), ("c", " x "), ("d", None)], "chunk_id string, content string")
    assert rows(bm25.postings(df)) == [("a", "a", 1), ("a", "b", 3), ("c", "x", 1)]


def test_terms_are_counted_a_batch_at_a_time(spark):
    """No sorting of a chunk's tokens by lambdas; white space as in Java's patterns, letters beyond ASCII, nulls, and what is carried."""
    df = spark.createDataFrame([("a", 1, "É\u00a0x\x0bB b\r\nÉ\u00a0X"), ("b", None, ""), ("c", 3, " \t"), ("d", 4, None), ("e", 5, "\U0001f600 ~ \U0001f600 z")], "chunk_id string, n int, content string")
    found = bm25.counted(df, ("n",))
    assert rows(found) == [("a", 1, 4, [("b", 2), ("é\u00a0x", 2)]), ("b", None, 0, []), ("c", 3, 0, []), ("d", 4, 0, []), ("e", 5, 4, [("z", 1), ("~", 1), ("\U0001f600", 2)])]
    assert "MapInArrow" in bm25.postings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert bm25.postings(df.limit(0)).count() == 0
    assert bm25.lengths(df).where("chunk_id = 'a'").first()["dl"] == 4


def test_refresh_by_postings_reads_texts_once(spark):
    old, new = some_chunks(spark, 60, 2), some_chunks(spark, 40, 3, first=50)
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    posted, dl = bm25.refresh(*bm25.stored(old), new.mapInPandas(passed, new.schema))
    now = old.where("chunk_id < 'c00050'").unionByName(new)
    assert rows(posted) == rows(bm25.postings(now)) and rows(dl) == rows(bm25.lengths(now))
    assert read.value == 40


@pytest.mark.parametrize("part_postings", [50, 200_000])
def test_search_of_the_index_equals_the_scan(spark, monkeypatch, part_postings):
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 4)
    chunks, queries = some_chunks(spark, 400, 1).repartition(3), asked(spark)
    stored = index.build(chunks)
    found = rows(index.search(stored, queries, 7, part_postings=part_postings))
    assert found == rows(bm25.search(chunks, queries, 7)) and len({q for q, *_ in found}) == 26


def test_refresh_adds_and_takes_away(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 4)
    old, new = some_chunks(spark, 300, 2), some_chunks(spark, 120, 3, first=240)  # sixty come again, with other texts
    newest = some_chunks(spark, 30, 4, first=200).unionByName(some_chunks(spark, 20, 9, first=250))
    stored = index.refreshed(index.refreshed(index.build(old), new), newest)
    now = old.where("chunk_id < 'c00240'").unionByName(new)
    now = now.join(newest.select("chunk_id"), "chunk_id", "left_anti").unionByName(newest)
    expected = rows(bm25.idf(now).select("term", "df", F.round("idf", 9)))
    assert rows(index.idf(stored).select("term", "df", F.round("idf", 9))) == expected
    assert rows(index.sizes(stored)) == [tuple(bm25.corpus_size(now).first())]
    assert rows(index.search(stored, asked(spark), 7)) == rows(bm25.search(now, asked(spark), 7))
    assert rows(index.chunk_rows(stored)) == rows(now.select("chunk_id", "document_id"))
    plan = index.idf(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in plan and "max_tf" not in plan  # statistics read no postings


def test_empty_index_and_empty_refresh(spark):
    none = some_chunks(spark, 0, 1)
    assert index.search(index.build(none), asked(spark), 5).count() == 0
    stored = index.build(some_chunks(spark, 50, 1))
    assert rows(index.search(index.refreshed(stored, none), asked(spark), 5)) == rows(index.search(stored, asked(spark), 5))


def test_copies_of_questions_do_not_grow_with_the_index(spark, monkeypatch):
    """Each task gets the questions once and meets its blocks some at a time; more tasks than STREAMS there are not, nor more questions than may take a turn."""
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 4)
    monkeypatch.setattr(index, "QUESTIONS", 10)
    monkeypatch.setattr(index, "STREAMS", 3)
    copies, passing = spark.sparkContext.accumulator(0), index.passing

    def counted(*args):
        go = passing(*args)

        def seen(batches):
            for batch in batches:
                copies.add(len(batch) - batch.column("_block").null_count)
                yield batch

        return lambda batches: go(seen(batches))

    monkeypatch.setattr(index, "passing", counted)
    chunks, queries = some_chunks(spark, 400, 1).repartition(3), asked(spark)
    stored, expected = index.build(chunks), rows(bm25.search(chunks, queries, 7))
    most = max(3, 2 * spark.sparkContext.defaultParallelism) * 3  # 28 questions are three rows
    for at_once in (64, 2, 1):  # questions in one, two and three turns
        monkeypatch.setattr(index, "ROWS_AT_ONCE", at_once)
        copies.value = 0
        assert rows(index.search(stored, queries, 7, part_postings=20)) == expected
        assert 0 < copies.value <= most


def test_blocks_that_cannot_reach_the_best_are_left_out():
    """One block has all good chunks; the others' bounds stay below the k-th score."""
    names = [(0, b, "", None, None, None, None, [f"{b}-{i}" for i in range(10)], [10] * 10, None) for b in range(50)]
    lists = [(0, b, "x", 9 if b == 7 else 1, 10, list(range(10)), [9 if b == 7 else 1] * 10, None, None, None) for b in range(50)]
    left = pd.DataFrame([(x[0], x[1], x[2], x[3], x[4], x[5], x[6], x[7], x[8], x[9]) for x in names + lists], columns=["batch", "block", "term", "max_tf", "min_dl", "pos", "tf", "ids", "dls", "dead"])
    read = []
    out = index.best_of(5, 10.0, read)(left, pd.DataFrame({"_block": [[{"query_id": 1, "term": "x", "w": 2.0}]]}))
    assert read == [(1, 7)] and out["chunk_id"].tolist() == [f"7-{i}" for i in range(5)]


def test_a_block_meets_its_questions_at_once():
    """Each block is scored once for all questions of a row, with the sums that a plain loop gives; dead chunks are left out."""
    rng = np.random.default_rng(3)
    dl = rng.integers(5, 50, (6, 20))
    held = {(b, t): np.flatnonzero(rng.random(20) < 0.5) for b in range(6) for t in "xyz"}
    tf = {key: rng.integers(1, 5, len(pos)) for key, pos in held.items()}
    names = [(0, b, "", None, None, None, None, [f"{b}-{i:02d}" for i in range(20)], dl[b].tolist(), ["1-03"] if b == 1 else None) for b in range(6)]
    lists = [(0, b, t, int(tf[b, t].max(initial=1)), int(dl[b][pos].min(initial=50)), pos, tf[b, t], None, None, None) for (b, t), pos in held.items() if len(pos)]
    left = pd.DataFrame(names + lists, columns=["batch", "block", "term", "max_tf", "min_dl", "pos", "tf", "ids", "dls", "dead"])
    weights = [{"query_id": q, "term": t, "w": 0.5 + q + i} for q in range(3) for i, t in enumerate("xyz"[: q + 1])] + [{"query_id": 1, "term": "none", "w": 1.0}]
    read = []
    out = index.best_of(200, 20.0, read)(left, pd.DataFrame({"_block": [weights]}))
    blocks = [b for _, b in read]
    assert len(read) == 18 and sum(a != b for a, b in zip(blocks, blocks[1:], strict=False)) == 5
    expected = {}
    for q, t, w in (x.values() for x in weights):
        for b in range(6):
            for i, f in zip(held.get((b, t), ()), tf.get((b, t), ()), strict=True):
                if (b, i) != (1, 3):
                    key = q, f"{b}-{i:02d}"
                    expected[key] = expected.get(key, 0.0) + w * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl[b][i] / 20.0))
    got = {(q, c): s for q, c, s in out.itertuples(index=False)}
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-6 for x in got)


def test_search_reads_its_terms_folders_and_no_texts(spark, sf):
    stored = search.index_of(spark, sf)
    one = spark.createDataFrame([(1, "the")], "query_id long, query string")
    plan = index.search(stored, one, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "documents.parquet" not in plan
    bucket = stored.postings.where("term = 'the'").select("bucket").distinct().collect()
    assert len(bucket) == 1 and str(bucket[0][0]) in re.search(r"PartitionFilters: \[([^\]]*bucket[^\]]*)", plan)[1]


def test_zero_padding_fills_up_by_id(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "apple" if i in (4, 7) else "pear") for i in range(9)], "chunk_id string, document_id string, content string")
    q = spark.createDataFrame([(1, "apple"), (2, "plum")], "query_id long, query string")
    found = rows(index.search(index.build(chunks), q, 4, pad_zero=True).select("query_id", "rank", "chunk_id", F.col("bm25") > 0))
    assert found == [(1, 1, "c4", True), (1, 2, "c7", True), (1, 3, "c0", False), (1, 4, "c1", False), *((2, i + 1, f"c{i}", False) for i in range(4))]


def test_kept_is_made_anew_when_the_table_changes(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or len(made)
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert [scratch.kept(spark, str(tmp_path / "t"), "x", make) for _ in range(2)] == [1, 1]
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert scratch.kept(spark, str(tmp_path / "t"), "x", make) == 2 and scratch.kept(spark, str(tmp_path / "t"), "y", make) == 3


def test_building_shuffles_no_postings(spark, monkeypatch):
    plans, write = [], index.written
    monkeypatch.setattr(index, "written", lambda df, name, *by: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name, *by))
    monkeypatch.setattr(index, "BLOCK_CHUNKS", 8)
    stored = index.build(some_chunks(spark, 100, 1).repartition(2))
    made = dict(plans)
    assert set(made) == {"index", "df", "size"} and "Aggregate" not in made["index"] and made["index"].count("Repartition") == 1
    sizes = [r["n"] for r in stored.forward.select(F.size("c").alias("n")).collect()]
    assert sum(sizes) == 100 and max(sizes) <= 8 and stored.postings.agg(F.sum("n")).first()[0] == bm25.postings(some_chunks(spark, 100, 1)).count()


# --- vectors


def grouped_vectors(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 4
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8))
    v[: n // 3] = v[0]  # a third of all are copies
    return spark.createDataFrame([(f"v{i:04d}", {"kind": str(i % 3)}, x.tolist()) for i, x in enumerate(v)], "id string, meta map<string,string>, embedding array<double>"), [(i, x.tolist()) for i, x in enumerate(centres[rng.integers(0, 12, 40)] + rng.normal(size=(40, 8)))] + [(40, None)]


@pytest.mark.parametrize("few", [0, 1024])
def test_questions_in_blocks_find_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "BLOCKS_AT_ONCE", 2)
    vecs, q = grouped_vectors(spark)
    queries = spark.createDataFrame(q, "query_id long, qvec array<double>")
    expected = rows(vectors.knn_sql(vecs, queries.where("qvec is not null"), 6).select("query_id", "id", "distance", "rank"))
    assert rows(vectors.knn(vecs, queries, 6, rows=5, few=few)) == expected
    only = vectors.knn(vecs, queries, 6, where={"meta.kind": "2"}, few=few)
    assert rows(only) == rows(vectors.knn_sql(vecs.where("meta['kind'] = '2'"), queries.where("qvec is not null"), 6).select("query_id", "id", "distance", "rank"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_of_question_vectors_do_not_grow_with_the_vectors(spark, monkeypatch, kind):
    """Parts of a few vectors each, but no more of them than STREAMS, and each gets the questions once."""
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "STREAMS", 3)
    copies, near = spark.sparkContext.accumulator(0), vectors.nearest(6, "l2sq")

    def counted(some, questions):
        if not questions.attrs.get("met"):
            questions.attrs["met"] = True
            copies.add(len(questions))
        return near(some, questions)

    vecs, q = grouped_vectors(spark)
    queries = spark.createDataFrame(q, "query_id long, qvec array<double>").where("qvec is not null").withColumn("query_id", F.col("query_id").cast(kind))
    found = vectors.ranked(counted, vecs.select("id", "embedding"), queries, 6, rows=5, few=0)
    assert rows(found) == rows(vectors.knn_sql(vecs, queries, 6).select("query_id", "id", "distance", "rank"))
    assert 0 < copies.value <= max(3, 2 * spark.sparkContext.defaultParallelism) * queries.count()


@pytest.mark.parametrize("few", [0, 1024])
def test_cells(spark, few):
    vecs, q = grouped_vectors(spark)
    queries = spark.createDataFrame(q, "query_id long, qvec array<double>")
    cells = vectors.build_cells(vecs, cells=20, sample=300)
    assert cells.stored.count() == 600 and cells.sizes.agg(F.sum("n")).first()[0] == 600
    found = vectors.knn_cells(cells, queries, 6, probes=4, rows=20, few=few)
    measured = vectors.recall(vecs, queries, found, 6).first()
    assert measured["n_questions"] == 40 and measured["recall"] >= 0.9 and vectors.probed_share(cells, queries, 4) < 0.5
    assert rows(vectors.knn_cells(cells, queries, 6, probes=20, rows=20, few=few)) == rows(vectors.knn(vecs, queries, 6))  # all cells: exact
    plan = vectors.knn_cells(cells, queries.limit(1), 6, probes=1, few=1024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan


def test_cells_of_nothing(spark):
    vecs, q = grouped_vectors(spark)
    queries = spark.createDataFrame(q, "query_id long, qvec array<double>")
    cells = vectors.build_cells(vecs.limit(0))
    assert vectors.knn_cells(cells, queries, 3).count() == 0 and vectors.probed_share(cells, queries, 3) == 0.0
    assert vectors.knn_cells(vectors.build_cells(vecs), queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("few", [3, 1024])
def test_lsh_makes_no_pairs_as_rows(spark, few):
    """The pairs of Spark's own join of buckets, found without exploding or shuffling vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    vecs, q = grouped_vectors(spark, 200)
    queries = spark.createDataFrame(q, "query_id long, qvec array<double>").where("qvec is not null")
    found = vectors.knn_lsh(vecs, queries, 5, width=2.0, tables=2, rows=50, few=few)
    a, b = vecs.select("id", array_to_vector("embedding").alias("f")), queries.select("query_id", array_to_vector("qvec").alias("f"))
    pairs = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=2.0, numHashTables=2, seed=11).fit(a).approxSimilarityJoin(a, b, float("inf"), "d")
    scored = pairs.select(F.col("datasetB.query_id"), F.col("datasetA.id"), F.round(F.col("d") * F.col("d"), 6).alias("distance"))
    best = sorted(map(tuple, scored.collect()), key=lambda x: (x[0], x[2], x[1]))
    expected = [x for i, x in enumerate(best) if i < 5 or best[i - 5][0] != x[0]]
    assert sorted(map(tuple, found.select("query_id", "id", "distance").collect())) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and ("Generate" not in plan or few == 3)
