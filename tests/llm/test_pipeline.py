"""The pipeline's stages, one after another, against brute force on the smallest tables."""

import collections

import corpus_pipeline
from sheaf.llm import bpe, mixing
from tests.llm.test_operators import SCHEMA, odd_rows, py_classes, shared_run_dedup


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    clean, cut, single, mixed, encoded = seen
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in clean}) <= 0.3 * len(toxic) and len(clean) >= 0.8 * spark.read.parquet(f"{sf}/documents.parquet").count()
    texts = {r["doc_id"]: r["text"] for r in cut}
    assert texts == shared_run_dedup({r["doc_id"]: r["text"] for r in clean}) and all(r["n_chars"] == len(r["text"]) for r in cut)
    assert {r["doc_id"] for r in single} == {c for c, _ in py_classes(texts).values()}
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in single}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in single:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
    names = sorted(sizes)
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])))
    largest = max(len(r["text"].split()) for r in single)
    assert all(abs(taken[s] - wanted[s]) <= largest for s in names)
    assert collections.Counter(r["doc_id"] for r in encoded) == times
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    final = {r["doc_id"]: r["text"] for r in mixed}
    assert all(r["ids"] == library.encode(final[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in encoded)


def test_run_is_repeatable(spark, sf):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert a == b and a


def through_all_stages(spark, docs, sf, folder):
    columns, n = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        n.append(docs.count())
    return n, docs


def test_odd_rows_pass_all_stages(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns named like the stages' own."""
    rows = odd_rows()
    n, out = through_all_stages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf, tmp_path)
    texts = {r[1] for r in rows}
    assert n[0] == n[1] and n[1] >= 0.8 * len(rows) and n[2] <= len(texts) and n[3] == n[4] <= 3 * n[2]
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}
    kept = spark.read.parquet(str(tmp_path / "line dedup")).collect()
    assert {r["_doc"] for r in kept} == {"clash", "x", None} and {r["class_id"] for r in kept} == {2, 0, None}


def test_the_empty_table_passes_all_stages(spark, sf, tmp_path):
    n, _ = through_all_stages(spark, spark.createDataFrame([], SCHEMA), sf, tmp_path)
    assert n == [0] * 5
