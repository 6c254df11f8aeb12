"""Fusion of vector and keyword results, confidence, sources and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from . import bm25, index, vectors
from .chunking import smart_chunks


def top(rows: DataFrame, k: int, score: str, key: str = "query_id") -> DataFrame:
    """The k best of each question, ties by id."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), "id"))).where(F.col("rank") <= k)


def hybrid(vector_rows: DataFrame, keyword_rows: DataFrame, k: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, both_bonus: float = 1.2, fusion: str = "weighted") -> DataFrame:
    """Full outer union by id: weighted scores, a bonus for what both sides found, and a label.

    vector_rows: query_id, id, distance, rank; keyword_rows: query_id, id, bm25, rank. fusion="rrf" adds
    1 / (rank + 1) of each side instead.
    """
    v = vector_rows.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.col("distance")))).alias("vector_score"), F.col("rank").alias("vector_rank"))
    w = keyword_rows.select("query_id", "id", F.least(F.col("bm25") / 15, F.lit(1.0)).alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    joined = v.join(w, ["query_id", "id"], "full")
    in_both = F.col("vector_score").isNotNull() & F.col("keyword_score").isNotNull()
    if fusion == "rrf":
        score = F.coalesce(1 / (F.col("vector_rank") + 1), F.lit(0.0)) + F.coalesce(1 / (F.col("keyword_rank") + 1), F.lit(0.0))
    else:
        score = (vector_weight * F.coalesce("vector_score", F.lit(0.0)) + keyword_weight * F.coalesce("keyword_score", F.lit(0.0))) * F.when(in_both, both_bonus).otherwise(1.0)
    label = F.when(in_both, "hybrid").when(F.col("vector_score").isNotNull(), "vector").otherwise("keyword")
    scored = joined.select("query_id", "id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.round(score, 6).alias("hybrid_score"), label.alias("source"))
    return top(scored, k, "hybrid_score")


def union_fusion(vector_rows: DataFrame, keyword_rows: DataFrame, k: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Union without merging ids: ((score + 0.1 x rank share) / 1.1) x weight; an id may stand twice."""
    def side(rows: DataFrame, weight: float, source: str) -> DataFrame:
        share = F.greatest(F.lit(0.0), (F.lit(11) - F.col("rank")) / 10.0)
        return rows.select("query_id", "id", F.round((F.col("score") + 0.1 * share) / 1.1 * weight, 6).alias("combined_score"), F.lit(source).alias("source"))

    both = side(vector_rows, vector_weight, "vector").unionByName(side(keyword_rows, keyword_weight, "keyword"))
    order = W.partitionBy("query_id").orderBy(F.desc("combined_score"), "id", "source")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_confidence(queries: DataFrame, best: DataFrame) -> DataFrame:
    """best: query_id, v, w: the best score of a search by vectors and of one by keywords (over 1: divided by 15). A question that is not there has 0."""
    kw = F.when(F.col("w") > 1, F.least(F.col("w") / 15, F.lit(1.0))).otherwise(F.col("w"))
    rows = queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce(kw, F.lit(0.0)).alias("w"))
    base = F.greatest("v", "w")
    base = F.when((F.col("v") > 0.3) & (F.col("w") > 0.3), F.greatest(base, 1.1 * (0.7 * F.col("v") + 0.3 * F.col("w")))).otherwise(base)
    base = F.when((F.col("v") > 0.1) & (F.col("w") > 0.1), base * 1.05).otherwise(base)
    return rows.select("query_id", F.least(base, F.lit(1.0)).alias("confidence"))


def generic_confidence(queries: DataFrame, results: DataFrame, score: str = "score") -> DataFrame:
    """Mean of the best three scores, raised by 5 % for each result over 0.1, by 20 % at most; 0 without results."""
    ranked = results.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "id")))
    agg = ranked.groupBy("query_id").agg(F.avg(F.when(F.col("_n") <= 3, F.col(score))).alias("_mean"), F.count_if(F.col(score) > 0.1).alias("_over"))
    conf = F.least(F.col("_mean") * F.least(F.lit(1.2), 1 + 0.05 * F.col("_over")), F.lit(1.0))
    return queries.select("query_id").join(agg, "query_id", "left").select("query_id", F.when(F.col("_mean").isNull(), 0.0).otherwise(conf).alias("confidence"))


def band(confidence: Column, threshold: float = 0.3, high: float = 0.7) -> Column:
    return F.when(confidence < threshold, "low").when(confidence > high, "high").otherwise("medium")


def unique_sources(results: DataFrame, first: int = 5, keep: int = 3) -> DataFrame:
    """Of the first results the best of each file, the first few of them. results: query_id, rank, file_name, ..."""
    head = results.where(F.col("rank") <= first)
    best = head.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "file_name").orderBy("rank"))).where("_n = 1").drop("_n")
    return best.withColumn("source_rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("source_rank") <= keep)


def source_lists(sources: DataFrame) -> DataFrame:
    """query_id, sources (one line each: preview, file, agency, score) and context (the contents with blank lines between)."""
    line = F.concat_ws(" | ", F.concat(F.substring("content", 1, 200), F.lit("...")), "file_name", F.coalesce("agency", F.lit("Unknown")), F.col("score").cast("decimal(12,6)").cast("string"))
    rows = sources.select("query_id", F.struct("source_rank", line.alias("line"), "content").alias("s"))
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list("s")).alias("_s")).select(
        "query_id", F.size("_s").alias("n_sources"),
        F.array_join(F.transform("_s", lambda x: x["line"]), "\n").alias("sources"), F.array_join(F.transform("_s", lambda x: x["content"]), "\n\n").alias("context"),
    )


def extractive_answer(content: Column, confidence: Column, threshold: float = 0.3) -> Column:
    """The canned answer below the threshold, else the first 500 characters of the best chunk in a template."""
    return F.when((confidence < threshold) | content.isNull(), F.lit("No sufficiently relevant document was found.")).otherwise(F.concat(F.lit("From the documents: "), F.substring(content, 1, 500), F.lit("...")))


def fallback_answer(context: Column, characters: int = 1000) -> Column:
    """Where no model answers: the beginning of what was found, to be read directly."""
    return F.concat(F.lit("From the documents found:\n\n"), F.substring(context, 1, characters), F.lit("...\n\nNo model was reached; please read the documents."))


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context only.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def search(chunks: DataFrame | index.Index, vecs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, method: str = "hybrid", cut: Callable[[DataFrame], DataFrame] = smart_chunks) -> DataFrame:
    """query_id, rank, id, document_id, scores, label, content, file_name, agency: the search of all questions, by both sides or by one.

    A vector belongs to a document; it stands for the document's first chunk. best_vector and best_keyword are the
    question's best scores in a search by vectors alone (1 / (1 + distance)) and by keywords alone (BM25 / 10).
    The two sides' scans are written when this is called: one over the chunks, one over the vectors. `cut` made the chunks of
    the corpus; instead of them it can be their stored index, with section_index and chunk_index carried, which is read only where it has the
    questions' terms.
    """
    near = written(vectors.knn(vecs, queries, 2 * k), "neighbours")
    if isinstance(chunks, index.Index):
        ids, by_terms = index.chunk_rows(chunks, ("document_id", "section_index", "chunk_index")), index.search(chunks, queries, 2 * k)
    else:
        held = bm25.matches(chunks, queries, ("document_id", "section_index", "chunk_index"))
        ids, by_terms = held.where("term = ''").select("chunk_id", "document_id", "section_index", "chunk_index"), bm25.ranked(held, queries, 2 * k)
    first = ids.where("section_index = 0 and chunk_index = 0").select(F.col("document_id").alias("vid"), "chunk_id")
    n = queries.count()
    v = first.join(bm25.small(near, 2 * k * n), F.col("id") == F.col("vid")).select("query_id", F.col("chunk_id").alias("id"), "distance", "rank")
    w = written(by_terms, "keywords").select("query_id", F.col("chunk_id").alias("id"), "bm25", "rank")
    _, score = vectors.score_of(F.col("distance"))
    best = near.where("rank = 1").select("query_id", score.alias("best_vector")).join(w.where("rank = 1").select("query_id", F.least(F.col("bm25") / 10, F.lit(1.0)).alias("best_keyword")), "query_id", "full")
    if method == "hybrid":
        fused = hybrid(v, w, k)
    elif method == "vector":
        fused = top(v.select("query_id", "id", score.alias("vector_score"), F.lit(0.0).alias("keyword_score"), F.round(score, 6).alias("hybrid_score"), F.lit("vector").alias("source")), k, "hybrid_score")
    elif method == "keyword":
        kw = F.least(F.col("bm25") / 10, F.lit(1.0))
        ordered = w.where(F.col("rank") <= k)
        fused = ordered.select("query_id", "id", F.lit(0.0).alias("vector_score"), kw.alias("keyword_score"), F.round(kw, 6).alias("hybrid_score"), F.lit("keyword").alias("source"), "rank")
    else:
        raise ValueError(f"unknown method {method}")
    fused = written(fused, "fused")
    of = ids.join(bm25.small(fused.select(F.col("id").alias("chunk_id")).distinct(), k * n), "chunk_id", "left_semi")
    rows = bm25.contents(fused, of, k * n, corpus, cut)
    named = corpus.select("document_id", "file_name", "agency").join(bm25.small(of.select("document_id").distinct(), k * n), "document_id", "left_semi")
    return rows.join(named, "document_id").join(best, "query_id").select("query_id", "id", "vector_score", "keyword_score", "hybrid_score", "source", "rank", "document_id", "content", "file_name", "agency", "best_vector", "best_keyword")


def confidence_of(queries: DataFrame, results: DataFrame, method: str = "hybrid") -> DataFrame:
    """query_id, confidence: of a search by both sides from the best of each alone, of one side from its best three. 0 without results."""
    if method != "hybrid":
        return generic_confidence(queries, results, f"{method}_score")
    return hybrid_confidence(queries, results.groupBy("query_id").agg(F.max("best_vector").alias("v"), F.max("best_keyword").alias("w")))


def answers(queries: DataFrame, results: DataFrame, method: str = "hybrid") -> DataFrame:
    """One row for each question: answer, confidence, band, sources and the number of results. results: of a search by the method."""
    best = results.groupBy("query_id").agg(F.min_by("content", "rank").alias("best"), F.count(F.lit(1)).alias("total_results"))
    lists = source_lists(unique_sources(results.withColumn("score", F.col("hybrid_score"))))
    rows = queries.select("query_id", "query").join(confidence_of(queries, results, method), "query_id").join(best, "query_id", "left").join(lists, "query_id", "left")
    c = F.round("confidence", 6)
    return rows.select(
        "query_id", "query", extractive_answer(F.col("best"), F.col("confidence")).alias("answer"), c.alias("confidence"), band(F.col("confidence")).alias("answer_confidence"), F.lit(method).alias("search_method"),
        F.when(F.col("confidence") >= 0.3, F.coalesce("sources", F.lit(""))).otherwise(F.lit("")).alias("sources"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.coalesce("total_results", F.lit(0)).cast("long").alias("total_results"),
    )


def search_and_answer(chunks: DataFrame | index.Index, vecs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """The answers of all questions. With a column search_method each question is asked by its own (an unknown one or null: hybrid)."""
    def by(asked: DataFrame, method: str) -> DataFrame:
        found = written(search(chunks, vecs, asked, corpus, k, method), "results")
        return answers(asked, found, method)

    if "search_method" not in queries.columns:
        return by(queries, "hybrid")
    sides = F.col("search_method").isin("vector", "keyword")
    parts = [by(queries.where(F.col("search_method") == m), m) for m in ("vector", "keyword")]
    return by(queries.where(~F.coalesce(sides, F.lit(False))), "hybrid").unionByName(parts[0]).unionByName(parts[1])


def reuse(queries: DataFrame, stored: DataFrame, now: Column, ttl_seconds: int, keys: list[str]) -> DataFrame:
    """queries with from_cache and the stored answer: the newest one of the same key that is young enough."""
    young = stored.where(F.unix_timestamp("ts") > F.unix_timestamp(now) - ttl_seconds)
    latest = young.groupBy("cache_key").agg(F.max_by("answer", F.struct("ts", "answer")).alias("stored_answer"))
    keyed = queries.withColumn("cache_key", F.md5(F.concat_ws("|", *keys)))
    return keyed.join(latest, "cache_key", "left").withColumn("from_cache", F.col("stored_answer").isNotNull())


def cache_key(query: Column, method: Column, k: Column, filters: Column | None = None) -> Column:
    """What two requests must share to share an answer: method, question, number of results and filters."""
    return F.md5(F.concat_ws("_", method, query, k.cast("string"), F.coalesce(filters if filters is not None else F.lit(None).cast("string"), F.lit(""))))


def reuse_log(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """request_id, cache_key, ts, from_cache, stored_by: whether a request finds an answer that an earlier one of its key stored less
    than ttl_seconds before, and which one; else it stores its own. requests: request_id, cache_key, ts (ties by request_id).

    A key's requests pass through a task one by one, however many they are.
    """
    kind = requests.schema["request_id"].dataType.simpleString()

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since, by = None, None, None
        for pdf in batches:
            hits, owners = [], []
            for k, ts, rid in zip(pdf["cache_key"], pdf["ts"], pdf["request_id"], strict=True):
                if k != key or (ts - since).total_seconds() >= ttl_seconds:
                    key, since, by = k, ts, rid
                    hits.append(False)
                else:
                    hits.append(True)
                owners.append(by)
            yield pdf.assign(from_cache=hits, stored_by=owners)

    sorted_ = requests.select("request_id", "cache_key", F.col("ts").cast("timestamp_ntz").alias("ts")).repartition("cache_key").sortWithinPartitions("cache_key", "ts", "request_id")
    return sorted_.mapInPandas(passed, f"request_id {kind}, cache_key string, ts timestamp_ntz, from_cache boolean, stored_by {kind}")


def answer_requests(requests: DataFrame, ttl_seconds: int, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """reuse_log with the answers: misses are searched for, each once, and what a hit finds is its miss's answer.

    requests: also query and what else `answer` takes (query_id is the request's); answer gives a row for each query_id.
    """
    log = written(reuse_log(requests, ttl_seconds), "requests")
    missed = requests.join(log.where(~F.col("from_cache")).select("request_id"), "request_id", "left_semi")
    found = answer(missed.withColumn("query_id", F.col("request_id")))
    return log.join(found.withColumnRenamed("query_id", "stored_by"), "stored_by")


def evaluation(answers: DataFrame, by: str = "answer_confidence") -> DataFrame:
    """Means per group and over all."""
    agg = answers.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("n_sources"), 6).alias("mean_sources"))
    return agg.withColumn(by, F.coalesce(by, F.lit("all")))
