"""Queries over chunks, vectors and questions: search, fusion, answers, query enhancement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, bm25, chunking, enhance, fusion, index, tables, vectors
from ..sources.scratch import kept, scratch_path, written
from ..sources.tables import corpus, questions, search_log, table, turns
from ..sources.tables import vectors as vector_table
from .base import Query, quoted, search_again, sql

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def chunks_of(spark, d):
    return chunking.smart_chunks(corpus(spark, d))


#: What the index keeps of a chunk besides its terms.
CARRIED = ("document_id", "section_index", "chunk_index")


def index_of(spark, d):
    """The stored index of the documents' chunks, built once for a session and a state of the table."""
    return kept(spark, f"{d}/documents.parquet", "index", lambda: index.build(chunks_of(spark, d), CARRIED))


# --- vectors


@query("e2_dimensions", "select count(*) n, min(len(embedding)) low, max(len(embedding)) high from embeddings")
def e2(spark, d):
    vecs = vector_table(spark, d)
    n = vectors.check_dimension(vecs)
    return vecs.agg(F.count(F.lit(1)).alias("n"), F.lit(n).alias("low"), F.max(F.size("embedding")).alias("high"))


@query("e2_upsert_vectors", "select cast(vec_id as varchar) id, label + case when vec_id % 3 = 0 then 100 else 0 end label, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 5) total from embeddings")
def e2_upsert(spark, d):
    """Two thirds of the vectors, then the third third again with the rest of it, with other labels; then none."""
    vecs, path = vector_table(spark, d), scratch_path(spark, "vectors")
    third = F.col("id").cast("long") % 3
    tables.upsert(vecs.where((third != 0) | (F.col("id").cast("long") % 2 == 0)), path, "id", vector="embedding")
    tables.upsert(vecs.where(third == 0).withColumn("label", F.col("label") + 100), path, "id", vector="embedding")
    tables.upsert(vecs.limit(0), path, "id", vector="embedding")
    return tables.rows(spark, path).select("id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("e3_knn", sql("select query_id, id, distance, rank from nn where rank <= 10", "nn"))
def e3(spark, d):
    return vectors.knn(vector_table(spark, d), questions(spark, d), 10)


@query("e3_knn_sql", sql("select query_id, id, distance, rank from nn where rank <= 10", "nn"))
def e3_sql(spark, d):
    return vectors.knn_sql(vector_table(spark, d), questions(spark, d), 10)


@query("e4_knn_filtered", sql("select query_id, id, distance, rank from (select query_id, id, distance, row_number() over (partition by query_id order by distance, id) rank from dists where label = 1) where rank <= 5", "dists"))
def e4(spark, d):
    return vectors.knn(vector_table(spark, d), questions(spark, d), 5, where={"label": 1})


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: cast(p[1] as double) * cast(p[2] as double)))"


@query("e5_knn_cosine", sql("select * from (select query_id, id, distance, row_number() over (partition by query_id order by distance, id) rank from c) where rank <= 10", "questions", c=f"select query_id, cast(vec_id as varchar) id, round(1 - {_DOT.format('embedding', 'qvec')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('qvec', 'qvec')})), 6) + 0.0 distance from questions, embeddings"))
def e5(spark, d):
    return vectors.knn(vector_table(spark, d), questions(spark, d), 10, "cosine")


@query("e6_e7_vector_search", sql("select query_id, rank, id, distance, case when distance <= 1 then 1 - distance else 0.0 end similarity, round(1 / (1 + distance), 6) vector_score from nn where rank <= 10", "nn"))
def e7(spark, d):
    return vectors.vector_search(vector_table(spark, d), questions(spark, d), 10).withColumn("vector_score", F.round("vector_score", 6))


@query("e8_collection_stats", sql("select count(*) n_rows, count(distinct file_name) n_files from named join corpus using (document_id)", "named", "corpus"))
def e8(spark, d):
    return vectors.collection_stats(chunks_of(spark, d), corpus(spark, d))


@query("e8_distinct_sketches", sql("select source_type, count(*) n_rows, true near_exact, true merged_is_direct from named join corpus using (document_id) group by 1", "named", "corpus"))
def e8_sketches(spark, d):
    """Distinct files of the chunk table by sketches: a row for each batch, merged, against the exact count and one sketch over all."""
    rows = chunks_of(spark, d).select("document_id").join(corpus(spark, d).select("document_id", "file_name", "source_type", (F.col("document_id").cast("long") % 7).alias("batch")), "document_id")
    rows = written(rows.select("source_type", "file_name", "batch"), "names")
    merged = analytics.merged_distinct(analytics.distinct_sketches(rows, "file_name", ["source_type", "batch"]), ["source_type"])
    direct = rows.groupBy("source_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file_name").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("file_name", analytics.SKETCH_BITS)).alias("direct"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 3 * analytics.sketch_error())
    same = F.abs(F.col("distinct") - F.col("direct")) <= F.greatest(F.lit(1.0), F.col("direct") * analytics.sketch_error())
    return direct.join(merged, "source_type").select("source_type", "n_rows", near.alias("near_exact"), same.alias("merged_is_direct"))


@query("e1_embed")
def e1(spark, d):
    rows = vectors.embed(corpus(spark, d).select("document_id", "content"))
    return rows.select("document_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("e9_knn_lsh")
def e9(spark, d):
    return vectors.knn_lsh(vector_table(spark, d), questions(spark, d), 10)


def profiles(spark, d):
    """The documents' letter profiles (id, embedding), which stand in groups, and the questions' (query_id, qvec)."""
    asked = vectors.letter_profile(questions(spark, d), "query").select("query_id", F.col("embedding").alias("qvec"))
    docs = vectors.letter_profile(corpus(spark, d).select("document_id", "content"))
    return written(docs.select(F.col("document_id").alias("id"), "embedding"), "vectors"), written(asked, "asked")


#: Cells that a question looks into, of 100.
PROBED = 12


@query("e9_knn_cells")
def e9_cells(spark, d):
    docs, asked = profiles(spark, d)
    cells = vectors.build_cells(docs)
    return vectors.knn_cells(cells, asked, 10, -(-len(cells.middles) * PROBED // 100))


@query("e9_cells_recall", "select count(*) n_questions, true recall_ok, true share_ok, (select count(*) from documents) n_indexed from benchmark")
def e9_recall(spark, d):
    docs, asked = profiles(spark, d)
    cells = vectors.build_cells(docs)
    probes = -(-len(cells.middles) * PROBED // 100)
    measured = vectors.recall(docs, asked, vectors.knn_cells(cells, asked, 10, probes), 10)
    indexed = cells.sizes.agg(F.sum("n").alias("n_indexed"))
    share = vectors.probed_share(cells, asked, probes)
    return measured.crossJoin(indexed).select("n_questions", (F.col("recall") >= 0.9).alias("recall_ok"), F.lit(share <= 0.25).alias("share_ok"), "n_indexed")  # one row each


# --- keywords


@query("f1_postings", sql("select chunk_id, term, tf from postings", "postings"))
def f1(spark, d):
    return bm25.postings(chunks_of(spark, d))


@query("f2_lengths", sql("select n, round(avgdl, 6) avgdl from size", "size"))
def f2(spark, d):
    return bm25.corpus_size(chunks_of(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query("f3_idf", sql("select term, df, round(idf, 6) idf from idf", "idf"))
def f3(spark, d):
    return bm25.idf(chunks_of(spark, d)).withColumn("idf", F.round("idf", 6))


@query("f4_bm25", sql("select query_id, chunk_id, bm25, rank from kw where rank <= 10", "kw"))
def f4(spark, d):
    return index.search(index_of(spark, d), questions(spark, d), 10)


@query("f4_bm25_scan", sql("select query_id, chunk_id, bm25, rank from kw where rank <= 10", "kw"))
def f4_scan(spark, d):
    return bm25.search(chunks_of(spark, d), questions(spark, d), 10)


#: Questions of one word, the last of each, which few chunks hold.
_LAST = search_again("select query_id, regexp_extract(query, '(\\S+)\\s*$', 1) query, qvec from questions", "1")
_PADDED = "select q.query_id, n.chunk_id, coalesce(s.bm25, 0.0) bm25 from questions1 q cross join named n left join scored1 s on s.query_id = q.query_id and s.chunk_id = n.chunk_id"


@query("f4_zero_padded", sql("select query_id, chunk_id, bm25, rank from (select *, row_number() over (partition by query_id order by bm25 desc, chunk_id) rank from padded) where rank <= 20", "questions", "postings", "idf", "lens", "size", "named", **{k: _LAST[k] for k in ("questions1", "qterms1", "scored1")}, padded=_PADDED))
def f4_padded(spark, d):
    asked = questions(spark, d).withColumn("query", F.regexp_extract("query", r"(\S+)\s*$", 1))
    return index.search(index_of(spark, d), asked, 20, pad_zero=True)


@query("f5_keyword_search", sql("select query_id, rank, chunk_id id, document_id, bm25, round(least(bm25 / 10, 1.0), 6) keyword_score, md5(content) content_md5 from kw join named using (chunk_id) where rank <= 10", "kw", "named"))
def f5(spark, d):
    rows = index.keyword_search(index_of(spark, d), questions(spark, d), corpus(spark, d), 10)
    return rows.withColumns({"content_md5": F.md5("content"), "keyword_score": F.round("keyword_score", 6)}).drop("content")


@query("f6_index_input", sql("select chunk_id, document_id, case when section_index % 3 = 1 then 'own' when section_index % 3 = 0 and doc_id is not null then 'label' when section_index % 3 = 2 and doc_id is not null then 'label' else 'none' end origin from named left join (select distinct doc_id from labels) on document_id = cast(doc_id as varchar)", "named"))
def f6(spark, d):
    rows = chunks_of(spark, d).select("chunk_id", "document_id", "section_index")
    section = F.col("section_index") % 3  # some chunks have metadata, some have broken metadata, some none
    own = rows.where(section > 0).select("chunk_id", F.when(section == 1, '{"origin": "own"}').otherwise('{"origin').alias("chunk_json"))
    of_doc = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.lit('{"origin": "label"}').alias("doc_json")).distinct()
    return bm25.index_input(rows.drop("section_index"), own, of_doc).select("chunk_id", "document_id", F.coalesce(F.try_element_at("metadata", F.lit("origin")), F.lit("none")).alias("origin"))


@query("f7_refresh", sql("select term, df, round(idf, 6) idf, round(avgdl, 6) avgdl from idf, size", "idf", "size"))
def f7(spark, d):
    found = index_in_two_batches(spark, d)
    return index.idf(found).crossJoin(F.broadcast(index.sizes(found).select("avgdl"))).select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))  # one row


def index_in_two_batches(spark, d):
    """First the labelled documents; then all others, and chunks that come again."""
    chunks = chunks_of(spark, d)
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    stored = chunks.join(labelled, "document_id", "left_semi")
    later = chunks.join(labelled, "document_id", "left_anti").unionByName(stored.where("section_index = 0"))
    return kept(spark, f"{d}/documents.parquet", "index in two batches", lambda: index.refreshed(index.build(stored, CARRIED), later, CARRIED))


@query("f7_search_refreshed", sql("select query_id, chunk_id, bm25, rank from kw where rank <= 10", "kw"))
def f7_search(spark, d):
    return index.search(index_in_two_batches(spark, d), questions(spark, d), 10)


@query("f7_refresh_by_postings", sql("select term, df, round(idf, 6) idf, round(avgdl, 6) avgdl from idf, size", "idf", "size"))
def f7_postings(spark, d):
    chunks = chunks_of(spark, d)
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    stored = chunks.join(labelled, "document_id", "left_semi")
    posted, dl = bm25.stored(stored)
    later = chunks.join(labelled, "document_id", "left_anti").unionByName(stored.where("section_index = 0"))  # new documents, and chunks that come again
    posted, dl = bm25.refresh(posted, dl, later)
    return bm25.idf_of(posted, dl).crossJoin(F.broadcast(bm25.size_of(dl).select("avgdl"))).select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))  # one row


# --- fusion and answers


def results_of(spark, d):
    return fusion.search(index_of(spark, d), vector_table(spark, d), questions(spark, d), corpus(spark, d), 10)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("g1_hybrid", sql("select query_id, id, round(vector_score, 6) vector_score, round(keyword_score, 6) keyword_score, hybrid_score, source, rank from fused", "fused"))
def g1(spark, d):
    rows = results_of(spark, d).select("query_id", "id", "vector_score", "keyword_score", "hybrid_score", "source", "rank")
    return rounded(rows, "vector_score", "keyword_score")


_SIDE = "select query_id, id, round(({0} + 0.1 * greatest(0, (11 - rank) / 10.0)) / 1.1 * {1}, 6) combined_score, '{2}' source from {3} where rank <= 10"


@query("g2_union_fusion", sql("select * from (select *, row_number() over (partition by query_id order by combined_score desc, id, source) rank from u) where rank <= 10", "nn", "kw", u=_SIDE.format("greatest(0.0, least(1.0, 1 / (1 + distance)))", 0.7, "vector", "nn") + " union all " + _SIDE.replace(" id,", " chunk_id id,").format("greatest(0.0, least(1.0, bm25 / 15))", 0.3, "keyword", "kw")))
def g2(spark, d):
    _, score = vectors.score_of(F.col("distance"))
    v = vectors.knn(vector_table(spark, d), questions(spark, d), 10).select("query_id", "id", "rank", score.alias("score"))
    w = index.search(index_of(spark, d), questions(spark, d), 10).select("query_id", F.col("chunk_id").alias("id"), "rank", F.least(F.col("bm25") / 15, F.lit(1.0)).alias("score"))
    return fusion.union_fusion(v, w, 10)


@query("g3_hybrid_confidence", sql("select query_id, round(confidence, 6) confidence from conf", "conf"))
def g3(spark, d):
    return rounded(fusion.confidence_of(questions(spark, d), results_of(spark, d)), "confidence")


@query("g4_generic_confidence", sql("select query_id, round(case when m is null then 0.0 else least(m * least(1.2, 1 + 0.05 * o), 1.0) end, 6) confidence from questions left join (select query_id, avg(hybrid_score) filter (rank <= 3) m, count(*) filter (hybrid_score > 0.1) o from fused group by 1) using (query_id)", "questions", "fused"))
def g4(spark, d):
    return rounded(fusion.generic_confidence(questions(spark, d), results_of(spark, d), "hybrid_score"), "confidence")


@query("g5_bands", sql("select query_id, case when confidence < 0.3 then 'low' when confidence > 0.7 then 'high' else 'medium' end band from conf", "conf"))
def g5(spark, d):
    return fusion.confidence_of(questions(spark, d), results_of(spark, d)).select("query_id", fusion.band(F.col("confidence")).alias("band"))


@query("g6_unique_sources", sql("select query_id, source_rank, rank, file_name from firsts", "firsts"))
def g6(spark, d):
    return fusion.unique_sources(results_of(spark, d)).select("query_id", "source_rank", "rank", "file_name")


@query("g7_g8_sources", sql("select query_id, n_sources, md5(sources) sources_md5, md5('Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') prompt_md5 from listed join questions using (query_id)", "listed", "questions"))
def g7(spark, d):
    rows = fusion.source_lists(fusion.unique_sources(results_of(spark, d).withColumn("score", F.col("hybrid_score")))).join(questions(spark, d), "query_id")
    return rows.select("query_id", "n_sources", F.md5("sources").alias("sources_md5"), F.md5(fusion.prompt(F.col("query"), F.col("context"))).alias("prompt_md5"))


@query("g9_fallback", sql("select query_id, md5('From the documents found:' || chr(10) || chr(10) || substr(context, 1, 1000) || '...' || chr(10) || chr(10) || 'No model was reached; please read the documents.') answer_md5 from listed", "listed"))
def g9_fallback(spark, d):
    lists = fusion.source_lists(fusion.unique_sources(results_of(spark, d).withColumn("score", F.col("hybrid_score"))))
    return lists.select("query_id", F.md5(fusion.fallback_answer(F.col("context"))).alias("answer_md5"))


@query("g10_search_and_answer", sql("select query_id, query, answer, confidence, answer_confidence, search_method, sources, n_sources, total_results from answered", "answered"))
def g10(spark, d):
    return fusion.search_and_answer(index_of(spark, d), vector_table(spark, d), questions(spark, d), corpus(spark, d))


_METHODS = {
    "method": "select query_id, query, case query_id % 4 when 0 then 'vector' when 1 then 'keyword' when 2 then 'hybrid' else 'hybrid' end m from questions",
    "vector_rows": "select query_id, id, 1 / (1 + distance) s, row_number() over (partition by query_id order by round(1 / (1 + distance), 6) desc, id) rank from v20 where query_id in (select query_id from method where m = 'vector')",
    "keyword_rows": "select query_id, id, least(bm25 / 10, 1.0) s, rank from k20 where query_id in (select query_id from method where m = 'keyword')",
    "one_side": "select query_id, least(avg(s) filter (n <= 3) * least(1.2, 1 + 0.05 * count(*) filter (s > 0.1)), 1.0) c, count(*) total_results from (select *, row_number() over (partition by query_id order by s desc, id) n from (select * from vector_rows where rank <= 10 union all select * from keyword_rows where rank <= 10)) group by 1",
}


@query("g10_by_method", sql("select query_id, m search_method, round(case when m = 'hybrid' then h.confidence else coalesce(c, 0.0) end, 6) confidence, case when m = 'hybrid' then a.total_results else coalesce(o.total_results, 0) end total_results from method join conf h using (query_id) join answered a using (query_id) left join one_side o using (query_id)", "answered", "conf", "v20", "k20", **_METHODS))
def g10_by_method(spark, d):
    n = F.col("query_id") % 4
    asked = questions(spark, d).withColumn("search_method", F.when(n == 0, "vector").when(n == 1, "keyword").when(n == 2, "hybrid"))
    rows = fusion.search_and_answer(index_of(spark, d), vector_table(spark, d), asked, corpus(spark, d))
    return rows.select("query_id", "search_method", "confidence", "total_results")


@query("g13_evaluation", sql("select coalesce(answer_confidence, 'all') answer_confidence, count(*) n, round(avg(confidence), 6) mean_confidence, round(avg(n_sources), 6) mean_sources from answered group by rollup (answer_confidence)", "answered"))
def g13(spark, d):
    return fusion.evaluation(g10(spark, d))


@query("g11_reuse", "with keyed as (select conv_id || '-' || turn query_id, md5(text || '|' || role) cache_key from conversations), stored as (select md5(text || '|' || role) cache_key, conv_id || '-' || turn answer, timestamp '2024-01-01 00:00:00' + to_seconds(cast(conv_id * 10 as bigint)) ts from conversations), young as (select cache_key, arg_max(answer, struct_pack(ts := ts, answer := answer)) stored_answer from stored where ts > timestamp '2024-01-01 01:00:00' - interval 3600 second group by 1) select query_id, stored_answer, stored_answer is not null from_cache from keyed left join young using (cache_key)")
def g11(spark, d):
    rows = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 10)
    ids = F.concat_ws("-", "conv_id", "turn")
    stored = rows.select(F.md5(F.concat_ws("|", "text", "role")).alias("cache_key"), ids.alias("answer"), at.alias("ts"))
    found = fusion.reuse(rows.select(ids.alias("query_id"), "text", "role"), stored, F.lit("2024-01-01 01:00:00").cast("timestamp"), 3600, ["text", "role"])
    return found.select("query_id", "stored_answer", "from_cache")


_REQUESTS = """requests as materialized (select event_id request_id, md5(concat_ws('_', event_type, 'q' || (user_id % 20), '10', '')) cache_key, ts from events),
 numbered as materialized (select *, row_number() over (partition by cache_key order by ts, request_id) n from requests),
 stores as (select cache_key, n, ts from numbered where n = 1 union all select x.cache_key, x.n, x.ts from (select s.cache_key, min(m.n) n from stores s join numbered m on m.cache_key = s.cache_key and m.n > s.n and m.ts >= s.ts + interval 43200 second group by s.cache_key) y join numbered x using (cache_key, n))"""


@query("g11_reuse_log", f"with recursive {_REQUESTS} select q.request_id, q.cache_key, s.n <> q.n from_cache, o.request_id stored_by from numbered q asof join (select distinct * from stores) s on q.cache_key = s.cache_key and q.n >= s.n join numbered o on o.cache_key = s.cache_key and o.n = s.n")
def g11_log(spark, d):
    log = search_log(spark, d)
    key = fusion.cache_key(F.col("query"), F.col("search_method"), F.lit(10))
    return fusion.reuse_log(log.select(F.col("id").alias("request_id"), key.alias("cache_key"), "ts"), 43_200).select("request_id", "cache_key", "from_cache", "stored_by")


@query("g11_answers", sql("select query_id || '-' || n request_id, n = 1 from_cache, md5(answer) answer_md5, confidence, n_sources from answered, (values (0), (1), (2)) t(n)", "answered"))
def g11_answers(spark, d):
    """Every question is asked three times, half an hour apart; an answer is good for 40 minutes."""
    asks = questions(spark, d).select("query", "qvec", F.col("query_id").alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_n"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("_q") * 60 + F.col("_n") * 1800)
    asks = asks.select(F.concat_ws("-", "_q", "_n").alias("request_id"), "query", "qvec", fusion.cache_key(F.concat_ws(":", "_q", "query"), F.lit("hybrid"), F.lit(10)).alias("cache_key"), at.alias("ts"))
    stored, vecs, docs = index_of(spark, d), vector_table(spark, d), corpus(spark, d)
    found = fusion.answer_requests(asks, 2400, lambda q: fusion.search_and_answer(stored, vecs, q, docs))
    return found.select("request_id", "from_cache", F.md5("answer").alias("answer_md5"), "confidence", "n_sources")


# --- enhancement, with the Latin lexicon

LEX = enhance.LATIN


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


_INTENT = "case " + " ".join(f"when {any_of('query', shown)} then {quoted(n)}" for n, shown, _, _ in LEX.intents) + " else 'general' end"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"


@query("h1_intent", sql(f"select query_id, {_INTENT} intent, len({_WORDS.format('query')}) n_words, round(case when length(query) > 0 then len({_WORDS.format('query')}) / length(query) else 0.0 end, 6) density from turns", "turns"))
def h1(spark, d):
    q = F.col("query")
    return turns(spark, d).select("query_id", enhance.intent(q, LEX).alias("intent"), F.size(enhance.tokens(q)).alias("n_words"), F.round(enhance.density(q), 6).alias("density"))


_PAIRS: dict[str, list[str]] = {}
for _head, _members in LEX.thesaurus.items():
    for _w in [_head, *_members]:
        _PAIRS.setdefault(_w, [m for m in _members if m != _w])
_MAP = "map {" + ", ".join(f"{quoted(w)}: [{', '.join(map(quoted, ms[:2]))}]" for w, ms in _PAIRS.items()) + "}"


@query("h3_h4_synonyms", sql(f"select query_id, md5(case when len(more) > 0 then query || ' ' || array_to_string(more, ' ') else query end) expanded_md5, len(more) n_added from (select *, flatten(list_transform({_WORDS.format('query')}, lambda w: coalesce({_MAP}[w], []))) more from turns)", "turns"))
def h4(spark, d):
    q = F.col("query")
    more = F.flatten(F.transform(enhance.tokens(q), lambda w: F.slice(enhance.synonyms(w, LEX), 1, 2)))
    return turns(spark, d).select("query_id", F.md5(enhance.expand(q, LEX)).alias("expanded_md5"), F.size(more).alias("n_added"))


_AREAS = "case " + " ".join(f"when {any_of('lower(text)', ms)} then case when {any_of('lower(query)', ms)} then query else query || {quoted(' ' + a)} end" for a, ms in LEX.contexts.items()) + " else query end"


@query("h5_context", f"select u.conv_id || '-' || u.turn query_id, md5({_AREAS.replace('query', 'u.text').replace('lower(text)', 'lower(a.text)')}) text_md5 from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user'")
def h5(spark, d):
    talk = table(spark, d, "conversations")
    answer = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    rows = talk.where("role = 'user'").join(answer, ["conv_id", "turn"])
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.md5(enhance.with_context(F.col("text"), F.col("context"), LEX)).alias("text_md5"))


_STRONG = "case i " + " ".join(f"when {quoted(n)} then case when {any_of('query', s)} then query else query || {quoted(' ' + s[0])} end" for n, _, s, _ in LEX.intents) + " else query end"


@query("h6_h9_intent", sql(f"select query_id, md5(e) enhanced_md5, array_to_string(list_sort(list_distinct(list_filter({_WORDS.format('e')}, lambda w: not list_contains({_WORDS.format('query')}, w)))), ',') added, round(case when len({_WORDS.format('query')}) = 0 then 0.0 else least((len({_WORDS.format('e')}) - len({_WORDS.format('query')})) / len({_WORDS.format('query')}), 1.0) end, 6) gain, case i " + " ".join(f"when {quoted(n)} then {quoted(' / '.join(LEX.templates.get(c, [])[:3]))}" for n, _, _, c in LEX.intents) + " else '' end alternatives from e", "turns", i=f"select *, {_INTENT} i from turns", e=f"select *, {_STRONG} e from i"))
def h6(spark, d):
    q = F.col("query")
    rows = turns(spark, d).withColumn("i", enhance.intent(q, LEX)).withColumn("e", enhance.with_intent(q, F.col("i"), LEX))
    added = F.array_join(F.array_sort(F.array_except(enhance.tokens(F.col("e")), enhance.tokens(q))), ",")
    return rows.select("query_id", F.md5("e").alias("enhanced_md5"), added.alias("added"), F.round(enhance.improvement(q, F.col("e")), 6).alias("gain"), F.array_join(enhance.alternatives(F.col("i"), LEX), " / ").alias("alternatives"))


def _standardised(x: str) -> str:
    """Whole words replaced; twice, as neighbours share the sign between them."""
    for plain, formal in LEX.vocabulary:
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_]){plain}([^\\p{{L}}\\p{{N}}_]|$)', '\\1{formal}\\2', 'g')"
    return x


def _enhanced(table: str) -> dict[str, str]:
    """Expressions of the steps from a table with query: s standardised, x expanded, e with the intent's word."""
    more = f"flatten(list_transform({_WORDS.format('s')}, lambda w: coalesce({_MAP}[w], [])))"
    return {
        "ei": f"select *, {_INTENT} i, {_standardised('query')} s from {table}",
        "ex": f"select * exclude (more), case when len(more) > 0 then s || ' ' || array_to_string(more, ' ') else s end x from (select *, {more} more from ei)",
        "ee": f"select *, {_STRONG.replace('query', 'x')} e from ex",
    }


@query("h2_h10_enhance", sql(f"select query_id, i detected_intent, md5(s) standardized_md5, md5(e) enhanced_md5, array_to_string(list_sort(list_distinct(list_filter({_WORDS.format('e')}, lambda w: not list_contains({_WORDS.format('query')}, w)))), ',') expanded_terms, round(case when len({_WORDS.format('query')}) = 0 then 0.0 else least((len({_WORDS.format('e')}) - len({_WORDS.format('query')})) / len({_WORDS.format('query')}), 1.0) end, 6) gain, case i " + " ".join(f"when {quoted(n)} then {quoted(' / '.join(LEX.templates.get(c, [])[:3]))}" for n, _, _, c in LEX.intents) + " else '' end alternatives from ee", "turns", **_enhanced("turns")))
def h10(spark, d):
    rows = enhance.enhance(turns(spark, d), LEX)
    return rows.select("query_id", "detected_intent", F.md5("standardized_query").alias("standardized_md5"), F.md5("enhanced_query").alias("enhanced_md5"), F.array_join("expanded_terms", ",").alias("expanded_terms"), F.round("confidence_improvement", 6).alias("gain"), F.array_join("suggested_alternatives", " / ").alias("alternatives"))


_KEPT = r"list_filter(string_split_regex(regexp_replace(content, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 and w not in (" + ", ".join(map(quoted, LEX.stopwords)) + "))"
_MEMBERS = sorted({m for ms in LEX.thesaurus.values() for m in ms})
_IN = lambda ws: ", ".join(map(quoted, ws))
_WEIGHT = f"case when word in ({_IN(LEX.high)}) then 3.0 when word in ({_IN(LEX.medium)}) then 2.0 when word in ({_IN(_MEMBERS)}) then 1.5 else 1.0 end"
KEYWORDS = {
    "kept": f"select document_id, {_KEPT} ws from corpus",
    "counted": "select document_id, any_value(len(ws)) total, word, count(*) n from (select document_id, ws, unnest(ws) word from kept) group by document_id, word having count(*) >= 2",
    "keyed": f"select * from (select document_id, word, n, round(cast(n as double) / total * {_WEIGHT}, 9) weight, row_number() over (partition by document_id order by round(cast(n as double) / total * {_WEIGHT}, 9) desc, word) rank from counted) where rank <= 30",
}


@query("h11_h12_keywords", sql("select document_id, word, n, round(weight, 6) weight, rank from keyed", "corpus", **KEYWORDS))
def h11(spark, d):
    return rounded(enhance.main_keywords(corpus(spark, d), LEX), "weight")


_CATEGORY = "case " + " ".join(f"when word in ({_IN([h, *ms])}) then {quoted(LEX.category_of[h])}" for h, ms in LEX.thesaurus.items() if h in LEX.category_of) + " end"


@query("h13_categories", sql(f"select document_id, word, {_CATEGORY} category from keyed", "corpus", **KEYWORDS))
def h13(spark, d):
    return enhance.main_keywords(corpus(spark, d), LEX).select("document_id", "word", enhance.category(F.col("word"), LEX).alias("category"))


_TQ = "(values " + ", ".join(f"({quoted(c)}, {quoted(q)})" for c, qs in LEX.templates.items() for q in qs) + ") t(category, question)"
_LW = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_SPEC = " union all ".join(f"select document_id, {quoted(q)} question, {quoted(c)} category, {quoted(k)} keyword, {s} confidence, len(regexp_extract_all(content, {quoted(p)})) frequency from corpus where len(regexp_extract_all(content, {quoted(p)})) > 0" for p, q, c, k, s in enhance.SPECIFIC_LATIN)


@query("h15_specific", sql(f"select * from ({_SPEC})", "corpus"))
def h15(spark, d):
    return enhance.specific_questions(corpus(spark, d), enhance.SPECIFIC_LATIN)


@query("h14_h16_recommended", sql(
    "select document_id, question, category, keyword, confidence, rank from (select *, row_number() over (partition by document_id order by confidence desc, question) rank from every) where rank <= 20",
    "corpus", **KEYWORDS,
    cats=f"select document_id, category, max(weight) weight, arg_max(word, struct_pack(weight := weight, word := word)) keyword from (select *, {_CATEGORY} category from keyed) where category is not null group by 1, 2",
    asked=f"select document_id, question, category, keyword, round(least(weight * 10, 1.0) * 0.7 + coalesce(cast(len(list_intersect({_LW.format('question')}, ws)) as double) / nullif(len(list_distinct(list_concat({_LW.format('question')}, ws))), 0), 0) * 0.3, 3) confidence from cats join {_TQ} using (category) join (select document_id, {_LW.format('content')} ws from corpus) using (document_id)",
    every=f"select document_id, question, category, keyword, confidence from asked union all select document_id, question, category, keyword, confidence from ({_SPEC})",
))
def h16(spark, d):
    return enhance.recommended(corpus(spark, d), LEX, enhance.SPECIFIC_LATIN)


def enhanced_questions(spark, d):
    return enhance.enhance(questions(spark, d), LEX).select("query_id", "query", "enhanced_query", "detected_intent", "qvec")


def answer_all(spark, d):
    chunks, vecs, docs = index_of(spark, d), vector_table(spark, d), corpus(spark, d)
    return lambda queries: written(fusion.search_and_answer(chunks, vecs, queries, docs), "answers")


_PASSES = _enhanced("questions") | {"weak": "select query_id from answered where confidence < 0.6 or n_sources < 2"} | search_again("select query_id, e query, qvec from ee where e <> query and query_id in (select query_id from weak)")


@query("h18_two_pass", sql(
    "select f.query_id, coalesce(s.confidence > f.confidence, false) enhanced, f.confidence first_confidence, s.confidence second_confidence, case when coalesce(s.confidence > f.confidence, false) then s.confidence else f.confidence end confidence, case when coalesce(s.confidence > f.confidence, false) then s.answer_confidence else f.answer_confidence end answer_confidence, case when coalesce(s.confidence > f.confidence, false) then s.n_sources else f.n_sources end n_sources from answered f left join answered2 s using (query_id)",
    "answered", **_PASSES,
))
def h18(spark, d):
    answer, asked = answer_all(spark, d), enhanced_questions(spark, d)
    return enhance.two_pass(answer(asked), answer, asked).select("query_id", "enhanced", "first_confidence", "second_confidence", "confidence", "answer_confidence", "n_sources")


@query("h19_compare", sql(
    "select query_id, round(s.confidence - f.confidence, 6) confidence_gain, s.n_sources - f.n_sources sources_gain, case when round(s.confidence - f.confidence, 6) > 0.05 then 'better' when round(s.confidence - f.confidence, 6) < -0.05 then 'worse' else 'same' end verdict from answered f join answered2 s using (query_id)",
    "answered", **_enhanced("questions"), **search_again("select query_id, e query, qvec from ee"),
))
def h19(spark, d):
    answer, asked = answer_all(spark, d), enhanced_questions(spark, d)
    return enhance.compare(answer(asked), answer(asked.withColumn("query", F.col("enhanced_query"))))


@query("h17_hints", sql(
    f"select query_id, case when n = 0 then 'use more specific keywords' when m < 0.5 then array_to_string(list_filter([case when i = 'general' then 'ask a more specific question' end, case when len({_WORDS.format('query')}) < 2 then 'add a related keyword' end, case when e <> query then 'try: ' || e end], lambda x: x is not null), ' / ') else '' end hints from (select ee.*, coalesce(n, 0) n, coalesce(m, 0.0) m from ee left join (select query_id, count(*) n, avg(hybrid_score) m from firsts group by 1) using (query_id))",
    "firsts", "questions", **_enhanced("questions"),
))
def h17(spark, d):
    asked = enhanced_questions(spark, d)
    found = fusion.unique_sources(results_of(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.avg("hybrid_score").alias("mean_score"))
    rows = asked.join(found, "query_id", "left").fillna({"n_sources": 0, "mean_score": 0.0})
    return enhance.better_questions(rows, LEX)
