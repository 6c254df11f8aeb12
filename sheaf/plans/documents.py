"""Queries over documents and pages: ingest bookkeeping, text, metadata and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import chunking, ingest, metadata, tables
from ..sources import extract
from ..sources.scratch import scratch_path
from ..sources.tables import corpus, elements, lines, search_log, table
from ..streaming import jobs
from .base import Query, quoted, sql, strip

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


# --- sources and bookkeeping


@query("a4_document_id", sql("select document_id, md5('data/' || file_name || '_' || file_name || '_.txt') file_id from corpus", "corpus"))
def a4(spark, d):
    return corpus(spark, d).select("document_id", ingest.document_id(F.concat(F.lit("data/"), "file_name"), F.col("file_name"), F.lit(".txt")).alias("file_id"))


@query("a3_file_columns", sql("select 'data/' || file_name path, file_name, '.txt' file_ext, md5('data/' || file_name || '_' || file_name || '_.txt') document_id, case when source_type = '' then '' end error_message from corpus", "corpus"))
def a3(spark, d):
    return ingest.guard(ingest.with_file_columns(corpus(spark, d).select(F.concat(F.lit("data/"), "file_name").alias("path"))), [".txt", ".html"])


@query("a5_remaining", sql("select document_id, file_name from corpus where document_id not in (select cast(doc_id as varchar) from labels)", "corpus"))
def a5(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return ingest.remaining(corpus(spark, d).select("document_id", "file_name"), done)


@query("a7_enrich", sql("select document_id, coalesce(case when quality = 1 then 'good' when quality = 0 then 'poor' end, agency) agency, source_type from corpus left join (select doc_id, min(quality) quality from labels group by all) on document_id = cast(doc_id as varchar)", "corpus"))
def a7(spark, d):
    meta = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("agency"))
    meta = meta.groupBy("document_id").agg(F.max("agency").alias("agency"))
    return ingest.enrich(corpus(spark, d).select("document_id", "agency", "source_type"), meta, ["agency"], "document_id")


@query("a8_upsert", sql("select c.document_id, case when l.doc_id is null then agency else 'label ' || quality end agency, case when l.doc_id is null then source_type else 'unknown' end source_type from corpus c left join (select doc_id, max(quality) quality from labels group by all) l on c.document_id = cast(l.doc_id as varchar)", "corpus"))
def a8(spark, d):
    new = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("label "), "quality").alias("agency"), F.lit(None).cast("string").alias("source_type"))
    return ingest.upsert(corpus(spark, d).select("document_id", "agency", "source_type"), new, order="agency", defaults={"source_type": "unknown"})


@query("a8_upsert_table", sql("select c.document_id, case when l.doc_id is null then agency else 'label ' || quality end agency, case when l.doc_id is null then source_type else 'unknown' end source_type from corpus c left join (select doc_id, max(quality) quality from labels group by all) l on c.document_id = cast(l.doc_id as varchar)", "corpus"))
def a8_table(spark, d):
    """The same by a stored table: the documents, then the labelled ones with their new values, then no rows."""
    path = scratch_path(spark, "documents")
    docs = corpus(spark, d).select("document_id", "agency", "source_type")
    new = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("label "), "quality").alias("agency"), F.lit("unknown").alias("source_type"))
    for rows in (docs, new.join(docs, "document_id", "left_semi"), new.limit(0)):
        tables.upsert(rows, path, "document_id", order="agency")
    return tables.rows(spark, path).drop("_bucket")


@query("a9_upsert_chunks", sql("select chunk_id, document_id, section_index, chunk_index, md5(content) content_md5, substr(content, 1, 200) content_preview, length(content) chunk_size from named", "named"))
def a9_table(spark, d):
    """The chunk table of an ingest in two batches, of which the second brings half of the first again."""
    path = scratch_path(spark, "chunks")
    docs, n = corpus(spark, d), F.col("document_id").cast("long") % 4
    for part in (docs.where(n < 2), docs.where(n > 0)):
        tables.upsert(ingest.chunk_rows(chunking.smart_chunks(part)), path, "chunk_id")
    return tables.rows(spark, path).withColumn("content_md5", F.md5("content")).drop("content", "_bucket")


@query("a9_chunk_rows", sql("select chunk_id, document_id, section_index, chunk_index, md5(content) content_md5, substr(content, 1, 200) content_preview, length(content) chunk_size from named", "named"))
def a9(spark, d):
    rows = ingest.chunk_rows(chunking.smart_chunks(corpus(spark, d)))
    return rows.withColumn("content_md5", F.md5("content")).drop("content")


OUTCOME = "select document_id, length(content) >= 100 success, count(i) total_chunks, case when length(content) < 100 then 'too short' end error_message from corpus, unnest(range(0, greatest(length(content), 1), 800)) u(i) group by document_id, content"


def outcomes(spark, d):
    n = F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / 800) + 1
    ok = F.length("content") >= 100
    return corpus(spark, d).select("document_id", ok.alias("success"), n.alias("total_chunks"), F.when(~ok, "too short").alias("error_message"))


@query("a12_summary", sql("select count(*) total_files, count(*) filter (success) processed, count(*) filter (not success) failed, sum(total_chunks) total_chunks, round(count(*) filter (success) * 100.0 / count(*), 6) success_pct, coalesce((select string_agg(e, '; ' order by e) from (select document_id || ': ' || error_message e from outcomes where not success order by document_id limit 5)), '') errors from outcomes", "corpus", outcomes=OUTCOME))
def a12(spark, d):
    return ingest.summary(outcomes(spark, d))


@query("a12_progress", sql("select agency run, source_type batch, count(*) filter (length(content) >= 100) ok, count(*) filter (length(content) < 100) failed from corpus group by all", "corpus").replace("with corpus", "with base as (select * from (values (1))), corpus"))
def a12_batches(spark, d):
    ok = F.length("content") >= 100
    return corpus(spark, d).groupBy(F.col("agency").alias("run"), F.col("source_type").alias("batch")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


@query("a12_running", sql("select run, batch, ok, failed, cast(sum(ok + failed) over w as bigint) done, round(sum(ok + failed) over w * 100.0 / sum(ok + failed) over (partition by run), 6) progress_pct, round(sum(ok) over w * 100.0 / sum(ok + failed) over w, 6) success_pct from b window w as (partition by run order by batch)", "corpus", b="select agency run, source_type batch, count(*) filter (length(content) >= 100) ok, count(*) filter (length(content) < 100) failed from corpus group by all"))
def a12_running(spark, d):
    from ..operators.analytics import running_progress

    return running_progress(a12_batches(spark, d))


EXT = "coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*(\\.[a-z]+)$', 1)), ''), 'none')"


def extension(url):
    found = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*(\.[a-z]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))


@query("a1_scan", f"select {EXT} folder, cast(sum(octet_length(encode(coalesce(html, ''))) + 1) as bigint) n_bytes, 0 as n_refused from pages group by 1")
def a1(spark, d):
    path = scratch_path(spark, "files")
    rows = table(spark, d, "pages").select(extension(F.col("url")).alias("folder"), F.coalesce("html", F.lit("")).alias("value"))
    rows.write.partitionBy("folder").text(path)
    found = ingest.scan_files(spark, path, [".txt"]).where("not startswith(file_name, '_')")
    folder = F.url_decode(F.regexp_extract("path", "folder=([^/]+)/", 1))
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("n_bytes"), F.count("error_message").cast("int").alias("n_refused"))


@query("a6_import", sql("select md5('data/files/' || file_name || '_' || file_name || '_.txt') document_id, file_name, case when labelled then 'known' else agency end agency, case when not labelled then source_type end business_type from (select *, document_id in (select cast(doc_id as varchar) from labels) labelled from corpus)", "corpus"))
def a6(spark, d):
    docs, path = corpus(spark, d), scratch_path(spark, "metadata")
    docs.select(F.col("file_name").alias("파일명"), F.col("agency").alias("발주기관"), F.col("source_type").alias("사업분야")).write.option("header", True).csv(path)
    name = F.concat(F.lit("data/files/"), "file_name")
    known = docs.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id")).distinct(), "document_id", "left_semi")
    known = known.select(ingest.document_id(name, F.col("file_name"), F.lit(".txt")).alias("document_id"), "file_name", F.lit("known").alias("agency"))
    return ingest.import_metadata(spark, path, known).select("document_id", "file_name", "agency", "business_type")


@query("a10_export", sql("select file_name, agency, source_type business_type, cast(len(string_split(content, chr(10))) as varchar) total_pages, cast(processed_date as varchar) processed_date from corpus", "corpus"))
def a10(spark, d):
    docs, path = corpus(spark, d).withColumns({"business_type": F.col("source_type"), "total_pages": F.size(F.split("content", "\n"))}), scratch_path(spark, "export")
    columns = ["file_name", "agency", "business_type", "total_pages", "processed_date"]
    ingest.export_documents(docs, path, columns)
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)


@query("a11_snapshot", sql("select agency, count(*) n, 1700000000 as snapshot_ts, sum(length(content)) n_chars from corpus group by 1", "corpus"))
def a11(spark, d):
    path = scratch_path(spark, "snapshot")
    ingest.snapshot({"documents": corpus(spark, d)}, path, 1_700_000_000)
    back = spark.read.parquet(f"{path}/documents")
    return back.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_ts").alias("snapshot_ts"), F.sum(F.length("content")).alias("n_chars"))


@query("a13_append_log", sql("select query, search_method, count(*) n, cast(sum(id % 7) as bigint) results_count, round(avg(confidence_score), 6) confidence_score, '2024-05-01 00:00:00' as last from log group by 1, 2", "log"))
def a13(spark, d):
    path = scratch_path(spark, "log")
    answered = search_log(spark, d).select("query", "search_method", (F.col("id") % 7).alias("total_results"), F.col("confidence_score").alias("confidence"))
    for method in ("search", "other"):  # two appends
        part = answered.where(F.col("search_method") == "search") if method == "search" else answered.where(F.col("search_method") != "search")
        ingest.append_log(part, path, F.lit("2024-05-01").cast("timestamp"))
    back = spark.read.parquet(path)
    return back.groupBy("query", "search_method").agg(F.count(F.lit(1)).alias("n"), F.sum("results_count").alias("results_count"), F.round(F.avg("confidence_score"), 6).alias("confidence_score"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("a14_formats", f"select {EXT} ext, count(*) n from pages group by 1")
def a14(spark, d):
    return table(spark, d, "pages").groupBy(extension(F.col("url")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("k1_resumable_ingest", sql("select document_id, count(*) n_chunks, md5(string_agg(md5(content), '' order by section_index, chunk_index)) content_md5 from named group by 1", "named"))
def k1(spark, d):
    source, target, state = f"{d}/documents*.parquet", scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")  # a pattern, as a source must not be one file
    docs = table(spark, d, "documents")
    select = lambda rows: rows.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    for _ in range(2):  # the second start finds nothing new
        jobs.ingest_stream(spark, source, docs.schema, target, state, select=select).awaitTermination()
    back = spark.read.parquet(target)
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_index", "chunk_index", F.md5("content").alias("m")))), lambda x: x["m"]), "")
    return back.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(digests).alias("content_md5"))


# --- text


@query("b1_pages", sql(f"select document_id, md5(string_agg(chr(10) || '--- page ' || (page_no + 1) || ' ---' || chr(10) || text, '' order by page_no)) content_md5 from p where {strip('text')} <> '' group by document_id", "lines", p="select document_id, cast(floor(pos / 5) as integer) page_no, string_agg(line, chr(10) order by pos) as text from lines group by 1, 2"))
def b1(spark, d):
    rows = lines(corpus(spark, d)).groupBy("document_id", F.floor(F.col("pos") / 5).cast("int").alias("page_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return ingest.merge_pages(rows).select("document_id", F.md5("content").alias("content_md5"))


HTML = "html"
for _tag in ("head", "script", "style", "nav"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"


def _decoded(x: str) -> str:
    for a, b in T.ENTITIES:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


TITLE = _decoded(strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
BODY = strip(f"regexp_replace({_decoded(HTML)}, '\\s+', ' ', 'g')")


@query("b2_html_text", f"select page_id, {TITLE} title, md5({BODY}) text_md5, length({BODY}) n_chars from pages")
def b2(spark, d):
    body = T.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), body.alias("t")).select("page_id", "title", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


#: The tokeniser knows all named entities; these two the pages have besides ENTITIES.
READ = strip(f"regexp_replace({_decoded(f'replace(replace({HTML}, {quoted(chr(38) + "copy;")}, {quoted(chr(169))}), {quoted(chr(38) + "middot;")}, {quoted(chr(183))})')}, '\\s+', ' ', 'g')")


@query("b2_html_tokens", f"select page_id, md5({READ}) text_md5, length({READ}) n_chars from pages")
def b2_tokens(spark, d):
    rows = table(spark, d, "pages").select("page_id", html.html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("a1_extracted", sql(f"select 'pages/' || page_id || '.html' path, '.html' file_ext, md5({READ}) text_md5, null error_message from pages union all select 'texts/' || file_name, case when source_type = 'de' then '.doc' else '.txt' end, case when source_type = 'de' then null else md5(content) end, case when source_type = 'de' then 'unsupported file type: .doc' end from (select *replace (case when source_type = 'de' then replace(file_name, '.txt', '.doc') else file_name end as file_name) from corpus)", "corpus"))
def a1_extracted(spark, d):
    """Pages and documents as files of three kinds, of which one has no extractor."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    name = F.when(F.col("source_type") == "de", F.replace("file_name", F.lit(".txt"), F.lit(".doc"))).otherwise(F.col("file_name"))
    texts = corpus(spark, d).select(F.concat(F.lit("texts/"), name).alias("path"), F.col("content").cast("binary").alias("content"))
    return extract.extracted(pages.unionByName(texts)).select("path", "file_ext", F.md5("text").alias("text_md5"), "error_message")


GATE = "(length(" + strip("{0}") + ") >= 100 and (length(regexp_replace({0}, '[^가-힣]', '', 'g')) > 20 or length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) > 50))"


@query("b3_fallback", sql(f"select document_id, md5(case when {GATE.format('c1')} then c1 when {GATE.format('c2')} then c2 else 'file: ' || file_name end) text_md5, case when {GATE.format('c1')} then 'first_line' when {GATE.format('c2')} then 'whole' else 'filename_only' end method from (select *, string_split(content, chr(10))[1] c1, content c2 from corpus)", "corpus"))
def b3(spark, d):
    rows = corpus(spark, d).withColumn("c1", F.split("content", "\n")[0])
    text, method = T.first_meaningful([("first_line", F.col("c1")), ("whole", F.col("content"))], F.concat(F.lit("file: "), "file_name"))
    return rows.select("document_id", F.md5(text).alias("text_md5"), method.alias("method"))


@query("b4_meaningful", sql(f"select document_id, {GATE.format('content')} meaningful from corpus", "corpus"))
def b4(spark, d):
    return corpus(spark, d).select("document_id", T.is_meaningful(F.col("content")).alias("meaningful"))


@query("b5_fragments", sql(f"select document_id, count(*) n_lines, count(*) filter (length({strip('line')}) >= 10 and regexp_matches(line, '\\p{{L}}')) n_kept from lines group by 1", "lines"))
def b5(spark, d):
    return lines(corpus(spark, d)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_meaningful_fragment(F.col("line"))).alias("n_kept"))


_CONTROL = r"regexp_replace(regexp_replace(regexp_replace(content, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query("b6_clean", sql(f"select document_id, md5({strip(_CONTROL)}) content_md5 from corpus", "corpus"))
def b6(spark, d):
    return corpus(spark, d).select("document_id", F.md5(T.clean(F.col("content"), squeeze_runs=False)).alias("content_md5"))


@query("b6_clean_runs", sql(
    f"select document_id, md5({strip('whole')}) content_md5 from (select document_id, string_agg(case when n > 10 and c <> chr(10) then c else repeat(c, n) end, '' order by run) whole from (select document_id, run, any_value(c) c, cast(count(*) as integer) n from (select *, sum(case when c = before then 0 else 1 end) over (partition by document_id order by p) run from (select *, lag(c) over (partition by document_id order by p) before from cs)) group by 1, 2) group by 1)",
    "corpus", cs=f"select document_id, unnest(string_split(t, '')) c, generate_subscripts(string_split(t, ''), 1) p from (select document_id, {_CONTROL} t from corpus)",
))
def b6_runs(spark, d):
    return corpus(spark, d).select("document_id", F.md5(T.clean(F.col("content"))).alias("content_md5"))


@query("b7_error_content", sql(f"select document_id, md5(case when {strip('c1')} = '' then '[no text could be extracted: ' || file_name || ']' else c1 end) text_md5, case when length(content) < 100 then 'too short' end processing_error from (select *, string_split(content, chr(10))[2] c2, coalesce(c2, '') c1 from corpus)", "corpus"))
def b7(spark, d):
    text, error = ingest.error_content(F.get(F.split("content", "\n"), F.lit(1)), F.col("file_name"), F.when(F.length("content") < 100, "too short"))
    return corpus(spark, d).select("document_id", F.md5(text).alias("text_md5"), error.alias("processing_error"))


@query("b9_replies", "select conv_id, turn, md5(text) extracted_md5, case when turn % 3 = 2 then md5(text) else md5(case when turn % 3 = 0 then role else '' end) end description_md5, case turn % 3 when 0 then 'chart' when 1 then 'other' else 'unknown' end content_type from conversations where text is not null")
def b9(spark, d):
    turn = F.col("turn") % 3
    whole, part = F.to_json(F.struct(F.col("text").alias("extracted_text"), F.col("role").alias("description"), F.lit("chart").alias("content_type"))), F.to_json(F.struct(F.col("text").alias("extracted_text")))
    reply = F.when(turn == 0, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\n"))).when(turn == 1, part).otherwise(F.col("text"))
    read = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", ingest.parse_reply(reply).alias("r"))
    return read.select("conv_id", "turn", F.md5("r.extracted_text").alias("extracted_md5"), F.md5("r.description").alias("description_md5"), "r.content_type")


@query("b10_images", "select document_id, page, idx, kind from (select *, row_number() over (partition by document_id order by page, idx) n from (select regexp_extract(url, '://([^/?#]*)', 1) document_id, page_id % 12 page, page_id idx, case page_id % 5 when 0 then 'png' when 1 then 'jpeg' when 2 then 'gif' when 3 then 'bmp' end kind from pages) where page < 10) where n <= 5")
def b10(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A", "FFD8FFE000104A46", "474946383961", "424D3600", "25504446")]), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("document_id"), (F.col("page_id") % 12).alias("page"), F.col("page_id").alias("idx"), F.unhex(F.concat(head, F.hex(F.coalesce("html", F.lit(""))))).alias("content"))
    return ingest.first_images(rows).select("document_id", "page", "idx", ingest.image_kind(F.col("content")).alias("kind"))


@query("b8_analyses", sql("select document_id, md5(content || coalesce(blocks, '')) content_md5, coalesce(n, 0) n_analyses from corpus left join (select cast(doc_id as varchar) document_id, string_agg(chr(10) || '[image 1]' || chr(10) || 'quality ' || quality || case when toxic <> quality then chr(10) || 'toxic ' || toxic else '' end, '') blocks, count(*) n from labels group by 1) using (document_id)", "corpus"))
def b8(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("image_index"), F.concat(F.lit("quality "), "quality").alias("extracted_text"), F.when(F.col("toxic") != F.col("quality"), F.concat(F.lit("toxic "), "toxic")).alias("description"))
    return ingest.merge_analyses(corpus(spark, d), rows).select("document_id", F.md5("content").alias("content_md5"), "n_analyses")


@query("b11_images", "select regexp_extract(url, '://([^/?#]*)', 1) document_id, count(*) total_images, string_agg(cast(page_id as varchar) || ':' || length(html), ',' order by cast(page_id as varchar) || ':' || length(html)) images from pages group by 1")
def b11(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("document_id"), F.col("page_id").alias("page"), F.length("html").alias("idx"))
    return ingest.image_inventory(rows)


@query("b12_tags", sql("select document_id, source_type, 'text' extraction_method, length(content) content_length from corpus", "corpus"))
def b12(spark, d):
    return corpus(spark, d).select("document_id", "source_type", F.lit("text").alias("extraction_method"), F.length("content").alias("content_length"))


# --- metadata


@query("c1_agency_name", sql("select document_id, case when length(split_part(file_name, '_', 1)) > 1 and not regexp_matches(split_part(file_name, '_', 1), '^\\d+$') then split_part(file_name, '_', 1) end agency from corpus", "corpus"))
def c1(spark, d):
    return corpus(spark, d).select("document_id", metadata.agency_of_name(F.col("file_name")).alias("agency"))


def _first(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {quoted(pattern)}, {group}), '')"


_AGENCY = "coalesce(" + ", ".join(f"case when length({strip(_first('content', '(?i)' + p))}) > 1 and not regexp_matches({strip(_first('content', '(?i)' + p))}, '^[0-9]+$') then {strip(_first('content', '(?i)' + p))} end" for p in L.AGENCY_LATIN) + ")"
_WORD_SIGNS = "nullif(" + strip("regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\s()（）]', '', 'g')") + ", '')"


@query("c2_agency", sql(f"select document_id, {_WORD_SIGNS.format('found')} agency from (select document_id, {_AGENCY} found from corpus)", "corpus"))
def c2(spark, d):
    return corpus(spark, d).select("document_id", metadata.agency(F.col("content"), L.AGENCY_LATIN, None).alias("agency"))


_VOTES = {n: " + ".join(f"len(regexp_extract_all(lower(content || ' ' || file_name), {quoted('(?i)' + p)}))" for p in ps) for n, ps in L.BUSINESS_LATIN.items()}
_BEST = "greatest(" + ", ".join(_VOTES) + ")"


@query("c3_business_type", sql(f"select document_id, case when {_BEST} = 0 then {quoted(L.BUSINESS_DEFAULT)} " + " ".join(f"when {n} = {_BEST} then {quoted(n)}" for n in _VOTES) + " end business_type from v", "corpus", v="select document_id, " + ", ".join(f"{x} {n}" for n, x in _VOTES.items()) + " from corpus"))
def c3(spark, d):
    return corpus(spark, d).select("document_id", metadata.business_type(F.col("content"), F.col("file_name"), L.BUSINESS_LATIN, None).alias("business_type"))


def _number(p: str) -> str:
    return f"try_cast(replace({_first('content', p)}, ',', '') as bigint)"


_BUDGET = "coalesce(" + ", ".join(f"case when {_number(p)} > 2 then {_number(p)} end" for p in L.BUDGET_LATIN) + ")"


@query("c4_budget", sql(f"select document_id, {_BUDGET} || '원' budget, {_BUDGET} amount from corpus", "corpus"))
def c4(spark, d):
    text, amount = metadata.budget(F.col("content"), L.BUDGET_LATIN, None, 2)
    return corpus(spark, d).select("document_id", text.alias("budget"), amount.alias("amount"))


_DATED = "select document_id, agency, source_type, content, content || case cast(document_id as bigint) % 4 when 0 then ' Dated: 2024.' || (cast(document_id as bigint) % 12 + 1) || '.' || (cast(document_id as bigint) % 28 + 1) when 1 then ' by 2023-' || (cast(document_id as bigint) % 12 + 1) || '-09' when 2 then ' until 24/3/' || (cast(document_id as bigint) % 28 + 1) else '' end t from corpus"


def dated(spark, d):
    """Texts with a date behind them, in one form or another."""
    n = F.col("document_id").cast("long")
    month, day = (n % 12 + 1).cast("string"), (n % 28 + 1).cast("string")
    date = F.when(n % 4 == 0, F.concat(F.lit(" Dated: 2024."), month, F.lit("."), day)).when(n % 4 == 1, F.concat(F.lit(" by 2023-"), month, F.lit("-09"))).when(n % 4 == 2, F.concat(F.lit(" until 24/3/"), day)).otherwise(F.lit(""))
    return corpus(spark, d).withColumn("t", F.concat("content", date))


_ONE = "coalesce(" + ", ".join(_first("t", "(?i)" + p) for p in L.DEADLINE_LATIN) + ")"
_Y, _M, _D = (_first("t", L.UNTIL_LATIN, g) for g in (1, 2, 3))


@query("c5_deadline", sql(f"select document_id, coalesce(one, case when y is not null then case when length(y) = 2 then '20' || y else y end || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') end) deadline from (select document_id, {_ONE} one, {_Y} y, {_M} m, {_D} dd from dated)", "corpus", dated=_DATED))
def c5(spark, d):
    text, _ = metadata.deadline(F.col("t"), [f"(?iU){p}" for p in L.DEADLINE_LATIN], L.UNTIL_LATIN, None)
    return dated(spark, d).select("document_id", text.alias("deadline"))


_NOTICE = {name: "coalesce(" + ", ".join(_first("t", p.replace("(?iu)", "(?i)"), group) for p in patterns) + ")" for name, group, patterns in L.NOTICE_LATIN}


@query("c6_notice_fields", sql("select document_id, " + ", ".join(f"{strip(x) if n != 'budget' else x} {n}" for n, x in _NOTICE.items()) + " from dated", "corpus", dated=_DATED))
def c6(spark, d):
    return metadata.notice_fields(dated(spark, d).drop("agency"), "t", L.NOTICE_LATIN).select("document_id", *_NOTICE)


@query("c7_merge", sql("select document_id, 'agency=' || coalesce(case when q = 1 then 'good' end, agency) || ';type=' || case when length(content) > 500 then 'long' else source_type end || ';zone=' || case when q is null then 'none' else 'q' || q end merged from corpus left join (select cast(doc_id as varchar) document_id, max(quality) q from labels group by 1) using (document_id)", "corpus"))
def c7(spark, d):
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("document_id")).agg(F.max("quality").alias("q"))
    rows = corpus(spark, d).join(labels, "document_id", "left")
    one = lambda k, v: F.create_map(F.lit(k), v)
    base = F.create_map(F.lit("agency"), F.col("agency"), F.lit("type"), F.col("source_type"), F.lit("zone"), F.lit("none"))
    merged = metadata.merge(base, F.when(F.length("content") > 500, one("type", F.lit("long"))), F.when(F.col("q") == 1, one("agency", F.lit("good"))), F.when(F.col("q").isNotNull(), one("zone", F.concat(F.lit("q"), F.col("q").cast("string")))))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("document_id", text.alias("merged"))


# --- chunks


@query("d1_sections", sql("select document_id, section_index, md5(section) section_md5 from sections", "sections"))
def d1(spark, d):
    return chunking.sections(corpus(spark, d)).select("document_id", "section_index", F.md5("section").alias("section_md5"))


@query("d2_windows", sql(f"select document_id, row_number() over (partition by document_id order by i) - 1 chunk_index, md5(w) content_md5 from (select document_id, i, {strip('substr(content, i + 1, 1000)')} w from corpus, unnest(range(0, greatest(length(content), 1), 800)) u(i)) where w <> ''", "corpus"))
def d2(spark, d):
    return chunking.windows(corpus(spark, d)).select("document_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("d3_smart_chunks", sql("select document_id, section_index, chunk_index, chunk_id, md5(content) content_md5 from named", "named"))
def d3(spark, d):
    return chunking.smart_chunks(corpus(spark, d)).select("document_id", "section_index", "chunk_index", "chunk_id", F.md5("content").alias("content_md5"))


@query("d4_short_or_smart", sql(f"select n.document_id, section_index, chunk_index, md5(n.content) content_md5 from named n join corpus c using (document_id) where length(c.content) > 500 union all select document_id, 0, 0, md5({strip('content')}) from corpus where length(content) <= 500 and {strip('content')} <> ''", "named"))
def d4(spark, d):
    return chunking.short_or_smart(corpus(spark, d)).select("document_id", "section_index", "chunk_index", F.md5("content").alias("content_md5"))


@query("d5_groups", sql("select document_id, elem_idx, cast(group_id as bigint) group_id from grouped", "grouped"))
def d5(spark, d):
    return chunking.element_groups(elements(corpus(spark, d))).select("document_id", "elem_idx", "group_id")


DOMAIN_WORDS = ["the", "und", "les", "que"]
_LEVEL = "case when regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1) <> '' then len(string_split(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1), '.')) when regexp_matches(title, '^[가-힣]\\. ') then 2 else 1 end"
_HITS = " + ".join(f"case when contains(content, {quoted(w)}) then 0.05 else 0 end" for w in DOMAIN_WORDS)


@query("d6_d16_group_summary", sql(
    f"select document_id, cast(group_id as bigint) group_id, n_elements, chunk_type, title, md5(content) content_md5, round(mean_font, 6) mean_font, has_bold, pages, level, round(importance, 6) importance, coalesce(lag(title) over w, '') parent_section, coalesce(lag(level) over w, 1) parent_level from (select *, case when title <> '' then {_LEVEL} else 1 end level, least(0.5 + weight + case when length(content) > 500 then 0.1 else 0 end + {_HITS}, 1.0) importance from g) window w as (partition by document_id order by group_id)",
    "grouped",
    g="select document_id, group_id, count(*) n_elements, case when count(*) filter (element_type = 'title') > 0 and count(*) = 1 then 'title' when count(*) filter (element_type = 'table') > 0 then 'table' when count(*) filter (element_type = 'list') = count(*) then 'list' when count(distinct element_type) > 2 then 'mixed' else 'content' end chunk_type, coalesce(min(text_content) filter (element_type = 'title'), '') title, string_agg(text_content, chr(10) order by elem_idx) content, avg(font_size) mean_font, bool_or(font_weight = 'bold') has_bold, array_to_string(list_sort(list_distinct(list(page_number))), ',') pages, cast(sum(case when element_type = 'title' then 0.3 when font_weight = 'bold' then 0.1 else 0 end) as double) weight from grouped group by 1, 2",
))
def d6(spark, d):
    rows = chunking.group_summary(elements(corpus(spark, d)), DOMAIN_WORDS)
    return rows.withColumns({"content_md5": F.md5("content"), "mean_font": F.round("mean_font", 6), "importance": F.round("importance", 6)}).drop("content")


@query("d12_keywords", sql("select document_id, string_agg(word, ',' order by rank) keywords from (select *, row_number() over (partition by document_id order by n desc, f) rank from (select document_id, word, count(*) n, min(pos) f from (select document_id, unnest(ws) word, generate_subscripts(ws, 1) pos from (select document_id, list_concat(regexp_extract_all(content, '[가-힣]{2,}'), regexp_extract_all(content, '[A-Za-z]{3,}')) ws from corpus)) group by 1, 2)) where rank <= 10 group by 1", "corpus"))
def d12(spark, d):
    return chunking.keywords(corpus(spark, d))


@query("d14_merge_short", sql("select document_id, cast(merged_id as bigint) merged_id, md5(string_agg(line, chr(10) order by pos)) content_md5, count(*) n_merged from (select *, sum(case when length(" + strip('line') + ") >= 50 or pos = 0 then 1 else 0 end) over (partition by document_id order by pos) merged_id from lines) group by 1, 2", "lines"))
def d14(spark, d):
    rows = chunking.merge_short(lines(corpus(spark, d)).select("document_id", F.col("pos").alias("seq"), F.col("line").alias("content")))
    return rows.select("document_id", "merged_id", F.md5("content").alias("content_md5"), "n_merged")


# the split points, the pieces and the packing are folds: an accumulator goes through a list of structs of its own kind
_LINES = "list_concat([{'n': 0, 'good': false, 'pos': 0, 'now': 0, 'cuts': cast([] as integer[])}], list_transform(string_split(content, chr(10)), lambda l: {'n': cast(length(l) + 1 as integer), 'good': regexp_matches(" + strip("l") + ", '^\\d+\\.\\s+[가-힣A-Za-z]+|^제\\s*\\d+\\s*장|^[가-힣]+\\s*사업\\s*개요|^[가-힣]+\\s*기술\\s*요구사항|^\\s*\\([가-힣]\\)|^\\s*[가-힣]\\.|^\\s*\\d+\\)'), 'pos': 0, 'now': 0, 'cuts': cast([] as integer[])}))"
_SENTENCES = "list_concat([{'n': 0, 'good': true, 'pos': 0, 'now': 0, 'cuts': cast([] as integer[])}], list_transform(string_split_regex(content, '[.!?]\\s+'), lambda l: {'n': cast(length(l) as integer), 'good': true, 'pos': 0, 'now': 0, 'cuts': cast([] as integer[])}))"
_FOLD = "list_reduce({0}, lambda a, x: {{'n': 0, 'good': false, 'pos': a.pos + x.n, 'now': case when a.now + x.n > 1000 and x.good then x.n else a.now + x.n end, 'cuts': case when a.now + x.n > 1000 and x.good then list_append(a.cuts, a.pos) else a.cuts end}}).cuts"
_PIECE = strip("substr(content, a.p + 1, x.p - a.p)")
_PIECES = f"list_reduce(list_concat([{{'p': 0, 'o': cast([] as varchar[])}}], list_transform(list_append(cuts, cast(length(content) as integer)), lambda c: {{'p': c, 'o': cast([] as varchar[])}})), lambda a, x: case when length({_PIECE}) < 50 then {{'p': a.p, 'o': case when len(a.o) > 0 then list_append(a.o[1:len(a.o) - 1], a.o[len(a.o)] || chr(10) || {_PIECE}) else a.o end}} else {{'p': x.p, 'o': list_append(a.o, case when len(a.o) > 0 then substr(content, greatest(a.p - 200, 0) + 1, a.p - greatest(a.p - 200, 0)) else '' end || {_PIECE})}} end).o"


_VITAL = ("the", "and", "system", "der", "que", "est")


@query("d13_text_importance", sql("select chunk_id, round(least(1.0, 0.5 + case when length(content) > 500 then 0.1 else 0.0 end + 0.05 * (" + " + ".join(f"cast(contains(content, '{w}') as int)" for w in _VITAL) + ")), 6) importance from named", "named"))
def d13_text(spark, d):
    return chunking.smart_chunks(corpus(spark, d)).select("chunk_id", F.round(chunking.text_importance(F.col("content"), list(_VITAL)), 6).alias("importance"))


@query("d9_d11_enhanced_chunks", sql(
    f"select document_id, cast(group_id as bigint) group_id, part - 1 part, md5(piece) content_md5, length(piece) chunk_size from (select document_id, group_id, unnest(pieces) piece, generate_subscripts(pieces, 1) part from (select document_id, group_id, case when length(content) <= 1000 then [content] else {_PIECES} end pieces from (select *, case when length(content) <= 1000 then [] when len(by_line) > 0 then by_line else {_FOLD.format(_SENTENCES)} end cuts from (select *, case when length(content) > 1000 then {_FOLD.format(_LINES)} end by_line from gc))))",
    "grouped", gc="select document_id, group_id, string_agg(text_content, chr(10) order by elem_idx) content from grouped group by 1, 2",
))
def d9(spark, d):
    return chunking.enhanced_chunks(elements(corpus(spark, d))).select("document_id", "group_id", "part", F.md5("content").alias("content_md5"), F.length("content").alias("chunk_size"))


# a sign that no text holds marks the sentences' ends, as the dialect knows no look-behind
_PACKED = "list_reduce(list_concat([{'s': '', 'o': cast([] as varchar[])}], list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {'s': s, 'o': cast([] as varchar[])})), lambda a, x: case when length(a.s) + length(x.s) > 1500 and a.s <> '' then {'s': x.s, 'o': list_append(a.o, " + strip("a.s") + ")} else {'s': a.s || ' ' || x.s, 'o': a.o} end)"


@query("d15_emergency_split", sql(
    f"select document_id, part - 1 part, md5(piece) content_md5, length(piece) chunk_size from (select document_id, unnest(pieces) piece, generate_subscripts(pieces, 1) part from (select document_id, case when {strip('f.s')} <> '' then list_append(f.o, {strip('f.s')}) else f.o end pieces from (select document_id, {_PACKED} f from corpus)))", "corpus",
))
def d15(spark, d):
    return corpus(spark, d).select("document_id", F.posexplode(chunking.emergency_split(F.col("content"), 1500)).alias("part", "content")).select("document_id", "part", F.md5("content").alias("content_md5"), F.length("content").alias("chunk_size"))
