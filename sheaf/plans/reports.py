"""Queries over documents, the search log and page regions: statistics and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, chunking, layout
from ..sources.tables import PAGE_SIZE, corpus, regions, search_log
from .base import Query, sql

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


@query("i1_filter", sql("select document_id, agency, cast(processed_date as varchar) processed_date from corpus where agency ilike '%src1%' and processed_date >= date '2024-01-10' and processed_date <= date '2024-02-10'", "corpus"))
def i1(spark, d):
    return analytics.filter_documents(corpus(spark, d), agency="src1", date_from="2024-01-10", date_to="2024-02-10").select("document_id", "agency", F.col("processed_date").cast("string").alias("processed_date"))


@query("i2_paths", sql("select document_id, file_name from corpus where agency ilike '%src7%'", "corpus"))
def i2(spark, d):
    return analytics.paths_by_agency(corpus(spark, d), "src7")


@query("i3_document_chunks", sql("select section_index, chunk_index, chunk_id from named where document_id = '12'", "named"))
def i3(spark, d):
    docs = corpus(spark, d).where("document_id = '12'")
    return analytics.document_chunks(chunking.smart_chunks(docs), "12").select("section_index", "chunk_index", "chunk_id")


@query("i4_totals", sql("select (select count(*) from corpus) n_documents, (select count(*) from named) n_chunks", "corpus", "named"))
def i4(spark, d):
    return analytics.totals(corpus(spark, d), chunking.smart_chunks(corpus(spark, d)))


@query("i5_source_types", sql("select source_type, count(*) n from corpus group by 1", "corpus"))
def i5(spark, d):
    return analytics.count_by(corpus(spark, d), "source_type")


@query("i6_top_agencies", sql("select agency, count(*) n from corpus where agency <> '' group by 1 order by n desc, agency limit 20", "corpus"))
def i6(spark, d):
    return analytics.top_agencies(corpus(spark, d))


@query("i7_per_day", sql("select cast(processed_date as varchar) as day, count(*) n from corpus where processed_date between date '2024-02-28' - 30 and date '2024-02-28' group by 1", "corpus"))
def i7(spark, d):
    return analytics.documents_per_day(corpus(spark, d), "2024-02-28").withColumn("day", F.col("day").cast("string"))


@query("i8_sample", sql("select chunk_id, document_id from named order by md5('7:' || chunk_id), chunk_id limit 100", "named"))
def i8(spark, d):
    return analytics.sample_chunks(chunking.smart_chunks(corpus(spark, d))).select("chunk_id", "document_id")


@query("i9_history", sql("select id, query, search_method, coalesce(confidence_score, 0.0) confidence_score, response_time, ts from log order by ts desc, id desc limit 100", "log"))
def i9(spark, d):
    return analytics.history(search_log(spark, d))


CATEGORIES = {"ones": ["q1"], "twos": ["q2"], "threes": ["q3", "q4"]}


@query("i10_patterns", sql(
    "select 'word' metric, * from (select query as name, cast(count(*) as double) as value from h group by 1 order by 2 desc, 1 limit 10) union all select 'category', case when contains(lower(query), 'q1') then 'ones' when contains(lower(query), 'q2') then 'twos' when contains(query, 'q3') or contains(query, 'q4') then 'threes' end kind, count(*) from h where kind is not null group by 2 union all select 'total', '', count(*) from h union all select 'mean_confidence', '', round(avg(confidence_score), 6) from h",
    "log", h="select * from log order by ts desc, id desc limit 100",
))
def i10(spark, d):
    return analytics.patterns(search_log(spark, d), CATEGORIES)


@query("i11_system", sql("select 'documents' metric, '' as name, cast(count(*) as double) as value from corpus union all select 'chunks', '', count(*) from named union all select 'source_type', source_type, count(*) from corpus group by 2 union all select 'searches', search_method, count(*) from log group by 2", "corpus", "named", "log"))
def i11(spark, d):
    docs, log = corpus(spark, d), search_log(spark, d)
    one = lambda df, metric, name: df.select(F.lit(metric).alias("metric"), name.alias("name"), F.col("n").cast("double").alias("value"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    parts = [one(count(docs), "documents", F.lit("")), one(count(chunking.smart_chunks(docs)), "chunks", F.lit("")), one(analytics.count_by(docs, "source_type"), "source_type", F.col("source_type")), one(analytics.count_by(log, "search_method"), "searches", F.col("search_method"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("i12_budgets", sql("select count(*) filter (regexp_extract(content, '[0-9]+') <> '') n_budgets from corpus", "corpus"))
def i12(spark, d):
    return corpus(spark, d).agg(F.count_if(F.regexp_extract("content", "[0-9]+", 0) != "").alias("n_budgets"))


@query("i13_groups", sql("select agency, source_type business_type, count(*) n from corpus group by 1, 2", "corpus"))
def i13(spark, d):
    return analytics.count_by(corpus(spark, d).withColumnRenamed("source_type", "business_type"), "agency", "business_type")


@query("i14_lookups", sql("select 'point' lookup, document_id, file_name from corpus where document_id = '17' union all select 'like', document_id, file_name from corpus where contains(file_name, 'src3_') union all select * from (select 'first', document_id, file_name from corpus order by cast(document_id as bigint) limit 10)", "corpus"))
def i14(spark, d):
    return analytics.lookups(corpus(spark, d), "17", "src3_", 10)


@query("i15_baseline", sql("select search_method, n, round(conf / bc * 100, 6) confidence_pct, round(bt / time * 100, 6) speed_pct from m, (select conf bc, time bt from m where search_method = (select min(search_method) from m))", "log", m="select search_method, count(*) n, avg(confidence_score) conf, avg(response_time) as time from log group by 1"))
def i15(spark, d):
    log = search_log(spark, d)
    return analytics.against_baseline(log, log.agg(F.min("search_method")).first()[0])


@query("g12_hit_rate", sql("select coalesce(search_method, 'all') as level, count(*) filter (hit) hits, count(*) filter (not hit) misses, round(count(*) filter (hit) / count(*), 6) hit_rate from (select search_method, confidence_score > 0.5 hit from log) group by rollup (search_method)", "log"))
def g12(spark, d):
    return analytics.hit_statistics(search_log(spark, d).select(F.col("search_method").alias("level"), (F.col("confidence_score") > 0.5).alias("from_cache")))


@query("k2_log_windows", sql("select date_trunc('hour', ts) window_start, search_method, count(*) n, round(avg(confidence_score), 6) mean_confidence, round(avg(response_time), 6) mean_time from log group by 1, 2", "log"))
def k2(spark, d):
    return analytics.log_windows(search_log(spark, d))


# --- layout

# pages are 600 wide and 500 high: an area over the larger of 500 and 300, and under 240,000
_KEEP = "area > 500 and area < 240000 and (x2 - x1) / (y2 - y1) > 0.1 and (x2 - x1) / (y2 - y1) < 100 and x2 - x1 > 20 and y2 - y1 > 10 and density > 0.01 and density < 0.95"


@query("j1_text_regions", sql(f"select * from (select document_id, page_number, elem_idx, area, row_number() over (partition by document_id, page_number order by area desc, elem_idx) area_rank from (select *, (x2 - x1) * (y2 - y1) area from regions) where {_KEEP}) where area_rank <= 15", "regions"))
def j1(spark, d):
    return layout.text_regions(regions(corpus(spark, d)), PAGE_SIZE[0] * PAGE_SIZE[1]).select("document_id", "page_number", "elem_idx", "area", "area_rank")


@query("j2_merge_tokens", sql(
    "select document_id, page_number, elem_idx, md5(case when n > 0 then a else b end) text_md5, round(coalesce(case when n > 0 then ca else cb end, 0.0), 6) ocr_confidence from (select document_id, page_number, elem_idx, count(*) filter (high) n, coalesce(string_agg(token, ' ' order by pos) filter (high), '') a, coalesce(string_agg(token, ' ' order by pos) filter (low), '') b, avg(conf) filter (high) ca, avg(conf) filter (low) cb from (select *, conf > greatest(0.3, least(0.7, 0.7 * m)) high, conf > greatest(0.2, 0.5 * m) low from (select *, avg(conf) over (partition by document_id, page_number, elem_idx) m from tk)) group by 1, 2, 3)",
    "regions", tk="select document_id, page_number, elem_idx, pos - 1 pos, token, length(token) % 10 / 10.0 conf from (select document_id, page_number, elem_idx, unnest(string_split(text_content, ' ')) token, generate_subscripts(string_split(text_content, ' '), 1) pos from regions)",
))
def j2(spark, d):
    rows = regions(corpus(spark, d)).select("document_id", "page_number", "elem_idx", F.posexplode(F.split("text_content", " ")).alias("pos", "token")).withColumn("conf", F.length("token") % 10 / 10.0)
    merged = layout.merge_tokens(rows, ["document_id", "page_number", "elem_idx"])
    return merged.select("document_id", "page_number", "elem_idx", F.md5("text").alias("text_md5"), F.round("ocr_confidence", 6).alias("ocr_confidence"))


@query("j2_padded_tokens", sql(
    "select document_id, page_number, md5(string_agg(case when n > 0 then a else b end, '|' order by elem_idx)) text_md5 from (select document_id, page_number, elem_idx, count(*) filter (high) n, coalesce(string_agg(regexp_replace(token, '^\\s+|\\s+$', '', 'g'), ' ' order by pos) filter (high), '') a, coalesce(string_agg(regexp_replace(token, '^\\s+|\\s+$', '', 'g'), ' ' order by pos) filter (low), '') b from (select *, conf > greatest(0.3, least(0.7, 0.7 * m)) high, conf > greatest(0.2, 0.5 * m) low from (select *, avg(conf) over (partition by document_id, page_number, elem_idx) m from tk)) group by 1, 2, 3) group by 1, 2",
    "regions", tk="select document_id, page_number, elem_idx, pos - 1 pos, case when pos % 2 = 0 then '  ' || token || chr(9) else token || ' ' end token, length(token) % 10 / 10.0 conf from (select document_id, page_number, elem_idx, unnest(string_split(text_content, ' ')) token, generate_subscripts(string_split(text_content, ' '), 1) pos from regions)",
))
def j2_padded(spark, d):
    rows = regions(corpus(spark, d)).select("document_id", "page_number", "elem_idx", F.posexplode(F.split("text_content", " ")).alias("pos", "token")).withColumn("conf", F.length("token") % 10 / 10.0)
    rows = rows.withColumn("token", F.when(F.col("pos") % 2 == 1, F.concat(F.lit("  "), "token", F.lit("\t"))).otherwise(F.concat("token", F.lit(" "))))
    merged = layout.merge_tokens(rows, ["document_id", "page_number", "elem_idx"])
    pages = merged.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("elem_idx", "text"))).alias("t"))
    return pages.select("document_id", "page_number", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "|")).alias("text_md5"))


def labelled(spark, d):
    label, conf = layout.rule_label(*[F.col(c) for c in ("text_content", "density", "n_lines", "h_lines", "v_lines")])
    return regions(corpus(spark, d)).withColumns({"label": label, "label_conf": conf})


_SURE = "case rule when 'table' then 0.9 when 'title' then 0.85 when 'subtitle' then 0.75 when 'list' then 0.8 when 'paragraph' then 0.7 else case when density > 0.3 then 0.6 else 0.5 end end"


@query("j3_rule_labels", sql(f"select document_id, page_number, elem_idx, rule label, cast({_SURE} as double) label_conf from labelled", "labelled"))
def j3(spark, d):
    return labelled(spark, d).select("document_id", "page_number", "elem_idx", "label", "label_conf")


@query("j3_j4_labels", sql(f"select document_id, page_number, elem_idx, case when rc > 0.8 then rule when ocr_confidence > 0.7 then 'model' else rule end label, case when rc > 0.8 then rc when ocr_confidence > 0.7 then round(ocr_confidence, 6) else greatest(rc, 0.5) end conf from (select *, {_SURE} rc from labelled)", "labelled"))
def j4(spark, d):
    label, conf = layout.combined_label(F.col("label"), F.col("label_conf"), F.lit("model"), F.col("ocr_confidence"))
    return labelled(spark, d).select("document_id", "page_number", "elem_idx", label.alias("label"), F.round(conf, 6).alias("conf"))


@query("j5_fonts", sql("select document_id, page_number, elem_idx, round(greatest(8.0, (y2 - y1) / greatest(n_lines, 1) * 0.75), 6) font_size, round((y2 - y1) / greatest(n_lines, 1), 6) line_height, density > 0.15 bold from regions", "regions"))
def j5(spark, d):
    size, line, bold = layout.font_info(F.col("y2") - F.col("y1"), F.col("n_lines"), F.col("density"))
    return regions(corpus(spark, d)).select("document_id", "page_number", "elem_idx", F.round(size, 6).alias("font_size"), F.round(line, 6).alias("line_height"), bold.alias("bold"))


@query("j6_reading_order", sql("select document_id, page_number, elem_idx, reading_order, \"row\" from read_order", "read_order"))
def j6(spark, d):
    return layout.reading_order(regions(corpus(spark, d)))


@query("j7_layout_type", sql("select * from kinds", "kinds"))
def j7(spark, d):
    return layout.layout_type(regions(corpus(spark, d)))


@query("j8_columns", sql("select * from columns_of", "columns_of"))
def j8(spark, d):
    return layout.column_count(regions(corpus(spark, d)))


@query("j9_summary", sql("select document_id, total_pages, total_elements, element_types, round(mc, 6) avg_confidence, round(mo, 6) avg_ocr_confidence, md5(extracted_text) text_md5, layout_types, column_info from summaries", "summaries"))
def j9(spark, d):
    types = F.array_join(F.transform(F.array_sort(F.map_entries("element_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return layout.document_summary(labelled(spark, d)).select(
        "document_id", "total_pages", "total_elements", types.alias("element_types"), F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_ocr_confidence", 6).alias("avg_ocr_confidence"),
        F.md5("extracted_text").alias("text_md5"), F.array_join("layout_types", ",").alias("layout_types"), F.array_join("column_info", ",").alias("column_info"),
    )


@query("j10_complexity", sql("select document_id, round(complexity, 9) complexity from summaries", "summaries"))
def j10(spark, d):
    return layout.document_summary(labelled(spark, d)).select("document_id", F.round("complexity_score", 9).alias("complexity"))
