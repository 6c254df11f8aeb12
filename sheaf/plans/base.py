"""Common parts of the queries' SQL: the derived tables as common table expressions, in DuckDB's dialect."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicon import HEADER_LATIN

Query = Callable[[SparkSession, str], DataFrame]

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CTE = {
    "corpus": "select cast(doc_id as varchar) document_id, source || '_' || doc_id || '.txt' file_name, source agency, lang source_type, date '2024-01-01' + cast(doc_id % 60 as integer) processed_date, text as content from documents",
    "lines": "select document_id, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 pos from corpus",
    "marked": f"select *, {strip('line')} t, coalesce(sum(case when {strip('line')} <> '' then 1 else 0 end) over (partition by document_id order by pos rows between unbounded preceding and 1 preceding), 0) said from lines",
    "numbered": f"select *, sum(case when said > 0 and regexp_matches(t, {quoted(HEADER_LATIN)}) then 1 else 0 end) over (partition by document_id order by pos) sid from marked",
    "sectioned": f"select document_id, sid section_index, {strip('string_agg(line, chr(10) order by pos)')} section, max(sid) over (partition by document_id) last from numbered group by document_id, sid",
    "sections": "select s.document_id, section_index, case when last = 0 then c.content else section end section from sectioned s join corpus c using (document_id)",
    "cuts": f"select document_id, section_index, i, {strip('substr(section, i + 1, 1000)')} content from sections, unnest(range(0, greatest(length(section), 1), 800)) u(i)",
    "chunks": "select document_id, section_index, row_number() over (partition by document_id, section_index order by i) - 1 chunk_index, content from cuts where content <> ''",
    "named": "select *, md5(document_id || '_' || section_index || '_' || chunk_index) chunk_id from chunks",
    "tokens": r"select chunk_id, document_id, unnest(list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '')) term from named",
    "lens": r"select chunk_id, len(list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '')) dl from named",
    "size": "select count(*) n, avg(dl) avgdl from lens",
    "postings": "select chunk_id, term, count(*) tf from tokens group by all",
    "idf": "select term, count(*) df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf from postings, size group by term",
    "questions": "select item_id query_id, text query, embedding qvec from benchmark left join embeddings on vec_id = item_id",
    "qterms": r"select query_id, term, count(*) qtf from (select query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) term from questions) group by all",
    "scored": "select query_id, p.chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) bm25 from qterms join postings p using (term) join idf using (term) join lens using (chunk_id), size group by all",
    "kw": "select *, row_number() over (partition by query_id order by bm25 desc, chunk_id) rank from scored",
    "dists": "select query_id, cast(vec_id as varchar) id, label, round(list_sum(list_transform(list_zip(embedding, qvec), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))), 6) distance from questions, embeddings where qvec is not null",
    "nn": "select query_id, id, distance, row_number() over (partition by query_id order by distance, id) rank from dists",
    "v20": "select query_id, chunk_id id, distance, rank from nn join (select document_id vid, chunk_id from named where section_index = 0 and chunk_index = 0) on id = vid where rank <= 20",
    "k20": "select query_id, chunk_id id, bm25, rank from kw where rank <= 20",
    "sides": "select query_id, id, 1 / (1 + distance) vs, case when bm25 is not null then least(bm25 / 15, 1.0) end ks from v20 full join k20 using (query_id, id)",
    "weighed": "select query_id, id, coalesce(vs, 0.0) vector_score, coalesce(ks, 0.0) keyword_score, round((0.7 * coalesce(vs, 0.0) + 0.3 * coalesce(ks, 0.0)) * case when vs is not null and ks is not null then 1.2 else 1.0 end, 6) hybrid_score, case when vs is not null and ks is not null then 'hybrid' when vs is not null then 'vector' else 'keyword' end source from sides",
    "fused": "select * from (select *, row_number() over (partition by query_id order by hybrid_score desc, id) rank from weighed) where rank <= 10",
    "results": "select f.*, n.document_id, n.content, c.file_name, c.agency from fused f join named n on f.id = n.chunk_id join corpus c using (document_id)",
    "best": "select query_id, arg_min(content, rank) best, count(*) total_results from results group by query_id",
    "alone": "select query_id, coalesce(v, 0.0) v, coalesce(w, 0.0) w from (select query_id, greatest(0.0, least(1.0, 1 / (1 + distance))) v from nn where rank = 1) full join (select query_id, least(bm25 / 10, 1.0) w from kw where rank = 1) using (query_id) where query_id in (select query_id from best)",
    "conf": "select query_id, least(case when v > 0.1 and w > 0.1 then base * 1.05 else base end, 1.0) confidence from (select query_id, v, w, case when v > 0.3 and w > 0.3 then greatest(v, w, 1.1 * (0.7 * v + 0.3 * w)) else greatest(v, w) end base from (select query_id, coalesce(v, 0.0) v, coalesce(w, 0.0) w from questions left join alone using (query_id)))",
    "firsts": "select * from (select *, row_number() over (partition by query_id order by rank) source_rank from (select *, row_number() over (partition by query_id, file_name order by rank) n from results where rank <= 5) where n = 1) where source_rank <= 3",
    "listed": "select query_id, count(*) n_sources, string_agg(concat_ws(' | ', substr(content, 1, 200) || '...', file_name, coalesce(agency, 'Unknown'), cast(cast(hybrid_score as decimal(12, 6)) as varchar)), chr(10) order by source_rank) sources, string_agg(content, chr(10) || chr(10) order by source_rank) context from firsts group by query_id",
    "answered": "select query_id, query, case when confidence < 0.3 or best is null then 'No sufficiently relevant document was found.' else 'From the documents: ' || substr(best, 1, 500) || '...' end answer, round(confidence, 6) confidence, case when confidence < 0.3 then 'low' when confidence > 0.7 then 'high' else 'medium' end answer_confidence, 'hybrid' search_method, case when confidence >= 0.3 then coalesce(sources, '') else '' end sources, coalesce(n_sources, 0) n_sources, coalesce(total_results, 0) total_results from questions join conf using (query_id) left join best using (query_id) left join listed using (query_id)",
    "turns": "select conv_id || '-' || turn query_id, text query from conversations where role = 'user'",
    "log": "select event_id id, 'q' || (user_id % 20) query, event_type search_method, floor(value) % 100 / 100.0 confidence_score, value / 100.0 response_time, ts from events",
    "elements": f"select document_id, pos elem_idx, case when length({strip('line')}) < 60 and length({strip('line')}) > 0 and pos % 10 = 0 then 'title' when contains(line, '|') then 'table' when regexp_matches({strip('line')}, '^[-*•]') then 'list' else 'paragraph' end element_type, line text_content, cast(8 + length(line) % 12 as double) font_size, case when pos % 7 = 0 then 'bold' else 'normal' end font_weight, cast(floor(pos / 20) as integer) page_number from lines",
    "grouped": "select *, sum(case when element_type = 'title' then 1 else 0 end) over (partition by document_id order by elem_idx) group_id from elements",
    "regions": "select document_id, cast(floor(pos / 40) as integer) page_number, pos % 40 elem_idx, (pos % 40 % 2) * 300 x1, cast(floor((pos % 40) / 2) as integer) * 24 + length(line) % 13 y1, (pos % 40 % 2) * 300 + least(length(line) * 6, 280) x2, cast(floor((pos % 40) / 2) as integer) * 24 + length(line) % 13 + 8 + length(line) % 30 y2, length(line) % 10 / 10.0 confidence, length(line) % 7 / 7.0 ocr_confidence, line text_content, length(line) % 100 / 100.0 density, length(line) % 9 n_lines, length(line) % 4 h_lines, length(line) % 3 v_lines from lines",
    "labelled": r"select *, case when (h_lines >= 2 and v_lines >= 2) or contains(text_content, '│') or contains(text_content, '┌') or contains(text_content, '├') then 'table' when regexp_matches(text_content, '^\d+\.\s*[가-힣A-Za-z]+|^제\s*\d+\s*[장절항]|^[가-힣]+\s*[:：]\s*|^【.+】|^\s*[◆◇▣▢■□●○]\s*.+') then case when length(text_content) < 100 then 'title' else 'subtitle' end when regexp_matches(text_content, '^\s*[-*•]\s+|^\s*\d+\)\s+') then 'list' when density > 0.3 and n_lines > 5 then 'paragraph' else 'text' end as rule from regions",
    "heights": "select document_id, page_number, list_reduce(list_concat([{'y': cast(null as double), 'x': 0, 'e': 0, 'r': -1, 'out': cast([] as struct(r integer, x integer, y double, e integer)[])}], list({'y': cast(y1 as double), 'x': cast(x1 as integer), 'e': cast(elem_idx as integer), 'r': 0, 'out': cast([] as struct(r integer, x integer, y double, e integer)[])} order by y1, elem_idx)), lambda a, i: {'y': case when a.y is not null and abs(i.y - a.y) <= 20 then (a.y + i.y) / 2 else i.y end, 'x': 0, 'e': 0, 'r': case when a.y is not null and abs(i.y - a.y) <= 20 then a.r else a.r + 1 end, 'out': list_append(a.out, {'r': case when a.y is not null and abs(i.y - a.y) <= 20 then a.r else a.r + 1 end, 'x': i.x, 'y': i.y, 'e': i.e})}).out placed from regions group by document_id, page_number",
    "read_order": "select document_id, page_number, p.e elem_idx, p.r as \"row\", row_number() over (partition by document_id, page_number order by p.r, p.x, p.y, p.e) - 1 reading_order from (select document_id, page_number, unnest(placed) p from heights)",
    "kinds": "select document_id, page_number, n, case when l / n > 0.8 then 'single_column' when l > 0 and r > 0 and m / n < 0.3 then 'two_column' else 'complex' end layout_type from (select document_id, page_number, count(*) n, count(*) filter (c < 200) l, count(*) filter (c >= 200 and c < 400) m, count(*) filter (c >= 400) r from (select *, (x1 + x2) / 2 c from regions) group by 1, 2)",
    "columns_of": "select document_id, page_number, least(1 + count(*) filter (gap > 60), 3) as columns from (select *, c - lag(c) over (partition by document_id, page_number order by c, elem_idx) gap from (select *, (x1 + x2) / 2 c from regions)) group by 1, 2",
    "page_texts": r"select l.document_id, l.page_number, chr(10) || '[페이지 ' || l.page_number || ']' || chr(10) || coalesce(string_agg('[' || upper(rule) || '] ' || text_content || chr(10), '' order by reading_order) filter (regexp_matches(text_content, '\S')), '') page_text from labelled l join read_order using (document_id, page_number, elem_idx) group by 1, 2",
    "summaries": "select document_id, total_pages, total_elements, element_types, mc, mo, extracted_text, layout_types, column_info, least(n_types / 8, 1.0) * 0.25 + cs * 0.25 + least(n_chars / 20000, 1.0) * 0.25 + (1 - mo) * 0.25 complexity from (select document_id, count(*) total_elements, count(distinct rule) n_types, avg(confidence) mc, avg(ocr_confidence) mo, sum(length(text_content)) n_chars from labelled group by 1) join (select document_id, string_agg(rule || ':' || n, ',' order by rule) element_types from (select document_id, rule, count(*) n from labelled group by 1, 2) group by 1) using (document_id) join (select document_id, count(*) total_pages, string_agg(page_text, '' order by page_number) extracted_text, string_agg(layout_type, ',' order by page_number) layout_types, string_agg(columns, ',' order by page_number) column_info, avg(case when layout_type = 'complex' then 1.0 else 0.0 end) cs from page_texts join kinds using (document_id, page_number) join columns_of using (document_id, page_number) group by 1) using (document_id)",
}
#: What each needs, in order.
NEEDS = {
    "lines": ["corpus"], "marked": ["lines"], "numbered": ["marked"], "sectioned": ["numbered"], "sections": ["sectioned", "corpus"], "cuts": ["sections"], "chunks": ["cuts"], "named": ["chunks"],
    "tokens": ["named"], "lens": ["named"], "size": ["lens"], "postings": ["tokens"], "idf": ["postings", "size"], "qterms": ["questions"], "scored": ["qterms", "postings", "idf", "lens", "size"], "kw": ["scored"],
    "dists": ["questions"], "nn": ["dists"], "v20": ["nn", "named"], "k20": ["kw"], "sides": ["v20", "k20"], "weighed": ["sides"], "fused": ["weighed"], "results": ["fused", "named", "corpus"],
    "best": ["results"], "alone": ["nn", "kw", "best"], "conf": ["questions", "alone"], "firsts": ["results"], "listed": ["firsts"], "answered": ["conf", "best", "listed"], "elements": ["lines"], "grouped": ["elements"], "regions": ["lines"],
    "labelled": ["regions"], "heights": ["regions"], "read_order": ["heights"], "kinds": ["regions"], "columns_of": ["regions"], "page_texts": ["labelled", "read_order"], "summaries": ["labelled", "page_texts", "kinds", "columns_of"],
}


#: The chain from questions to answers.
SEARCH = ["qterms", "scored", "kw", "dists", "nn", "v20", "k20", "sides", "weighed", "fused", "results", "best", "alone", "conf", "firsts", "listed", "answered"]


def search_again(questions: str, suffix: str = "2") -> dict[str, str]:
    """The chain once more, for other questions: its expressions, each with the suffix behind its name."""
    def renamed(x: str) -> str:
        for name in SEARCH:
            x = re.sub(rf"\b{name}\b", f"{name}{suffix}", x)
        return re.sub(r"\bquestions\b", f"questions{suffix}", x)

    return {f"questions{suffix}": questions} | {f"{name}{suffix}": renamed(CTE[name]) for name in SEARCH}


def sql(body: str, *names: str, **extra: str) -> str:
    """The body after the expressions that it and they need; extra ones come last."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as materialized ({CTE[n]})" for n in order] + [f"{n} as materialized ({x})" for n, x in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
