"""The registered queries of this subpackage, and their SQL where SQL can express them.

Hashes, alignments, models and encodings are no SQL. What of an operator's result is, a query of its own takes out
of the operator's report (llm_...), with the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprints, jaccard, licenses, linededup, mixing, neighbours, packing, quality, spelling, toxicity, urls
from .common import id_again, text_of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3(docs: DataFrame) -> DataFrame:
    found = jaccard.near_classes(docs)
    return found.select(id_again("_id").alias("doc_id"), id_again("class_id").alias("class_id"), "n_links")


def op7(docs: DataFrame) -> DataFrame:
    left = text_of("_doc.text")
    cut = linededup.dedup_lines(docs.select("doc_id", "text"))
    how = lambda which: F.coalesce(F.size(F.filter("_blocks", which)), F.lit(0)).cast("long")
    return cut.select(
        "_doc.doc_id", F.col("_lines").alias("lines_deleted"), F.col("_words").alias("words_deleted"), F.length(left).cast("long").alias("chars_left"), F.sha2(left.cast("binary"), 256).alias("text_sha256"),
        how(lambda b: ~b["moved"]).alias("blocks_aligned"), how(lambda b: b["moved"] & ~b["frequent"]).alias("blocks_crossed"), how(lambda b: b["frequent"]).alias("blocks_frequent"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": lambda spark, d: fingerprints.fingerprint_report(read(spark, d, "documents")),
    "op2_licenses": lambda spark, d: licenses.license_report(read(spark, d, "documents")),
    "op3_jaccard": lambda spark, d: op3(read(spark, d, "documents")),
    "op4_mixing": lambda spark, d: mixing.mix_report(read(spark, d, "documents")),
    "op5_packing": lambda spark, d: packing.packed_report(read(spark, d, "documents")),
    "op6_quality": lambda spark, d: quality.quality_report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op7_linededup": lambda spark, d: op7(read(spark, d, "documents")),
    "op8_bpe": lambda spark, d: bpe.encode_report(read(spark, d, "documents")),
    "op9_urls": lambda spark, d: urls.url_report(read(spark, d, "pages")),
    "op10_toxicity": lambda spark, d: toxicity.toxicity_report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op11_neighbours": lambda spark, d: neighbours.neighbour_report(read(spark, d, "embeddings")),
    "op12_spelling": lambda spark, d: spelling.variant_report(read(spark, d, "documents")),
    "op13_conversations": lambda spark, d: conversations.repair_report(read(spark, d, "conversations")),
}
QUERIES |= {
    "llm_fingerprint_texts": lambda spark, d: fingerprints.fingerprint_report(read(spark, d, "documents")).select("doc_id", "n_chars", "edited_sha256"),
    "llm_license_places": lambda spark, d: licenses.license_report(read(spark, d, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "llm_mix_targets": lambda spark, d: mixing.mix_report(read(spark, d, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target")),
    "llm_mix_totals": lambda spark, d: mix_totals(read(spark, d, "documents")),
    "llm_quality_counts": lambda spark, d: quality.quality_report(read(spark, d, "documents"), read(spark, d, "labels")).select("doc_id", *quality.COUNTS, "base_failed"),
    "llm_url_rules": lambda spark, d: urls.url_report(read(spark, d, "pages")).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict")),
}


def mix_totals(docs: DataFrame) -> DataFrame:
    """The words that the mix takes of each source."""
    draws = mixing.mix(docs)
    return draws.groupBy("source").agg(F.sum("words").cast("long").alias("taken"), F.max("source_size").alias("source_size"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACES = {label: "list_filter(range(1, len(ws) + 1), lambda i: " + " and ".join(f"coalesce(ws[i + {k}] = '{w}', false)" for k, w in enumerate(phrase.split())) + ")" for phrase, label in licenses.BASE_PHRASES}
_TARGETS = """sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size from documents),
totals as (select source, sum(size) n from sized group by 1),
weighted as (select source, n, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] w, row_number() over (order by source nulls last) i from totals),
ordered as (select *, sum(n) over () - coalesce(sum(3 * n) over earlier, 0) rest, sum(w) over () - coalesce(sum(w) over earlier, 0) ws, row_number() over (order by 3 * n / w, i) r from weighted window earlier as (order by 3 * n / w, i rows between unbounded preceding and 1 preceding)),
level as (select rest / ws share, r from ordered where w * rest / ws <= 3 * n order by r limit 1),
goals as (select source, n, case when o.r < coalesce(l.r, 1000000000) then 3.0 * n else w * share end target from ordered o left join level l on true)"""
_HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULE = "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))) + " end"

ORACLE_SQL: dict[str, str] = {
    "llm_fingerprint_texts": "select doc_id, length(t) n_chars, sha256(left(t, length(t) - length(t) // 2) || left(coalesce(after, head), length(t) // 2)) edited_sha256 from (select *, lead(t) over (order by doc_id) after, first_value(t) over (order by doc_id) head from (select doc_id, coalesce(text, '') t from documents))",
    "llm_license_places": f"select doc_id, len(ws) n_words, len(places) n_base, list_min(places) - 1 first_word, list_max(places) - 1 last_word, concat_ws(',', {', '.join(f'case when len({label}) > 0 then {label!r} end' for label in sorted(_PLACES))}) base_labels from (select *, list_concat({', '.join(_PLACES)}) places from (select doc_id, ws, {', '.join(f'{x} {label}' for label, x in _PLACES.items())} from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents)))",
    "llm_mix_targets": f"with {_TARGETS} select doc_id, size, n source_size, round(target, 6) target from sized s join goals g on s.source is not distinct from g.source",
    "llm_mix_totals": f"with {_TARGETS} select source, cast(floor(target + 0.5) as bigint) taken, n source_size from goals",
    "llm_quality_counts": """with ws as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
windows as (select doc_id, p, array_to_string(w[p:p + 4], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 3)) p from ws)),
repeated as (select doc_id, p from (select *, count(*) over (partition by doc_id, x) n from windows) where n > 1),
marked as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 5)) q from repeated) group by 1),
dup as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, chr(10))) l from ws) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1)
select ws.doc_id, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(m.n, 0) n_repeat_words, len(w) < 10 or 100 * coalesce(m.n, 0) > 20 * len(w) base_failed
from ws left join marked m on ws.doc_id = m.doc_id left join dup on ws.doc_id = dup.doc_id""",
    "llm_url_rules": f"select page_id, host, path, rule, case {' '.join(f'when rule = {h + p!r} then {v!r}' for h, p, v in urls.RULES)} end verdict from (select *, {_RULE} as rule from (select page_id, {_HOST} host, {_PATH} path from pages))",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
