"""Readers of the given tables, and the engine's inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, file_name, agency, source_type, processed_date, content."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_name"),
        F.col("source").alias("agency"),
        F.col("lang").alias("source_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("processed_date"),
        F.col("text").alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, qvec: every benchmark item with the vector of its number, null where there is none."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return items.join(vecs, "query_id", "left")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: every turn of a user."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, query, search_method, confidence_score, response_time, ts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("query"), F.col("event_type").alias("search_method"),
        (F.floor("value") % 100 / 100.0).alias("confidence_score"), (F.col("value") / 100.0).alias("response_time"), "ts",
    )


def lines(corpus: DataFrame) -> DataFrame:
    """document_id, pos, line of every text."""
    return corpus.select("document_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))


def elements(corpus: DataFrame) -> DataFrame:
    """The lines as layout elements: type, font and page by rule."""
    t = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = F.when((F.length(t) < 60) & (F.length(t) > 0) & (F.col("pos") % 10 == 0), "title").when(F.col("line").contains("|"), "table").when(t.rlike(r"^[-*•]"), "list").otherwise("paragraph")
    return lines(corpus).select(
        "document_id", F.col("pos").alias("elem_idx"), kind.alias("element_type"), F.col("line").alias("text_content"),
        (8 + F.length("line") % 12).cast("double").alias("font_size"), F.when(F.col("pos") % 7 == 0, "bold").otherwise("normal").alias("font_weight"), F.floor(F.col("pos") / 20).cast("int").alias("page_number"),
    )


#: The pages that regions() makes: width and height.
PAGE_SIZE = (600, 500)


def regions(corpus: DataFrame) -> DataFrame:
    """The lines as regions of pages of 40 lines in two uneven columns, with figures by their lengths."""
    n, at = F.length("line"), F.col("pos") % 40
    x1, y1 = (at % 2) * 300, F.floor(at / 2).cast("int") * 24 + n % 13
    return lines(corpus).select(
        "document_id", F.floor(F.col("pos") / 40).cast("int").alias("page_number"), at.cast("int").alias("elem_idx"), x1.cast("int").alias("x1"), y1.alias("y1"),
        (x1 + F.least(n * 6, F.lit(280))).cast("int").alias("x2"), (y1 + 8 + n % 30).alias("y2"), (n % 10 / 10.0).alias("confidence"), (n % 7 / 7.0).alias("ocr_confidence"), F.col("line").alias("text_content"), (n % 100 / 100.0).alias("density"),
        (n % 9).alias("n_lines"), (n % 4).alias("h_lines"), (n % 3).alias("v_lines"),
    )
