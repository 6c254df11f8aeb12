"""Sources, sinks and bookkeeping of ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def scan_files(spark: SparkSession, directory: str, extensions: list[str]) -> DataFrame:
    """path, length and modificationTime of all files below the directory; contents are read only if selected later."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return guard(with_file_columns(files), extensions)


def with_file_columns(files: DataFrame) -> DataFrame:
    """Adds file_name, file_ext and document_id."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    ext = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    rows = files.withColumn("file_name", name).withColumn("file_ext", ext)
    return rows.withColumn("document_id", document_id(F.col("path"), F.col("file_name"), F.col("file_ext")))


def document_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *parts))


def guard(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Adds error_message: null for supported extensions."""
    return files.withColumn("error_message", F.when(~F.col("file_ext").isin([e.lower() for e in extensions]), F.concat(F.lit("unsupported file type: "), "file_ext")))


def remaining(files: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


#: Column names that a metadata file may have, by target column.
ALIASES = {
    "file_name": ["파일명", "file_name"], "agency": ["발주기관", "agency"], "business_name": ["사업명", "business_name"],
    "budget": ["예산", "budget"], "deadline": ["마감일", "deadline"], "business_type": ["사업분야", "business_type"],
}


def import_metadata(spark: SparkSession, path: str, existing: DataFrame, prefix: str = "data/files/") -> DataFrame:
    """existing and the file's new rows (insert or ignore by id). The id is that of the file, as ingest makes it."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    columns = {c.lstrip("﻿"): c for c in raw.columns}
    picked = {t: F.coalesce(*[F.nullif(F.col(f"`{columns[n]}`"), F.lit("")) for n in names if n in columns], F.lit(None).cast("string")) for t, names in ALIASES.items()}
    rows = raw.select(*[c.alias(t) for t, c in picked.items()]).where("file_name is not null")
    path_of = F.concat(F.lit(prefix), "file_name")
    ext = F.lower(F.regexp_extract("file_name", r"\.[^./]+$", 0))
    rows = rows.withColumn("path", path_of).withColumn("document_id", document_id(path_of, F.col("file_name"), ext))
    one = rows.withColumn("_n", F.row_number().over(W.partitionBy("document_id").orderBy("agency", "business_name", "budget"))).where("_n = 1").drop("_n")
    return existing.unionByName(one.join(existing.select("document_id"), "document_id", "left_anti"), allowMissingColumns=True)


def enrich(docs: DataFrame, metadata: DataFrame, columns: list[str], key: str = "file_name") -> DataFrame:
    """The metadata's columns win where they are not null. A key that repeats in the metadata counts once."""
    side = metadata.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in columns])
    joined = docs.join(side, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", *([c] if c in docs.columns else [])).alias(c) if c in columns else c for c in dict.fromkeys([*docs.columns, *columns])])


def upsert(existing: DataFrame, new: DataFrame, key: str = "document_id", order: str | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Insert or replace by key; of new rows with one key the last by `order` (else by all columns) wins; nulls of new rows get defaults."""
    for column, value in (defaults or {}).items():
        new = new.withColumn(column, F.coalesce(column, F.lit(value)))
    last = [F.desc(order)] if order else [F.desc(c) for c in new.columns if c != key]
    new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*last))).where("_n = 1").drop("_n")
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(existing.columns))


def chunk_rows(chunks: DataFrame, preview: int = 200) -> DataFrame:
    """The chunk table's columns: full content, its preview and size."""
    return chunks.select("chunk_id", "document_id", "section_index", "chunk_index", "content", F.substring("content", 1, preview).alias("content_preview"), F.length("content").alias("chunk_size"))


def export_documents(docs: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, newest first. The byte order mark of the original is left out."""
    docs.select(*columns).orderBy(F.desc("processed_date"), "document_id").write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def snapshot(tables: dict[str, DataFrame], path: str, stamp: int) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_ts={stamp}")


def append_log(answers: DataFrame, path: str, now: Column) -> None:
    """One row for each answered question."""
    answers.select("query", "search_method", F.col("total_results").alias("results_count"), F.col("confidence").alias("confidence_score"), now.alias("timestamp")).write.mode("append").parquet(path)


def summary(outcomes: DataFrame, shown: int = 5) -> DataFrame:
    """One row: totals, chunks, success rate and the first errors. outcomes: document_id, success, total_chunks, error_message."""
    errors = outcomes.where(~F.col("success")).orderBy("document_id").limit(shown).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "document_id", "error_message"))), "; ").alias("errors"))
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"),
        F.round(F.count_if("success") * 100.0 / F.count(F.lit(1)), 6).alias("success_pct"),
    )
    return totals.crossJoin(errors)  # one row each


def merge_pages(pages: DataFrame) -> DataFrame:
    """document_id and one text of all pages that are not blank, each after a marker. pages: document_id, page_no, text."""
    said = pages.where(F.regexp_replace("text", r"^\s+|\s+$", "") != "")
    part = F.concat(F.lit("\n--- page "), (F.col("page_no") + 1).cast("string"), F.lit(" ---\n"), "text")
    return said.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", part.alias("part")))), lambda x: x["part"]), "").alias("content"))


def merge_analyses(docs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Texts with what was read from their images appended. analyses: document_id, image_index, extracted_text, description."""
    said = analyses.where("extracted_text is not null and extracted_text <> ''")
    more = F.when(F.col("description").isNotNull() & (F.col("description") != F.col("extracted_text")), F.concat(F.lit("\n"), "description")).otherwise(F.lit(""))
    block = F.concat(F.lit("\n[image "), (F.col("image_index") + 1).cast("string"), F.lit("]\n"), "extracted_text", more)
    blocks = said.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("image_index", block.alias("b")))), lambda x: x["b"]), "").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    return docs.join(blocks, "document_id", "left").withColumn("content", F.concat("content", F.coalesce("_blocks", F.lit("")))).withColumn("n_analyses", F.coalesce("_n", F.lit(0))).drop("_blocks", "_n")


def parse_reply(reply: Column) -> Column:
    """struct<extracted_text, description, content_type> of a model's reply: the fenced block, else the whole; the raw text and type unknown if it is no JSON, type other if it names none."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```json\s*(.*?)```", 1), F.lit(""))
    parsed = F.from_json(F.coalesce(fenced, reply), "extracted_text string, description string, content_type string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    ok = parsed.isNotNull() & parsed["_corrupt"].isNull()
    return F.struct(
        F.when(ok, F.coalesce(parsed["extracted_text"], F.lit(""))).otherwise(reply).alias("extracted_text"),
        F.when(ok, F.coalesce(parsed["description"], F.lit(""))).otherwise(reply).alias("description"),
        F.when(ok, F.coalesce(parsed["content_type"], F.lit("other"))).otherwise(F.lit("unknown")).alias("content_type"),
    )


def error_content(text: Column, name: Column, error: Column) -> tuple[Column, Column]:
    """(text, processing_error): a placeholder where nothing was extracted."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "") == ""
    return F.when(blank, F.concat(F.lit("[no text could be extracted: "), name, F.lit("]"))).otherwise(text), F.when(error.isNotNull(), error)


#: The first bytes of image files, in hexadecimal.
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


def image_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def first_images(images: DataFrame, per_document: int = 5, pages: int = 10) -> DataFrame:
    """Of the first pages the first images of each document. images: document_id, page, idx, ..."""
    order = W.partitionBy("document_id").orderBy("page", "idx")
    return images.where(F.col("page") < pages).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_document).drop("_n")


def image_inventory(images: DataFrame) -> DataFrame:
    return images.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_images"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "page", "idx"))), ",").alias("images"))
