"""Statistics of documents and of the search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def like(column: Column, term: str) -> Column:
    """Contains the term, whatever the case; % and _ in it are ordinary."""
    safe = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{safe}%")


def filter_documents(docs: DataFrame, agency: str = "", business_type: str = "", date_from: str = "", date_to: str = "", least_budget: int | None = None) -> DataFrame:
    """Documents by agency (or title), business type, dates and budget; empty conditions are ignored."""
    if agency:
        title = like(F.col("title"), agency) if "title" in docs.columns else F.lit(False)
        docs = docs.where(like(F.col("agency"), agency) | title)
    if business_type:
        docs = docs.where(like(F.col("business_type"), business_type))
    if date_from:
        docs = docs.where(F.col("processed_date") >= F.lit(date_from).cast("date"))
    if date_to:
        docs = docs.where(F.col("processed_date") <= F.lit(date_to).cast("date"))
    if least_budget is not None:
        docs = docs.where(F.col("budget_krw") >= least_budget)
    return docs


def paths_by_agency(docs: DataFrame, agency: str) -> DataFrame:
    return filter_documents(docs, agency=agency).select("document_id", "file_name")


def document_chunks(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("section_index", "chunk_index")


def totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks")))  # one row each


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_agencies(docs: DataFrame, top: int = 20) -> DataFrame:
    return count_by(docs.where("agency is not null and agency <> ''"), "agency").orderBy(F.desc("n"), "agency").limit(top)


def documents_per_day(docs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    day = F.col("processed_date").cast("date")
    recent = docs.where((day >= F.date_sub(F.lit(as_of).cast("date"), days)) & (day <= F.lit(as_of).cast("date")))
    return recent.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def sample_chunks(chunks: DataFrame, n: int = 100, seed: int = 7) -> DataFrame:
    """n chunks by a seeded hash, the same in every run."""
    return chunks.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "chunk_id")), "chunk_id").limit(n)


def history(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest n searches, null scores as 0."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", "query", "search_method", F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("response_time", F.lit(0.0)).alias("response_time"), "ts")


def patterns(log: DataFrame, categories: dict[str, list[str]], n: int = 100, top: int = 10) -> DataFrame:
    """Long table (metric, name, value) over the newest n searches: total, mean confidence, frequent words, categories (the first that fits, whatever the case; searches that fit none are not counted)."""
    rows = history(log, n)
    words = rows.select(F.explode(F.split(F.lower("query"), r"\s+")).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "name").limit(top)
    kind = F.lit(None).cast("string")
    for name, parts in reversed(list(categories.items())):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower("query"), F.lit(p))
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    kinds = rows.where(kind.isNotNull()).groupBy(kind.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    as_rows = lambda df, metric: df.select(F.lit(metric).alias("metric"), "name", F.col("value").cast("double").alias("value"))
    one = rows.agg(F.count(F.lit(1)).alias("t"), F.round(F.avg("confidence_score"), 6).alias("c"))
    return as_rows(words, "word").unionByName(as_rows(kinds, "category")).unionByName(one.select(F.lit("total").alias("metric"), F.lit("").alias("name"), F.col("t").cast("double").alias("value"))).unionByName(one.select(F.lit("mean_confidence").alias("metric"), F.lit("").alias("name"), F.col("c").alias("value")))


def hit_statistics(log: DataFrame, level: str = "level") -> DataFrame:
    """Hits, misses and the hit rate for each level and over all."""
    agg = log.rollup(level).agg(F.count_if("from_cache").alias("hits"), F.count_if(~F.col("from_cache")).alias("misses"))
    return agg.select(F.coalesce(level, F.lit("all")).alias("level"), "hits", "misses", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6).alias("hit_rate"))


def against_baseline(log: DataFrame, baseline: str, by: str = "search_method") -> DataFrame:
    """Mean confidence and time of each group, as percentages of the baseline group's (times inverted)."""
    means = log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_score").alias("conf"), F.avg("response_time").alias("time"))
    base = means.where(F.col(by) == baseline).select(F.col("conf").alias("base_conf"), F.col("time").alias("base_time"))
    return means.crossJoin(F.broadcast(base)).select(by, "n", F.round(F.col("conf") / F.col("base_conf") * 100, 6).alias("confidence_pct"), F.round(F.col("base_time") / F.col("time") * 100, 6).alias("speed_pct"))  # one row


def log_windows(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Searches, mean confidence and time for each window and method; the same expression serves batches and streams."""
    grouped = log.groupBy(F.window("ts", width).alias("w"), "search_method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"), F.round(F.avg("response_time"), 6).alias("mean_time"))
    return grouped.select(F.col("w.start").alias("window_start"), "search_method", "n", "mean_confidence", "mean_time")


def lookups(docs: DataFrame, document_id: str, term: str, n: int) -> DataFrame:
    """The rows of three look-ups: by id, by a part of the file name, and the first n by id."""
    pick = lambda df, kind: df.select(F.lit(kind).alias("lookup"), "document_id", "file_name")
    return pick(docs.where(F.col("document_id") == document_id), "point").unionByName(pick(docs.where(like(F.col("file_name"), term)), "like")).unionByName(pick(docs.orderBy(F.col("document_id").cast("long"), "document_id").limit(n), "first"))


def running_progress(batches: DataFrame) -> DataFrame:
    """For each batch of a run the sums so far. batches: run, batch, ok, failed."""
    run = W.partitionBy("run").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("run")
    done = F.sum(F.col("ok") + F.col("failed")).over(run)
    return batches.select("run", "batch", "ok", "failed", done.alias("done"), F.round(done * 100.0 / F.sum(F.col("ok") + F.col("failed")).over(every), 6).alias("progress_pct"), F.round(F.sum("ok").over(run) * 100.0 / done, 6).alias("success_pct"))


#: The sketches have two to so many places; their relative error is 1.04 over the root of that, about.
SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The standard error of a distinct count by sketches, as a share of it."""
    return 1.04 / 2 ** (bits / 2)


def distinct_sketches(rows: DataFrame, column: str, by: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """by, sketch: what a batch keeps of its distinct values: some kilobytes, however many there are. Nulls are no values."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(column, bits).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, distinct: the number of distinct values over all batches, from their sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
