"""BM25 postings, statistics and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import terms
from ..sources.scratch import written
from .chunking import smart_chunks

K1, B = 1.5, 0.75
#: Rows of terms, ids or questions that a side has at most where it is broadcast; more are joined by shuffles.
BROADCAST_ROWS = 200_000


def small(side: DataFrame, rows: int) -> DataFrame:
    """The side of a join, broadcast if so many rows are few enough."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def counted(chunks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, the carried columns, dl, counts: array<struct<term, tf>> of each chunk, sorted by term; a batch's tokens are counted together in the task that reads it."""
    rows = chunks.select("chunk_id", *carried, F.coalesce(F.lower("content"), F.lit("")).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(counting, f"{fields}, dl bigint, counts array<struct<term:string,tf:bigint>>")


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text in lower case, becomes its number of tokens and its counted terms."""
    for batch in batches:
        tokens = pc.list_flatten(split := pc.split_pattern_regex(batch.column(batch.num_columns - 1), r"[ \t\n\x0B\f\r]+"))
        place = np.repeat(np.arange(len(batch), dtype=np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        said = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        place, words = place[said], tokens.filter(pa.array(said)).dictionary_encode()
        names = words.dictionary.take(order := pc.sort_indices(words.dictionary))
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        pairs, tf = np.unique(place * max(1, len(names)) + rank[words.indices.to_numpy()], return_counts=True)
        row, code = np.divmod(pairs, max(1, len(names)))
        counts = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(tf, pa.int64())], ["term", "tf"])
        held = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), counts)
        dl = pa.array(np.bincount(place, minlength=len(batch)), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], dl, held], [*batch.schema.names[:-1], "dl", "counts"])


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(terms(F.col("content"))).cast("long").alias("dl"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, counted in the chunk's row, so that nothing is shuffled."""
    return counted(chunks).select("chunk_id", F.inline("counts"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: n, avgdl; empty chunks count with length 0."""
    return size_of(lengths(chunks))


def size_of(dl: DataFrame) -> DataFrame:
    return dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(chunks: DataFrame) -> DataFrame:
    """term, df, idf."""
    return idf_of(postings(chunks), chunks)


def idf_of(posted: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same from stored postings; chunks has a row for each chunk."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # one row


def refresh(posted: DataFrame, dl: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) after an ingest: what is stored of chunks that come again goes, and the new chunks' rows are added.

    Only the new chunks' texts are read, once: what is counted in them is written. df, idf, n and avgdl are aggregates of the two tables (idf_of, size_of).
    """
    more, more_dl = stored(new)
    again = more_dl.select("chunk_id").distinct()
    return posted.join(again, "chunk_id", "left_anti").unionByName(more), dl.join(again, "chunk_id", "left_anti").unionByName(more_dl)


def stored(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of one reading of the chunks, written."""
    held = written(counted(chunks), "counts")
    return held.select("chunk_id", F.inline("counts")), held.select("chunk_id", "dl")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: repeats count."""
    return queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def matches(chunks: DataFrame, queries: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, dl, the carried columns, term, tf: the questions' terms in each chunk, and a row with the term '' for each chunk.

    One scan serves all that search needs (which chunks there are, their lengths, df, tf), so it is written once and
    read from there. Terms are counted in the chunk's row; only those of a question leave the scan, a frequent one as a row a chunk.
    """
    wanted = query_terms(queries).select("term").distinct()
    every = F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"))
    rows = counted(chunks, carried).select("chunk_id", "dl", *carried, F.inline(F.concat(F.array(every), "counts")))
    also = wanted.union(chunks.sparkSession.range(1).select(F.lit("").alias("term")))
    return written(rows.join(small(also, wanted.count()), "term", "left_semi").select("chunk_id", "dl", *carried, "term", "tf"), "matches")


def ranked(found: DataFrame, queries: DataFrame, k: int = 10, rows: int = 200_000) -> DataFrame:
    """query_id, chunk_id, bm25, rank from matches: chunks that share a term with the question, ties by id.

    A frequent term meets many questions, so pairs of its chunks and questions are not made as rows: matches are dealt
    by chunk to parts of about so many rows; each part meets the questions' weights in a task of its own, adds them up as
    products with blocks of questions, and keeps k for each. The final k are ranked per question.
    """
    hits = found.where("term <> ''")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = size_of(found.where("term = ''"))
    weighted = query_terms(queries).join(df, "term").crossJoin(F.broadcast(size))  # one row
    weighted = weighted.select("query_id", "term", (F.col("qtf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = max(1, -(-hits.count() // rows))
    left = hits.crossJoin(F.broadcast(size.select("avgdl"))).select("chunk_id", "term", part.alias("share"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("_part"))  # one row
    right = weighted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = queries.schema["query_id"].dataType.simpleString()
    best = left.groupBy("_part").cogroup(right.groupBy("_part")).applyInPandas(best_of(k), f"query_id {kind}, chunk_id string, bm25 double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id"))).where(F.col("rank") <= k)


def best_of(k: int, block: int = 64, slice_rows: int = 50_000) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For each question the k chunks of a part with the largest sums of share x weight over its terms."""

    def score(shares: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shares) and len(weights):
            terms_, at = np.unique(weights["term"].to_numpy(str), return_inverse=True)
            place = pd.Index(terms_).get_indexer(shares["term"])
            shares, place = shares[place >= 0], place[place >= 0]
            chunks, owner = np.unique(shares["chunk_id"].to_numpy(str), return_inverse=True)  # in the order of ties
            order = np.argsort(owner, kind="stable")
            owner, place, share = owner[order], place[order], shares["share"].to_numpy()[order]
            asked, query = np.unique(weights["query_id"].to_numpy(), return_inverse=True)
            value = weights["w"].to_numpy()
            for lo in range(0, len(asked), block):
                mine = (query >= lo) & (query < lo + block)
                table = np.zeros((len(terms_), min(block, len(asked) - lo)))
                table[at[mine], query[mine] - lo] = value[mine]
                sums = np.zeros((len(chunks), table.shape[1]))
                for a in range(0, len(owner), slice_rows):
                    some = slice(a, a + slice_rows)
                    starts = np.flatnonzero(np.r_[True, np.diff(owner[some]) > 0])
                    sums[owner[some][starts]] += np.add.reduceat(table[place[some]] * share[some, None], starts, axis=0)
                for j in range(table.shape[1]):
                    held = np.flatnonzero(sums[:, j] > 0)
                    rounded = np.round(sums[held, j], 6)
                    if len(held) > k:
                        keep = rounded >= np.partition(rounded, len(held) - k)[len(held) - k]
                        held, rounded = held[keep], rounded[keep]
                    first = np.argsort(-rounded, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": [asked[lo + j]] * len(first), "chunk_id": chunks[held[first]], "bm25": rounded[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "bm25": []}).astype({"chunk_id": str})

    return score


def search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best chunks of each question by BM25."""
    return ranked(matches(chunks, queries), queries, k)


def contents(found: DataFrame, documents: DataFrame, most: int, corpus: DataFrame, cut: Callable[[DataFrame], DataFrame] = smart_chunks) -> DataFrame:
    """found (id, ...) with document_id and content; documents: the `most` document_ids at most that found's chunks belong to.

    Only these documents of the corpus are cut into chunks again, by the same function that made the chunks.
    """
    mine = cut(corpus.join(small(documents.select("document_id").distinct(), most), "document_id", "left_semi"))
    return found.join(mine.select(F.col("chunk_id").alias("id"), "document_id", "content"), "id")


def keyword_search(chunks: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, cut: Callable[[DataFrame], DataFrame] = smart_chunks) -> DataFrame:
    """search with the score scaled to 0..1 and the chunk's content; `cut` made the chunks of the corpus."""
    held = matches(chunks, queries, ("document_id",))
    found = written(ranked(held, queries, k), "ranked")
    most = k * queries.count()
    of = held.where("term = ''").select("chunk_id", "document_id").join(small(found.select("chunk_id").distinct(), most), "chunk_id", "left_semi")
    rows = contents(found.withColumnRenamed("chunk_id", "id"), of, most, corpus, cut)
    return rows.select("query_id", "rank", "id", "document_id", "bm25", F.least(F.col("bm25") / 10, F.lit(1.0)).alias("keyword_score"), "content")


def index_input(chunks: DataFrame, chunk_meta: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Chunks with their own metadata, else their document's, else an empty map; JSON that does not parse counts as empty."""
    as_map = lambda c: F.from_json(c, "map<string,string>")
    joined = chunks.join(chunk_meta, "chunk_id", "left").join(doc_meta, "document_id", "left")
    return joined.withColumn("metadata", F.coalesce(as_map(F.col("chunk_json")), as_map(F.col("doc_json")), F.create_map().cast("map<string,string>")))
