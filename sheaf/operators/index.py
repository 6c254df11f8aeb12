"""A stored inverted index: postings by term in blocks of chunks, each with what its scores can reach at most, and additive statistics.

Chunks are kept in blocks of about BLOCK_CHUNKS, in the order in which they were read, each block one row (`forward`). A term's postings in a
block are its places there, frequencies, and the largest frequency and shortest chunk among them. From
these a bound follows for any mean length, so that statistics may change without touching postings. A block's postings are made in the task that
reads its chunks and stored in folders by a hash of the term, a row for each block and folder, so no texts, terms or postings are shuffled.
A search reads the folders of its terms only, and never the texts.

Statistics are rows that add up: a batch of chunks brings its numbers, and takes away those of the chunks it
replaces, which are found in the forward rows of their documents' folders and in the postings of their blocks. Replaced chunks' postings stay where
they are; a list of dead chunks keeps them out of answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from .bm25 import K1, B, contents, query_terms, small
from .chunking import smart_chunks

#: Chunks of a block, about; folders of terms and of documents.
BLOCK_CHUNKS, BUCKETS = 1024, 16
#: Postings that a task of a search meets at once, about; questions whose terms travel as one row; such rows that a task holds at most.
PART_POSTINGS, QUESTIONS, ROWS_AT_ONCE = 200_000, 256, 64
#: Tasks of a search at most, or twice the cores if there are more: each gets all questions and gives k for each, so their number must not grow with the index.
STREAMS = 24


@dataclass
class Index:
    """The parts of an index, as tables. A refresh adds rows to each and rewrites none."""

    forward: DataFrame  # bucket, batch, block, c (chunk_id, dl, the carried columns), by documents' buckets
    lists: DataFrame  # bucket, batch, block, l (term, n, max_tf, min_dl, pos, tf), by terms' buckets
    df: DataFrame  # term, df: to be added up
    size: DataFrame  # n, total: to be added up
    dead: DataFrame  # batch, block, chunk_id
    batch: int = 0

    @property
    def postings(self) -> DataFrame:
        """bucket, batch, block, term, n, max_tf, min_dl, pos, tf."""
        return self.lists.select("bucket", "batch", "block", F.inline("l"))


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def term_bucket(column: str) -> Column:
    return (F.crc32(F.col(column).cast("binary")) % BUCKETS).cast("int")


#: What a block keeps of a term; where the rows of a block go: what it has of chunks, and its lists.
LIST, SIDES = "struct<term:string,n:bigint,max_tf:int,min_dl:bigint,pos:array<int>,tf:array<int>>", ("chunks", "lists")


def build(chunks: DataFrame, carried: tuple[str, ...] = (), batch: int = 0) -> Index:
    """The index of chunks (chunk_id, document_id, content and the carried columns), written to the scratch folder."""
    carried = tuple(dict.fromkeys(("document_id", *carried)))
    rows = chunks.select(bucket_of("document_id").alias("bucket"), F.struct("chunk_id", F.lit(0).cast("long").alias("dl"), *carried).alias("c"), F.coalesce(F.lower("content"), F.lit("")).alias("text"))
    schema = f"side string, bucket int, block bigint, c array<{rows.schema['c'].dataType.simpleString()}>, l array<{LIST}>"
    both = written(rows.mapInArrow(inverted(BLOCK_CHUNKS), schema), "index", "side", "bucket").withColumn("batch", F.lit(batch))
    chunk_side, list_side = (both.where(F.col("side") == side) for side in SIDES)
    forward, lists = chunk_side.select("bucket", "batch", "block", "c"), list_side.select("bucket", "batch", "block", "l")
    df = written(lists.select(F.inline("l")).groupBy("term").agg(F.sum("n").alias("df")), "df")
    size = written(forward.select(F.explode("c.dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0).cast("long")).alias("total")), "size")
    none = forward.select("batch", "block", F.lit("").alias("chunk_id")).limit(0)
    return Index(forward, lists, df, size, none, batch)


def inverted(block_chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (bucket, c, text), as a task reads them, become blocks of one bucket: a row with the chunks, and one with the lists of each bucket of terms."""

    def block(number: int, bucket: int, rows: pa.Table) -> Iterator[tuple[str, int, int, pa.Array | None, pa.Array | None]]:
        tokens = pc.ascii_split_whitespace(rows["text"].combine_chunks())
        place = np.repeat(np.arange(len(rows), dtype=np.int64), pc.list_value_length(tokens).to_numpy())
        words = tokens.flatten()
        said = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        words, place = words.filter(pa.array(said)).dictionary_encode(), place[said]
        dl = np.bincount(place, minlength=len(rows))
        c = rows["c"].combine_chunks()
        c = pa.StructArray.from_arrays([pa.array(dl, pa.int64()) if f.name == "dl" else c.field(f.name) for f in c.type], fields=list(c.type))
        yield SIDES[0], bucket, number, c, None
        if not len(place):
            return
        names = words.dictionary
        of = np.fromiter((zlib.crc32(t.encode()) % BUCKETS for t in names.to_pylist()), np.int64, len(names))
        rank = np.empty(len(names), np.int64)
        order = np.argsort(of, kind="stable")
        rank[order] = np.arange(len(names))  # terms of one bucket stand together
        pairs, tf = np.unique(rank[words.indices.to_numpy()] * len(rows) + place, return_counts=True)
        code, pos = np.divmod(pairs, len(rows))
        starts = np.flatnonzero(np.r_[True, np.diff(code) > 0])
        ends = np.r_[starts[1:], len(code)]
        each = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)], pa.int32()), pa.array(x, pa.int32()))
        lists = pa.StructArray.from_arrays(
            [names.take(pa.array(order)), pa.array(ends - starts, pa.int64()), pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(dl[pos], starts), pa.int64()), each(pos), each(tf)],
            ["term", "n", "max_tf", "min_dl", "pos", "tf"],
        )
        bounds = np.searchsorted(of[order], np.arange(BUCKETS + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            yield SIDES[1], b, number, None, lists.slice(bounds[b], bounds[b + 1] - bounds[b])

    def row(side: str, bucket: int, number: int, c: pa.Array | None, lists: pa.Array | None, kind: pa.DataType, listed: pa.DataType) -> pa.RecordBatch:
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if x is not None else pa.nulls(1, pa.list_(t))
        return pa.RecordBatch.from_arrays([pa.array([side]), pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), one(c, kind), one(lists, listed)], ["side", "bucket", "block", "c", "l"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[pa.Table]] = {}
        listed = pa.struct([("term", pa.string()), ("n", pa.int64()), ("max_tf", pa.int32()), ("min_dl", pa.int64()), ("pos", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
        first, made, kind = TaskContext.get().partitionId() << 33, 0, None
        for batch in batches:
            kind = batch.schema.field("c").type
            bucket = batch.column("bucket").to_numpy()
            for b in np.unique(bucket).tolist():
                open_.setdefault(b, []).append(pa.Table.from_batches([batch]).filter(pa.array(bucket == b)))
                if sum(map(len, open_[b])) >= block_chunks:
                    rows = pa.concat_tables(open_.pop(b))
                    full = len(rows) // block_chunks * block_chunks
                    for lo in range(0, full, block_chunks):
                        yield from (row(*x, kind, listed) for x in block(first + made, b, rows.slice(lo, block_chunks)))
                        made += 1
                    if full < len(rows):
                        open_[b] = [rows.slice(full)]
        for b, rest in open_.items():
            yield from (row(*x, kind, listed) for x in block(first + made, b, pa.concat_tables(rest)))
            made += 1

    return go


def refreshed(index: Index, new: DataFrame, carried: tuple[str, ...] = ()) -> Index:
    """The index after an ingest of chunks, which replace those with their ids.

    Only the new texts are read, and of what is stored the forward rows of the new chunks' documents' folders, and the lists of the blocks that lose
    chunks. df, n and total get rows for what comes and, below zero, for what goes; no postings are made again.
    """
    added = build(new, carried, index.batch + 1)
    again = written(chunk_rows(added, ("document_id",)).select("chunk_id", bucket_of("document_id").alias("bucket")), "again")
    touched = [r["bucket"] for r in again.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    stored = index.forward.where(F.col("bucket").isin(touched)).select("batch", "block", F.posexplode(F.arrays_zip(F.col("c.chunk_id").alias("chunk_id"), F.col("c.dl").alias("dl"))).alias("p", "x"))
    gone = stored.select("batch", "block", "p", F.col("x.chunk_id").alias("chunk_id"), F.col("x.dl").alias("dl"))
    gone = written(gone.join(again.select("chunk_id"), "chunk_id", "left_semi").join(index.dead, ["batch", "block", "chunk_id"], "left_anti"), "gone")
    places = gone.groupBy("batch", "block").agg(F.collect_list("p").alias("_p"))  # BLOCK_CHUNKS numbers at most
    places = written(places.select("batch", "block", F.transform(F.sequence(F.lit(0), F.array_max("_p")), lambda i: F.array_contains("_p", i)).alias("_gone")), "places")
    lost = index.lists.join(small(places, gone.count()), ["batch", "block"]).select("_gone", F.inline("l")).select("term", F.size(F.filter("pos", lambda p: F.coalesce(F.get("_gone", p), F.lit(False)))).cast("long").alias("n")).where("n > 0")
    less = written(lost.groupBy("term").agg((-F.sum("n")).alias("df")), "less")
    fewer = gone.agg((-F.count(F.lit(1))).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0).cast("long"))).alias("total"))
    return replace(
        added, forward=index.forward.unionByName(added.forward), lists=index.lists.unionByName(added.lists), df=index.df.unionByName(added.df).unionByName(less),
        size=index.size.unionByName(added.size).unionByName(fewer), dead=index.dead.unionByName(gone.select("batch", "block", "chunk_id")),
    )


def sizes(index: Index) -> DataFrame:
    """One row: n, avgdl."""
    return index.size.agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))


def idf(index: Index, wanted: DataFrame | None = None) -> DataFrame:
    """term, df, idf; of the wanted terms only, if given."""
    rows = index.df if wanted is None else index.df.join(wanted, "term", "left_semi")
    df = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return df.crossJoin(F.broadcast(sizes(index))).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # one row


def chunk_rows(index: Index, columns: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """chunk_id and the carried columns of the chunks that are alive; of the forward rows only these columns are read."""
    names = ("chunk_id", *columns)
    each = index.forward.select("batch", "block", F.explode(F.arrays_zip(*[F.col(f"c.{c}").alias(c) for c in names])).alias("x")).select("batch", "block", *[F.col("x").getField(c).alias(c) for c in names])
    return each.join(index.dead, ["batch", "block", "chunk_id"], "left_anti").select(*names)


def search(index: Index, queries: DataFrame, k: int = 10, pad_zero: bool = False, part_postings: int = PART_POSTINGS) -> DataFrame:
    """query_id, chunk_id, bm25, rank: the k best chunks of each question, ties by id; of those only that share a term with it, or with pad_zero of all.

    The blocks are dealt to STREAMS tasks at most, each of which meets the questions' weights: it takes some blocks at a time, of about part_postings
    postings, by what they can reach for a question, and leaves out those that cannot reach its k-th score so far. What is shuffled are the
    terms' postings once, and the questions and their k best once for each task. More than QUESTIONS x ROWS_AT_ONCE questions
    take turns, with the postings again for each. The final k are ranked per question.
    """
    asked = query_terms(queries)
    wanted = asked.select("term").distinct()
    few = wanted.count()
    known = idf(index, small(wanted, few))
    weighted = written(asked.join(known, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df"), "weights")
    held = weighted.groupBy("term").agg(F.max("df").alias("df"))
    buckets = [r["bucket"] for r in held.select(term_bucket("term").alias("bucket")).distinct().collect()]  # BUCKETS numbers at most
    cores = queries.sparkSession.sparkContext.defaultParallelism
    streams = min(max(1, -(-(held.agg(F.sum("df")).first()[0] or 0) // part_postings)), max(STREAMS, 2 * cores))
    avgdl = sizes(index).first()["avgdl"] or 1.0
    groups = max(1, -(-queries.count() // QUESTIONS))
    turns = -(-groups // ROWS_AT_ONCE)
    block = weighted.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("_g")).agg(F.collect_list(F.struct("query_id", "term", "w")).alias("_block"))
    right = block.select(F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("_part"), "_g", "_block").withColumn("_part", (F.col("_part") + F.col("_g") % turns * streams).cast("int")).drop("_g")
    part = F.pmod(F.xxhash64("batch", "block"), F.lit(streams)).cast("int").alias("_part")
    lists = index.postings.where(F.col("bucket").isin(buckets)).join(small(held.select("term"), few), "term", "left_semi")
    gone = index.dead.groupBy("batch", "block").agg(F.collect_list("chunk_id").alias("dead"))
    names = index.forward.select("batch", "block", F.lit("").alias("term"), F.col("c.chunk_id").alias("ids"), F.col("c.dl").alias("dls")).join(gone, ["batch", "block"], "left")
    left = lists.select(part, "batch", "block", "term", "max_tf", "min_dl", "pos", "tf").unionByName(names.select(part, *names.columns), allowMissingColumns=True)
    if turns > 1:
        left = left.withColumn("_part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda i: (F.col("_part") + i * streams).cast("int"))))
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(streams * turns, F.col("_part")).sortWithinPartitions("batch", "block", "term")  # questions, of no block, come first; a block's names before its lists
    kind = queries.schema["query_id"].dataType.simpleString()
    best = both.mapInArrow(passing(k, float(avgdl), part_postings), f"query_id {kind}, chunk_id string, bm25 double")
    if pad_zero:  # the first 2 k ids hold k at least that are not among a question's k best
        first = chunk_rows(index, ()).orderBy("chunk_id").limit(2 * k).agg(F.sort_array(F.collect_list("chunk_id")).alias("_first"))
        best = written(best, "best")
        held = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.collect_list("chunk_id").alias("_held")), "query_id", "left")
        more = held.crossJoin(F.broadcast(first)).select("query_id", F.explode(F.array_except("_first", F.coalesce("_held", F.array().cast("array<string>")))).alias("chunk_id"))  # one row
        best = best.unionByName(more.withColumn("bm25", F.lit(0.0)))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id"))).where(F.col("rank") <= k)


def keyword_search(index: Index, queries: DataFrame, corpus: DataFrame, k: int = 10, cut: Callable[[DataFrame], DataFrame] = smart_chunks) -> DataFrame:
    """search with the score scaled to 0..1 and the chunk's content; `cut` made the chunks of the corpus."""
    found = written(search(index, queries, k), "ranked")
    most = k * queries.count()
    of = chunk_rows(index).join(small(found.select("chunk_id").distinct(), most), "chunk_id", "left_semi")
    rows = contents(found.withColumnRenamed("chunk_id", "id"), of, most, corpus, cut)
    return rows.select("query_id", "rank", "id", "document_id", "bm25", F.least(F.col("bm25") / 10, F.lit(1.0)).alias("keyword_score"), "content")


#: Lists of a block that meet the questions in one product.
LISTS_AT_ONCE = 2048


class Asked:
    """A row of questions: their weights (query_id, term, w), and the k best chunks of each so far."""

    def __init__(self, weights: pa.StructArray) -> None:
        queries, terms, w = weights.flatten()
        queries, terms = queries.dictionary_encode(), terms.dictionary_encode()
        self.questions, self.q, self.terms, self.t, self.w = queries.dictionary, queries.indices.to_numpy(), terms.dictionary, terms.indices.to_numpy(), w.to_numpy()
        self.best: list[list[tuple[float, str]]] = [[] for _ in self.questions]
        self.kth = np.full(len(self.questions), -np.inf)

    def found(self) -> pa.RecordBatch:
        """query_id, chunk_id, bm25."""
        of, held = np.repeat(np.arange(len(self.best)), [len(x) for x in self.best]), [x for best in self.best for x in best]
        return pa.RecordBatch.from_arrays([self.questions.take(pa.array(of)), pa.array([i for _, i in held], pa.string()), pa.array([-s for s, _ in held], pa.float64())], ["query_id", "chunk_id", "bm25"])


def meeting(k: int, avgdl: float, read: list | None = None) -> Callable[[pa.Table, list[Asked]], None]:
    """Meets some blocks (batch, block, term, max_tf, min_dl, pos, tf; with the term '' ids, dls, dead) with the questions, whose k best change. read: gets (question, block) of each block that is scored.

    A block of chunks meets, in one product, all questions of a row whose k-th score so far it can reach.
    """
    share = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    flat = lambda lists: pc.list_flatten(lists).to_numpy(zero_copy_only=False)

    def meet(rows: pa.Table, questions: list[Asked]) -> None:
        rows = rows.combine_chunks()
        heads = pc.equal(rows["term"], "")
        head, lists = rows.filter(heads), rows.filter(pc.invert(heads))
        if not len(lists):
            return
        place = {x: i for i, x in enumerate(zip(head["batch"].to_pylist(), head["block"].to_pylist(), strict=True))}
        keys = np.stack([lists["batch"].to_numpy(), lists["block"].to_numpy()])
        runs = np.flatnonzero(np.r_[True, (np.diff(keys) != 0).any(axis=0)])
        at = np.repeat([place[x] for x in zip(*keys[:, runs].tolist(), strict=True)], np.diff(np.r_[runs, len(lists)]))
        if (np.diff(at) < 0).any():
            order = np.argsort(at, kind="stable")
            lists, at = lists.take(pa.array(order)), at[order]
        of_block = lambda name: head[name].combine_chunks()
        of_list = lambda name: lists[name].combine_chunks()
        names, sizes_ = pc.list_flatten(of_block("ids")), pc.list_value_length(of_block("ids")).to_numpy()
        n, first = pc.list_value_length(of_list("pos")).to_numpy(), np.r_[0, np.cumsum(sizes_)].astype(np.int64)
        ends, bounds = np.r_[0, np.cumsum(n)], np.searchsorted(at, np.arange(len(head) + 1))
        alive = {}
        for b, dead in enumerate(head["dead"].to_pylist()):
            if dead:
                alive[b] = ~np.isin(names.slice(first[b], sizes_[b]).to_numpy(zero_copy_only=False).astype(str), dead)
        pos = flat(of_list("pos"))
        shares = share(flat(of_list("tf")).astype(float), flat(of_block("dls")).astype(float)[np.repeat(first[at], n) + pos])
        most = share(lists["max_tf"].to_numpy().astype(float), lists["min_dl"].to_numpy().astype(float))
        words = of_list("term").dictionary_encode()
        code, words = words.indices.to_numpy(), words.dictionary

        def sums_of(b: int, slot: np.ndarray, weights: np.ndarray) -> np.ndarray:
            some_lists = bounds[b] + np.flatnonzero(slot[code[bounds[b] : bounds[b + 1]]] >= 0)
            sums = np.zeros((sizes_[b], weights.shape[1]))
            for lo in range(0, len(some_lists), LISTS_AT_ONCE):
                some = some_lists[lo : lo + LISTS_AT_ONCE]
                table = np.zeros((sizes_[b], len(some)))
                at_ = np.repeat(ends[some] - np.r_[0, np.cumsum(n[some])[:-1]], n[some]) + np.arange(n[some].sum())
                table[pos[at_], np.repeat(np.arange(len(some)), n[some])] = shares[at_]
                sums += table @ weights[slot[code[some]]]
            return sums

        for asked in questions:
            held = pc.index_in(asked.terms, value_set=words).fill_null(-1).to_numpy()[asked.t]
            mine = held >= 0
            used, t = np.unique(held[mine], return_inverse=True)
            weights = np.zeros((len(used), len(asked.questions)))
            weights[t, asked.q[mine]] = asked.w[mine]
            slot = np.full(len(words), -1)
            slot[used] = np.arange(len(used))
            mine = slot[code] >= 0
            reaches = np.zeros((len(used), len(head)))
            reaches[slot[code[mine]], at[mine]] = most[mine]
            reach = weights.T @ reaches
            best, kth = asked.best, asked.kth
            for b in np.argsort(-reach.max(axis=0, initial=0.0), kind="stable").tolist():
                wanted = np.flatnonzero((reach[:, b] > 0) & (reach[:, b] * (1 + 1e-9) + 1e-6 >= kth))
                if not len(wanted):
                    continue
                if read is not None:
                    read.extend((asked.questions[j].as_py(), b) for j in wanted.tolist())
                sums = sums_of(b, slot, weights[:, wanted])
                rounded = np.round(sums, 6)
                good = (sums > 0) & (rounded >= kth[wanted])
                if b in alive:
                    good &= alive[b][:, None]
                for x in np.flatnonzero(good.any(axis=0)).tolist():
                    j, rows_ = wanted[x], np.flatnonzero(good[:, x])
                    scores = rounded[rows_, x]
                    if len(rows_) > k:  # ties with the k-th stay
                        keep = scores >= np.partition(scores, len(rows_) - k)[len(rows_) - k]
                        rows_, scores = rows_[keep], scores[keep]
                    best[j] = sorted([*best[j], *zip((-scores).tolist(), names.take(pa.array(first[b] + rows_)).to_pylist(), strict=True)])[:k]
                    if len(best[j]) == k:
                        kth[j] = -best[j][-1][0]

    return meet


def passing(k: int, avgdl: float, part_postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a task of a search, questions first, then blocks one after the other: whole blocks of about part_postings postings meet the questions at a time."""
    meet = meeting(k, avgdl)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions: list[Asked] = []
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            asked = batch.column("_block").is_valid()
            questions += [Asked(weights.values) for weights in batch.column("_block").filter(asked)]
            batch = batch.filter(pc.invert(asked)).drop_columns(["_block", "_part"])
            waiting.append(batch)
            held += pc.sum(pc.list_value_length(batch.column("pos"))).as_py() or 0
            last = np.flatnonzero(pc.equal(batch.column("term"), "").to_numpy(zero_copy_only=False))
            if held >= part_postings and len(last):  # all before the last names are whole blocks
                waiting[-1] = batch.slice(0, last[-1])
                meet(pa.Table.from_batches(waiting), questions)
                waiting = [batch.slice(last[-1])]
                held = pc.sum(pc.list_value_length(waiting[0].column("pos"))).as_py() or 0
        if waiting:
            meet(pa.Table.from_batches(waiting), questions)
        yield from (asked.found() for asked in questions)

    return go


#: The columns of blocks that meet questions.
ROWS = pa.schema([("batch", pa.int64()), ("block", pa.int64()), ("term", pa.string()), ("max_tf", pa.int32()), ("min_dl", pa.int64()), ("pos", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.string())), ("dls", pa.list_(pa.int64())), ("dead", pa.list_(pa.string()))])


def best_of(k: int, avgdl: float, read: list | None = None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The same for blocks in one frame, and rows of weights (_block) in another."""
    meet = meeting(k, avgdl, read)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        questions = [Asked(pa.array([dict(x) for x in block])) for block in right["_block"]]
        meet(pa.Table.from_pandas(left, ROWS, preserve_index=False), questions)
        return pd.concat([asked.found().to_pandas() for asked in questions])

    return score
