"""Mixing sources to target weights: a splitting tree deals exact quotas of source blocks to output shards.

Blocks: a keyed hash deals each source's documents to blocks of about `block_words` words, in a keyed order within
the block. A source's target is its weight's share of all words, at most `most` times its own size, the
excess shared anew by weight. The source's draws are all its blocks as often as the target allows, then blocks in
a keyed random order until the target is met; of the last one only the first documents are drawn, the one at the
border cut (or rounded to whole). So a source has an exact quota of draws, and its words meet its target.

Shards: the tree halves the shards again and again; at each node a multivariate hypergeometric draw tells how
many of each source's draws go left, as if all draws were shuffled and dealt. A keyed permutation of a source's
draws then hands each shard as many of them as its leaf says, so the shards' draws are disjoint, and what is taken
of a document is the sum over the shards that drew its block. Each shard is put into the order of a keyed hash.

The driver holds a number for each source and each block: blocks grow with the table where there would be more than
`max_blocks`, and there are `max_shards` shards at most, of about `shard_words` words where fewer do. Both small
tables are broadcast up to `broadcast_rows` rows, which fewer sources never pass; beyond, they are joined by shuffles.

A document with no words (null, empty) has size 0 and is taken 0 times. A null source is a source of its
own, the last. Repeated rows keep a row each; those of one id and text share a block, and in a block that is drawn in part
they are told apart by a row number. A very long text is a document like others: it can make a block larger.
An empty table gives an empty mix. Columns besides doc_id, text and source are not looked at, and pass unchanged where documents do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, id_of, text_of, whole_rows

SPACE = r"[\x09-\x0D\x20]+"


def size_of(text: Column) -> Column:
    """The number of words, runs of characters other than ASCII white space."""
    # a space at both ends: the split's first and last parts are empty
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), SPACE, -1)) - 2).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight, each at most `most` times its size; the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    for n, i in enumerate(order):
        if weights[i] * left / weight <= most * sizes[i]:
            for j in order[n:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = most * sizes[i]
        left, weight = left - most * sizes[i], weight - weights[i]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """How many of `wanted` draws without replacement are good.

    numpy's own draw takes fewer than 10**9 items. Beyond, the distribution is inverted over twelve standard
    deviations on both sides of the mean, outside of which a double has no weight left.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, wanted))
    every = good + bad
    mean = wanted * good / every
    reach = 12 * math.sqrt(mean * (bad / every) * ((every - wanted) / (every - 1))) + 12
    lo, hi = max(0, wanted - bad, math.floor(mean - reach)), min(wanted, good, math.ceil(mean + reach))
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (wanted - k)) - np.log((k + 1) * (bad - wanted + k + 1)))])
    heap = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(min(np.searchsorted(heap, rng.random() * heap[-1], "right"), hi - lo))


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, draws of each): the quotas dealt to shards of equal capacity, halving the shards at each node."""
    total = int(quotas.sum())
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(lo: int, hi: int, sources: np.ndarray, here: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi - lo == 1:
            yield lo, sources, here
            return
        middle = (lo + hi) // 2
        wanted, rest = total * middle // shards - total * lo // shards, int(here.sum())
        left = np.zeros_like(here)
        for i, n in enumerate(here.tolist()):
            if wanted:
                left[i] = hypergeometric(rng, n, rest - n, wanted)
            rest -= n
            wanted -= int(left[i])
        for a, b, part in ((lo, middle, left), (middle, hi, here - left)):
            some = part > 0
            yield from split(a, b, sources[some], part[some])

    if shards:
        yield from split(0, shards, np.arange(len(quotas)), quotas.astype(np.int64))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shard, source] draws."""
    out = np.zeros((shards, len(quotas)), np.int64)
    for shard, sources, draws in split_tree(quotas, shards, seed):
        out[shard, sources] = draws
    return out


class Mix(NamedTuple):
    """sources: _src, _sidx, _n_blocks, source_size, target. draws: _dsrc, _block, _draws (copy, shard, whole), and where a partial draw ends."""

    sources: DataFrame
    draws: DataFrame
    small: bool
    seed: int
    repeats: bool
    shards: int

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows (source, doc_id, _tie) with their source's and block's figures, and _at: the place in the block."""
        small = F.broadcast if self.small else lambda df: df  # `broadcast_rows` rows at most
        keyed = rows.join(small(self.sources), F.col("source").eqNullSafe(F.col("_src")))
        block = F.pmod(F.xxhash64(F.lit(self.seed), id_of(), "_tie"), F.col("_n_blocks"))
        keyed = keyed.withColumns({"_block": block, "_u": F.xxhash64(F.lit(self.seed + 1), id_of(), "_tie")})
        placed = keyed.join(small(self.draws), (F.col("_sidx") == F.col("_dsrc")) & (keyed["_block"] == self.draws["_block"]), "left").drop(self.draws["_block"])
        here, end = F.struct("_u", id_of().alias("_id"), "_tie"), F.struct(F.col("_end_u").alias("_u"), F.col("_end_id").alias("_id"), F.col("_end_tie").alias("_tie"))
        placed = placed.withColumn("_side", F.when(here < end, -1).when(here == end, 0).otherwise(1))
        if not self.repeats:
            return placed.withColumn("_turn", F.lit(0))
        # rows that repeat id and text at the end of a partial draw: they alone get a number
        turn = F.row_number().over(W.partitionBy("_sidx", "_block").orderBy("_u")) - 1
        return placed.where("_side <> 0").withColumn("_turn", F.lit(0)).unionByName(placed.where("_side = 0").withColumn("_turn", turn))


def streams(rows: DataFrame, seed: int, sources: list[tuple], blocks_of: list[int]) -> DataFrame:
    """_sidx, _block of each row (source, doc_id, size, _tie), by a hash of id and text; and _u, its order in the block."""
    table = rows.sparkSession.createDataFrame([(s, i, n) for i, (s, n) in enumerate(zip(sources, blocks_of, strict=True))], "_src string, _sidx int, _n_blocks long")
    keyed = rows.join(F.broadcast(table) if len(sources) <= BROADCAST_ROWS else table, F.col("source").eqNullSafe(F.col("_src")))
    return keyed.select("_sidx", F.pmod(F.xxhash64(F.lit(seed), id_of(), "_tie"), F.col("_n_blocks")).alias("_block"), F.xxhash64(F.lit(seed + 1), id_of(), "_tie").alias("_u"), id_of().alias("_id"), "_tie", "size")


#: Rows of the small tables that are broadcast at most; a row has about 150 bytes.
BROADCAST_ROWS = 300_000


def plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, shards: int | None = None, block_words: int = 65_536, seed: int = 7, max_sources: int | None = None, max_blocks: int = 200_000, shard_words: int = 2_000_000, max_shards: int = 16_384) -> Mix:
    """The draws of all blocks. sized: doc_id, source, size, _tie. With max_sources, more sources raise ValueError."""
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    if max_sources is not None and len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names, sizes = [r["source"] for r in totals], [int(r["n"]) for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    words = max(block_words, -(-sum(sizes) // max_blocks))
    counts = [max(1, -(-n // words)) for n in sizes]
    placed = streams(sized, seed, names, counts)
    found = placed.groupBy("_sidx", "_block").agg(F.sum("size").alias("n")).where("n > 0").orderBy("_sidx", "_block").collect()  # max_blocks rows and one a source at most
    blocks: list[list[tuple[int, int]]] = [[] for _ in names]
    for r in found:
        blocks[r["_sidx"]].append((int(r["_block"]), int(r["n"])))
    draws: list[list[tuple[int, int, bool]]] = []
    limits: list[tuple[int, int, int]] = []
    for i, (own, target, size) in enumerate(zip(blocks, wanted, sizes, strict=True)):
        full = int(target // size) if size else 0
        rest = math.floor(target - full * size + 0.5)
        mine = [(block, copy, True) for copy in range(full) for block, _ in own]
        for k in np.random.Generator(np.random.PCG64([seed, i, 1])).permutation(len(own)).tolist() if rest else []:
            block, n = own[k]
            mine.append((block, full, n <= rest))
            if n > rest:
                limits.append((i, block, rest))
            rest -= min(n, rest)
            if not rest:
                break
        draws.append(mine)
    quotas = np.array([len(d) for d in draws], np.int64)
    shards = shards or min(max_shards, max(16, -(-sum(sizes) // shard_words)))
    shard_of: list[list[np.ndarray]] = [[] for _ in names]
    for shard, at, dealt in split_tree(quotas, shards, seed):
        for i, n in zip(at.tolist(), dealt.tolist(), strict=True):
            shard_of[i].append(np.full(n, shard, np.int64))
    ends = {(r["_sidx"], r["_block"]): r for r in partial_ends(placed, limits)}
    rows = []
    for i, mine in enumerate(draws):
        by_block: dict[int, list[tuple[int, int, bool]]] = {}
        order = np.random.Generator(np.random.PCG64([seed, i, 2])).permutation(len(mine))
        dealt = np.concatenate(shard_of[i])[np.argsort(order)].tolist() if mine else []
        for (block, copy, whole), shard in zip(mine, dealt, strict=True):
            by_block.setdefault(block, []).append((copy, shard, whole))
        for block, some in by_block.items():
            end = ends.get((i, block))
            rows.append((i, block, some, *((end["_u"], end["_id"], end["_tie"], end["whole"], end["part"]) if end else (None,) * 5)))
    spark = sized.sparkSession
    table = spark.createDataFrame([(s, i, c, n, t) for i, (s, c, n, t) in enumerate(zip(names, counts, sizes, wanted, strict=True))], "_src string, _sidx int, _n_blocks long, source_size long, target double")
    drawn = spark.createDataFrame(rows, "_dsrc int, _block long, _draws array<struct<copy:int,shard:int,whole:boolean>>, _end_u long, _end_id long, _end_tie long, _end_whole long, _end_part long")
    return Mix(table, drawn, len(names) + len(rows) <= BROADCAST_ROWS, seed, any(r["n"] > 1 for r in ends.values()), shards)


def partial_ends(placed: DataFrame, limits: list[tuple[int, int, int]]) -> list:
    """For each block that is drawn in part the document where its words end: how many repeats of it are whole, and the words of the next."""
    if not limits:
        return []
    table = placed.sparkSession.createDataFrame(limits, "_lsrc int, _lblock long, _limit long")  # a row a source at most
    mine = placed.join(F.broadcast(table) if len(limits) <= BROADCAST_ROWS else table, (F.col("_sidx") == F.col("_lsrc")) & (F.col("_block") == F.col("_lblock"))).where("size > 0")
    once = mine.groupBy("_sidx", "_block", "_limit", "_u", "_id", "_tie", "size").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(W.partitionBy("_sidx", "_block").orderBy("_u", "_id", "_tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = once.withColumn("_left", F.col("_limit") - before).where((F.col("_left") > 0) & (F.col("_left") <= F.col("size") * F.col("n")))
    return left.select("_sidx", "_block", "_u", "_id", "_tie", "n", F.floor(F.col("_left") / F.col("size")).alias("whole"), (F.col("_left") % F.col("size")).alias("part")).collect()


def words_of_part(size: Column) -> Column:
    """The words of a document in a partial draw: all before its end, at its end the repeats that are whole and a part of the next."""
    at_end = F.when(F.col("_turn") < F.col("_end_whole"), size).when(F.col("_turn") == F.col("_end_whole"), F.col("_end_part")).otherwise(F.lit(0))
    return F.when(F.col("_side") < 0, size).when(F.col("_side") == 0, at_end).otherwise(F.lit(0)).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    return checkpoint(docs.select("doc_id", "source", size_of(text_of()).alias("size"), F.xxhash64(text_of()).alias("_tie")))


def with_draws(rows: DataFrame, made: Mix) -> DataFrame:
    """rows (doc_id, source, size, _tie) with _taken: array of (copy, shard, words), a draw each."""
    part = words_of_part(F.col("size"))
    taken = F.transform("_draws", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.when(d["whole"], F.col("size")).otherwise(part).alias("words")))
    return made.joined(rows).withColumn("_taken", F.filter(F.coalesce(taken, F.array().cast("array<struct<copy:int,shard:int,words:bigint>>")), lambda d: d["words"] > 0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The draws: a row for each document and time it is taken, with shard, slot and words; documents never taken have one row with words 0.

    Columns: doc_id, _bucket (its block), _rn (its place there), source, size, source_size, target, copy (from 0), words, shard, slot (the
    order within the shard). Weights go to the sources in code point order, null last, and repeat.
    """
    sized = sized_rows(docs)
    made = plan(sized, **options)
    rows = with_draws(sized, made).select("doc_id", F.col("_block").alias("_bucket"), F.col("_u").alias("_rn"), "source", "size", "source_size", "target", "_tie", F.explode_outer("_taken").alias("_t"))
    slot = F.when(F.col("_t").isNotNull(), F.xxhash64(F.lit(made.seed + 2), id_of(), "_tie", "_t.copy"))
    return rows.select("doc_id", "_bucket", "_rn", "source", "size", "source_size", "target", "_t.copy", F.coalesce("_t.words", F.lit(0)).cast("long").alias("words"), "_t.shard", slot.alias("slot"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document with its size, its source's size and target, the words taken, and the shards that take them."""
    sized = sized_rows(docs)
    rows = with_draws(sized, plan(sized, **options))
    taken = F.aggregate("_taken", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("_taken", lambda d: d["shard"]))), ",")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("_taken").cast("long").alias("n_draws"), shards.alias("shards"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, each row as often as the mix takes its document, which stays whole; shard by shard, each in its keyed order.

    A shard is in one partition, and so in one file where the result is written.
    """
    made = plan(sized_rows(docs), **options)
    rows = whole_rows(docs).select("_doc", F.col("_doc.source").alias("source"), F.col("_doc.doc_id").alias("doc_id"), F.xxhash64(text_of("_doc.text")).alias("_tie"), text_of("_doc.text").rlike(r"[^\x09-\x0D\x20]").alias("_said"))
    at_end = (F.col("_turn") < F.col("_end_whole")) | ((F.col("_turn") == F.col("_end_whole")) & (F.col("_end_part") * 2 >= size_of(text_of("_doc.text"))))
    part = (F.col("_side") < 0) | ((F.col("_side") == 0) & at_end)
    taken = made.joined(rows.where("_said")).withColumn("_d", F.explode(F.filter("_draws", lambda d: d["whole"] | part)))
    slot = F.xxhash64(F.lit(made.seed + 2), id_of(), "_tie", "_d.copy")
    return taken.select("_doc", F.col("_d.shard").alias("_shard"), slot.alias("_slot")).repartition("_shard").sortWithinPartitions("_shard", "_slot").select("_doc.*")
