"""Line dedup: find overlapping documents by rare line hashes they share, align each pair, delete the common blocks.

A block is a run of non-blank lines, of at least `min_words` words, that stands in the same order and without other
lines between in an earlier document (by doc_id, nulls first, then text hash). Wherever it stands in either, and
however often, the later document loses it; so the first document that holds a block keeps it.

Rare lines: a short line ("Yes", a brace) says nothing about where a text comes from, so a line alone is a seed only
if it has `min_words` words; shorter ones are hashed with those that follow, or that precede, until they have. Such
seeds depend on their own lines only. Two documents that share a block share all seeds in it, and these cover it:
from the left those that end as soon as they can, from the right those that start as late as they can. A line
has two seeds at most.

Pairs: a seed that at most `rare` documents hold pairs each later of these with the first one. That is a row a seed and
holder, never the square of its holders.

Alignment: a pair is aligned by patience diff. Seeds that stand once in both documents are anchors; patience sorting takes the
longest run of them that stands in one order in both, and each gap between them is aligned by itself, its seeds counted
anew; a gap without anchors is followed from its edges. Aligned seeds on one diagonal join to blocks, which the later document loses.

Crossed and frequent blocks: what alignment leaves of a pair's seeds are blocks that the diff crosses (moved, or repeated within
a document), and seeds that more than `rare` documents hold are not worth a pair. A second pass, `crossed`, deletes these
as well, each because the first document that holds it is an earlier one; without it they stay. With it every seed of every
common block goes, so no block is lost, whichever documents share it. The blocks say by which way they went.

Null and empty texts have no lines and stay. Rows that repeat both id and text are one document: neither is
later than the other, and both lose the same lines. Lines are compared without white space at their ends. Very long
texts are handled line by line; a task holds the seeds of one document at a time. An empty table stays empty; other columns
pass unchanged, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, text_of, whole_rows, with_row_key

BLOCKS = "array<struct<start:int,lines:int,other_id:long,other_th:long,other_start:int,moved:boolean,frequent:boolean>>"
#: Documents that hold a rare line, at most.
RARE = 100


class Block(NamedTuple):
    """Lines start to start + lines of the later document (blank ones not counted), and where they stand in the other."""

    start: int
    lines: int
    other_start: int
    moved: bool


def seeds_of(text: str, min_words: int) -> dict[bytes, tuple[int, list[int]]]:
    """For the key of each seed how many lines it has and where it stands, blank lines not counted."""
    found = [line for line in map(str.strip, text.split("\n")) if line]
    if not found:
        return {}
    digests = [md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in found]
    words = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x.split()) for x in found], out=words[1:])
    places, least = np.arange(len(found) + 1), max(min_words, 1)
    ends = np.searchsorted(words, words[:-1] + least, "left")
    starts = np.searchsorted(words, words[1:] - least, "right") - 1
    spans = {*zip(places[:-1].tolist(), ends.tolist(), strict=True), *zip(starts.tolist(), places[1:].tolist(), strict=True)}
    out: dict[bytes, tuple[int, list[int]]] = {}
    for lo, hi in sorted(spans):
        if lo >= 0 and hi <= len(found):
            key = digests[lo] if hi - lo == 1 else md5(b"".join(digests[lo:hi]), usedforsecurity=False).digest()
            out.setdefault(key, (hi - lo, []))[1].append(lo)
    return out


def seed_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, key, lines, at) for each different seed of a document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                found = [seeds_of(t, min_words) for t in part["text"]]
                counts = [len(f) for f in found]
                yield pd.DataFrame({
                    "_id": part["_id"].repeat(counts).array, "_th": np.repeat(part["_th"].to_numpy(), counts), "key": [k for f in found for k in f],
                    "lines": [n for f in found for n, _ in f.values()], "at": [a for f in found for _, a in f.values()],
                })

    return with_row_key(docs).mapInPandas(rows, "_id long, _th long, key binary, lines int, at array<int>")


def longest_run(values: list[int]) -> list[int]:
    """Places of a longest increasing run, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = top_at[k - 1] if k else -1
        tops[k : k + 1], top_at[k : k + 1] = [v], [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def joined(found: list[tuple[int, int, int]]) -> list[list[int]]:
    """(start, lines, start in the other document), those on one diagonal that touch or overlap as one."""
    merged: list[list[int]] = []
    for start, lines, other in sorted(set(found), key=lambda s: (s[2] - s[0], s[0], s[1])):
        last = merged[-1] if merged else None
        if last and other - start == last[2] - last[0] and start <= last[0] + last[1]:
            last[1] = max(last[1], start + lines - last[0])
        else:
            merged.append([start, lines, other])
    return merged


def patience(seeds: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Seeds (lines, places, places in the other document) that stand in one order in both: (start, lines, other)."""
    out: list[tuple[int, int, int]] = []
    ends = lambda side: (min(min(x[side]) for x in seeds), max(x[0] + max(x[side]) for x in seeds))
    todo = [(*ends(1), *ends(2), seeds)] if seeds else []
    while todo:
        low, high, other_low, other_high, mine = todo.pop()
        inside = [(n, [x for x in a if low <= x <= high - n], [x for x in b if other_low <= x <= other_high - n]) for n, a, b in mine]
        inside = [x for x in inside if x[1] and x[2]]
        once = sorted({(a[0], b[0], -n) for n, a, b in inside if len(a) == len(b) == 1})
        once = [x for i, x in enumerate(once) if not i or x[:2] != once[i - 1][:2]]
        anchors: list[tuple[int, int, int]] = []
        for start, other, minus in [once[i] for i in longest_run([b for _, b, _ in once])]:
            last = anchors[-1] if anchors else (0, 0, 0)
            if other - start == last[2] - last[0] or (start >= last[0] + last[1] and other >= last[2] + last[1]):
                anchors.append((start, -minus, other))
        out += anchors
        rest = [x for x in inside if len(x[1]) > 1 or len(x[2]) > 1]
        if rest and not anchors:  # what goes on from the gap's edges, on their diagonals
            by_place = sorted(((x, n, b) for n, a, others in rest for b in [set(others)] for x in a), key=lambda p: p[:2])
            new_low, new_high = low, high
            for x, n, b in by_place:
                if x <= new_low < x + n and x + other_low - low in b:
                    out.append((x, n, x + other_low - low))
                    new_low = x + n
            for x, n, b in reversed(by_place):
                if x >= new_low and x < new_high <= x + n and x + other_high - high in b and x + other_high - high >= other_low + new_low - low:
                    out.append((x, n, x + other_high - high))
                    new_high = x
            if (new_low, new_high) != (low, high):
                todo.append((new_low, new_high, other_low + new_low - low, other_high + new_high - high, rest))
        elif anchors and rest:
            starts, others = [x[0] for x in anchors], [x[2] for x in anchors]
            gaps: dict[int, list[tuple[int, list[int], list[int]]]] = {}
            for n, a, b in rest:
                by_gap: dict[int, tuple[list[int], list[int]]] = {}
                for side, places, marks in ((0, a, starts), (1, b, others)):
                    for x in places:
                        by_gap.setdefault(bisect_left(marks, x), ([], []))[side].append(x)
                for gap, (x, y) in by_gap.items():
                    if x and y:
                        gaps.setdefault(gap, []).append((n, x, y))
            for gap, found in gaps.items():
                before = anchors[gap - 1] if gap else (low, 0, other_low)
                after = anchors[gap] if gap < len(anchors) else (high, 0, other_high)
                todo.append((before[0] + before[1], after[0], before[2] + before[1], after[2], found))
    return out


def align(seeds: list[tuple[int, int, int]]) -> list[Block]:
    """The common blocks of a pair whose seeds (start, lines, start in the other document) stand once in both."""
    return aligned_blocks([(n, [a], [b]) for a, n, b in sorted(set(seeds))])


def aligned_blocks(seeds: list[tuple[int, list[int], list[int]]]) -> list[Block]:
    """The common blocks of a pair: those aligned, and as moved what is left of the seeds."""
    straight = joined(patience(seeds))
    covered = {i for start, lines, _ in straight for i in range(start, start + lines)}
    left = joined([(a, n, places[0]) for n, starts, places in seeds for a in starts if not covered.issuperset(range(a, a + n))])
    return sorted([Block(*b, False) for b in straight] + [Block(*b, True) for b in left], key=lambda b: (b.start, -b.other_start))


def shared_blocks(docs: DataFrame, min_words: int = 8, rare: int = RARE) -> DataFrame:
    """(_id, _th, blocks): for each document that shares blocks with earlier ones all of these, pair by pair, then the frequent ones."""
    seeds = seed_rows(docs, min_words)
    order = F.struct(F.col("_id").alias("i"), F.col("_th").alias("t"))
    first = F.min(F.struct(F.col("_id").alias("i"), F.col("_th").alias("t"), F.col("at")))
    firsts = seeds.groupBy("key").agg(first.alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_holders")).where("_first.i <> _last.i or _first.t <> _last.t")
    frequent = F.col("_holders") > rare
    firsts = firsts.select("key", "_first.i", "_first.t", F.when(frequent, F.slice("_first.at", 1, 1)).otherwise(F.col("_first.at")).alias("other_at"), frequent.alias("frequent"))
    again = lambda df: df.withColumn("_k", F.substring("key", 1, 4))  # noqa: E731  both sides are dealt again, so a frequent seed can be split
    pairs = again(seeds).join(again(firsts), ["key", "_k"]).where("_id <> i or _th <> t")
    held = pairs.groupBy("_id", "_th").agg(F.collect_list(F.struct("i", "t", "frequent", "lines", "at", "other_at")).alias("_s"))
    # flat arrays, not one for each seed: a task then holds numbers, and objects of a few documents only
    sizes = lambda name: F.transform("_s", lambda x: F.size(x[name])).alias(f"{name}_n")
    parts = [F.col(f"_s.{name}").alias(name) for name in ("i", "t", "frequent", "lines")]
    flat = held.select("_id", "_th", *parts, *[c for name in ("at", "other_at") for c in (sizes(name), F.flatten(F.col(f"_s.{name}")).alias(name))])

    def blocks_of(row: tuple) -> list[dict]:
        def lists(sizes: np.ndarray, flat: np.ndarray) -> list[list[int]]:
            ends = np.cumsum(sizes).tolist()
            values = flat.tolist()
            return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        by_pair: dict[tuple[bool, int, int], list[tuple[int, list[int], list[int]]]] = {}
        for i, t, often, lines, at, other in zip(row.i.tolist(), row.t.tolist(), row.frequent.tolist(), row.lines.tolist(), lists(row.at_n, row.at), lists(row.other_at_n, row.other_at), strict=True):
            by_pair.setdefault((often, i, t), []).append((lines, at, other))
        out = []
        for (often, i, t), mine in sorted(by_pair.items()):
            these = [Block(*b, True) for b in joined([(a, n, o[0]) for n, s, o in mine for a in s])] if often else aligned_blocks(mine)
            out += [{"start": b.start, "lines": b.lines, "other_id": i, "other_th": t, "other_start": b.other_start, "moved": b.moved, "frequent": often} for b in these]
        return out

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                some = pdf.iloc[lo : lo + 500]
                yield pd.DataFrame({"_id": some["_id"].array, "_th": some["_th"].array, "blocks": [blocks_of(row) for row in some.itertuples(index=False)]})

    return flat.mapInPandas(found, f"_id long, _th long, blocks {BLOCKS}")


def without_blocks(text: str, blocks: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the blocks (start, lines), and the lines and words deleted."""
    gone = {i for start, lines in blocks for i in range(start, start + lines)}
    kept, n, deleted, words = [], 0, 0, 0
    for line in text.split("\n"):
        size = len(line.split())
        if size and n in gone:
            deleted += 1
            words += size
        else:
            kept.append(line)
        n += size > 0
    return "\n".join(kept), deleted, words


def cut():
    @F.pandas_udf("text string, lines long, words long")
    def cut_blocks(text: pd.Series, starts: pd.Series, lines: pd.Series) -> pd.DataFrame:
        found = [without_blocks(t, list(zip(s.tolist(), n.tolist(), strict=True))) if s is not None else (t, 0, 0) for t, s, n in zip(text, starts, lines, strict=True)]
        return pd.DataFrame(found, columns=["text", "lines", "words"])

    return cut_blocks


def dedup_lines(docs: DataFrame, min_words: int = 8, rare: int = RARE, crossed: bool = True) -> DataFrame:
    """_doc with docs' columns, the text cut and n_chars (if there is one) counted anew; _lines, _words: how many were deleted; _blocks (null: none).

    crossed: whether blocks go that no alignment has in order, and frequent ones.

    A text that loses nothing is as it was, null included.
    """
    keyed = whole_rows(docs).withColumns({"_id": id_of("_doc.doc_id"), "_th": F.xxhash64(text_of("_doc.text"))})
    going = F.col("blocks") if crossed else F.filter("blocks", lambda b: ~b["moved"])
    found = shared_blocks(docs, min_words, rare).select(F.col("_id").alias("_aid"), F.col("_th").alias("_ath"), going.alias("_blocks")).where(F.size("_blocks") > 0)
    joined = keyed.join(found, (F.col("_id") == F.col("_aid")) & (F.col("_th") == F.col("_ath")), "left")
    after = cut()(text_of("_doc.text"), F.transform("_blocks", lambda b: b["start"]), F.transform("_blocks", lambda b: b["lines"]))
    done = joined.withColumn("_cut", F.when(F.col("_blocks").isNotNull(), after))
    done = done.withColumns({"_lines": F.coalesce("_cut.lines", F.lit(0)).cast("long"), "_words": F.coalesce("_cut.words", F.lit(0)).cast("long")})
    new = {"text": F.when(F.col("_lines") > 0, F.col("_cut.text")).otherwise(F.col("_doc.text")), "n_chars": F.when(F.col("_lines") > 0, F.length("_cut.text").cast("long")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    fields = [(new[c] if new.get(c) is not None else F.col("_doc").getField(c)).alias(c) for c in docs.columns]
    return done.select(F.struct(*fields).alias("_doc"), "_lines", "_words", "_blocks")
