"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets decide.

Words stand between white space, in lower case; a shingle is a run of five (a shorter text has one of all
its words). Documents whose shingle sets are equal form a class first, and one set stands for it. Bands and
rows are chosen for a target recall at the threshold. Documents that share a band hash are candidates; the
components of the candidate graph are compared within, block by block, on their full sets, so each link
between two different sets is found wherever the bands put them into one component. Blocks are bounded by sets and by
shingles, so many very long texts are many blocks. A similarity equal to the threshold is a link.

Texts without words (null, empty, white space) have the empty set: they are one class, linked to each other.
Rows that repeat both id and text are one document for the search; each row gets its class.
An empty table has no classes. Columns besides doc_id and text are not looked at by the search, and pass unchanged where rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, hashed_words, id_of, in_chunks, mixed, shingles, text_of, whole_rows, with_row_key
from .graph import components

#: Sets in a block, and shingles in it, about; a task compares two blocks at most. A longer set is a block with few others.
BLOCK, BLOCK_SHINGLES = 256, 400_000


def band_plan(threshold: float = 0.8, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest false candidates, that reach the recall at the threshold with at most so many hashes."""
    plans = []
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= most:
            plans.append((bands, rows))
    return plans[-1]


def signature(sets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 4096):
        part = sets[i : i + 4096, None] * seeds[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def hash_seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(_id, _th, set_key, n_shingles, bands): set_key is a 128-bit hash of the shingle set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = hash_seeds(bands * rows)
        weights = hash_seeds(rows + 1)[1:]
        for pdf in batches:
            texts = [t.lower() for t in pdf["text"]]
            keys, counts, band_hashes = [], [], []
            for lo, hi in in_chunks(texts):
                words, offsets = hashed_words(texts[lo:hi])
                for i in range(hi - lo):
                    s = shingles(words[offsets[i] : offsets[i + 1]], shingle)
                    keys.append(xxhash.xxh128_digest(s.tobytes()))
                    counts.append(len(s))
                    if len(s):
                        m = mixed(signature(s, seeds)).reshape(bands, rows)
                        band_hashes.append(mixed((m * weights).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                    else:
                        band_hashes.append(np.zeros(0, np.int64))
            yield pd.DataFrame({"_id": pdf["_id"], "_th": pdf["_th"], "set_key": keys, "n_shingles": counts, "bands": band_hashes})

    return with_row_key(docs).mapInPandas(sign, "_id long, _th long, set_key binary, n_shingles long, bands array<long>")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b): enough edges for the components of sets that share a bucket, and no square of a bucket.

    A bucket's leader is its first set. A set is linked to the least of its leaders, and that one to the others:
    sets of one group have few pairs of leaders between them, so most of these repeat and go.
    """
    rows = sets.select("set_key", F.explode("bands").alias("band"))
    leaders = rows.groupBy("band").agg(F.min("set_key").alias("leader"), F.max("set_key").alias("_last")).where("leader < _last")
    # a second key of the join, so that both sides are dealt again and skewed bands can be split
    again = lambda df: df.withColumn("_k", F.col("band").bitwiseXOR(F.lit(0x5DEECE66D)))
    led = again(rows).join(again(leaders.select("band", "leader")), ["band", "_k"]).groupBy("set_key").agg(F.collect_set("leader").alias("leaders"))
    linked = led.select(F.array_min("leaders").alias("a"), F.explode(F.array_union("leaders", F.array("set_key"))).alias("b"))
    return linked.where("a <> b").distinct()


def links_within(sizes: list[int], sets: list[np.ndarray], left: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets at least so similar; unless left is None only pairs across the first `left` sets and the rest."""
    n = len(sets)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.zeros((n, n), np.float32)
    shared = np.bincount(codes, minlength=len(values)) > 1
    keep = shared[codes]
    codes, owner = (np.cumsum(shared) - 1)[codes[keep]], owner[keep]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = max(256, 4_000_000 // max(n, 1))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(codes, (lo, lo + width))
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], codes[a:b] - lo] = 1
        common += block @ block.T
    size = np.asarray(sizes, np.float64)
    common = common.astype(np.float64)
    union = size[:, None] + size[None, :] - common
    hit = np.triu(common >= threshold * union - 1e-9, 1)
    if left is not None:
        hit[:left, :left] = False
        hit[left:, left:] = False
    return np.nonzero(hit)


def compare_block(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the sets of a block, or between those of two blocks: for each set the copies it links to, and its group."""
        cross = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        pdf = pdf.drop_duplicates("set_key").sort_values(["block", "set_key"], kind="stable").reset_index(drop=True)
        sets = [np.asarray(s).view(np.uint64) for s in pdf["shingles"]]
        left = int((pdf["block"] == pdf["lo"]).sum()) if cross else None
        i, j = links_within([len(s) for s in sets], sets, left, threshold)
        copies = pdf["n_copies"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = list(range(len(pdf)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        keys = pdf["set_key"].tolist()
        return pd.DataFrame({"set_key": keys, "links": links, "root": [keys[find(x)] for x in range(len(keys))]})

    return compare


def near_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9999) -> DataFrame:
    """(_id, _th, class_id, class_th, n_links) for each row of docs.

    _id is the doc_id (NO_ID for null). class_id and class_th are the key of the first document of the class, the
    smallest by id, nulls first, then text hash; n_links counts the other documents at least so similar, copies included.
    """
    bands, rows = band_plan(threshold, recall)
    signed = checkpoint(signatures(docs, shingle, bands, rows))
    first = F.min(F.struct(F.col("_id").alias("i"), F.col("_th").alias("t")))
    sets = checkpoint(signed.groupBy("set_key").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    comps = components(candidate_edges(sets))
    held = comps.join(sets.withColumnRenamed("set_key", "node"), "node")
    sizes = held.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    again = lambda df: df.withColumn("_k", F.xxhash64("component"))  # noqa: E731  a second key, so that both sides are dealt anew and a large component can be split
    members = again(held).join(again(sizes), ["component", "_k"])
    members = members.select(F.col("node").alias("set_key"), "component", "n_blocks", "n_copies", "first.i", "first.t")
    texts = with_row_key(docs).select(F.col("_id").alias("i"), F.col("_th").alias("t"), "text")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.lower() for t in pdf["text"]]
            out = []
            for lo, hi in in_chunks(texts):
                words, offsets = hashed_words(texts[lo:hi])
                out += [shingles(words[offsets[i] : offsets[i + 1]], shingle).view(np.int64) for i in range(hi - lo)]
            yield pdf.drop(columns="text").assign(shingles=out)

    columns = ["set_key", "component", "n_blocks", "n_copies"]
    chosen = texts.join(members, ["i", "t"]).select(*columns, "text")
    full = chosen.mapInPandas(expand, "set_key binary, component binary, n_blocks int, n_copies long, shingles array<long>")
    own = F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int")
    spread = full.withColumn("block", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    spread = spread.withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")})
    compared = checkpoint(spread.select("component", "lo", "hi", "block", "set_key", "n_copies", "shingles").groupBy("component", "lo", "hi").applyInPandas(compare_block(threshold), "set_key binary, links long, root binary"))
    linked = components(compared.where("set_key <> root").select(F.col("root").alias("a"), F.col("set_key").alias("b")))
    counts = compared.groupBy("set_key").agg(F.sum("links").alias("links"))
    of_set = sets.select("set_key", "first", "n_copies").join(counts, "set_key", "left").join(linked.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    heads = of_set.groupBy("component").agg(F.min("first").alias("head"))
    of_set = of_set.join(heads, "component").select(
        "set_key", F.substring("set_key", 1, 4).alias("_k"), F.col("head.i").alias("class_id"), F.col("head.t").alias("class_th"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    return signed.select("_id", "_th", "set_key", F.substring("set_key", 1, 4).alias("_k")).join(of_set, ["set_key", "_k"]).select("_id", "_th", "class_id", "class_th", "n_links")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that are the first of their class; of rows that repeat id and text one stays."""
    heads = near_classes(docs, **options).select(F.col("class_id").alias("_hid"), F.col("class_th").alias("_hth")).distinct()
    keyed = whole_rows(docs).withColumns({"_id": id_of("_doc.doc_id"), "_th": F.xxhash64(text_of("_doc.text"))})
    kept = keyed.join(heads, (F.col("_id") == F.col("_hid")) & (F.col("_th") == F.col("_hth")), "left_semi")
    one = F.row_number().over(W.partitionBy("_id", "_th").orderBy("_th"))
    return kept.withColumn("_n", one).where("_n = 1").select("_doc.*")
