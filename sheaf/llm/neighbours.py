"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, the shards' results merged.

Copies: rows of equal vectors are one point of the index, with the smallest of their ids (as many as an answer can name), so a
third of all rows may be one vector. Equal vectors that are asked are searched once.

Index: points are dealt to shards of a bounded size by the hash of their vector; each shard's graph is built in a task
of its own and stored as one row: vectors, ids and flat neighbour arrays. Every row of the table is in it.

Search: the vectors asked are stored as blocks; each block meets each shard in a task of its own, whose best are merged by
Spark. Neither side passes through the driver, and a task holds one shard and one block. Asking a fixed part of all rows
against all rows takes time with the square of the table, which is in the question; a shard takes its part of it
with the logarithm of its size.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different dimension are not
compared. Rows that repeat both id and vector count once; a row is not its own neighbour, nor are other rows with its id. A row
without an id can be found (its id is null, and comes first among equals) but does not ask. An empty table
gives an empty result; columns besides the two are not looked at. Texts play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import written
from . import hnsw
from .common import NO_ID, id_again, id_of

#: Points of a shard, and vectors of a block, at most about.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Points that a search of a shard keeps; more than are wanted.
WIDTH = 128

INDEX = "dim int, shard int, vectors binary, ids binary, offsets binary, sizes array<int>, links binary"


def valid(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """_id, _v (doubles), _h and _g (two hashes of it) of the vectors that take part, equal rows once."""
    v = F.transform(vector_column, lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(id_of(id_column).alias("_id"), v.alias("_v")).where(F.coalesce(fine, F.lit(False)))
    return rows.withColumns({"_h": F.xxhash64("_v"), "_g": F.xxhash64(F.lit(1), F.reverse("_v"))})


def least_ids(rows: DataFrame, most: int) -> DataFrame:
    """_h, _g, ids: the smallest ids of each vector, `most` at most (no answer names more)."""
    order = W.partitionBy("_h", "_g").orderBy("_id")
    few = rows.select("_h", "_g", "_id").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return few.groupBy("_h", "_g").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


def points(rows: DataFrame, most: int) -> DataFrame:
    """_h, _g, _v, ids: each different vector once."""
    vectors = rows.groupBy("_h", "_g").agg(F.first("_v").alias("_v"))
    return written(vectors.join(least_ids(rows, most), ["_h", "_g"]), "points")


def build_index(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row of INDEX for each shard, written to the scratch folder."""
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.select("_h", "_v", "ids", F.size("_v").alias("dim"), F.pmod(F.col("_h"), F.lit(shards)).cast("int").alias("shard"))

    def built(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_h", kind="stable")  # by a hash, so in random order
        v = np.stack(part["_v"].to_numpy()).astype(np.float64)
        graph = hnsw.build(v, seed=int(part["shard"].iloc[0]) + 1)
        ids = [np.asarray(x, np.int64) for x in part["ids"]]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        return pd.DataFrame({
            "dim": [v.shape[1]], "shard": part["shard"].iloc[:1].array, "vectors": [v.tobytes()], "ids": [np.concatenate(ids).tobytes()], "offsets": [offsets.tobytes()],
            "sizes": [[len(x) for x in graph.levels]], "links": [b"".join(x.tobytes() for x in graph.levels)],
        })

    # a shard is little data and much work: a partition for each, by its own number
    return written(dealt.repartitionById(shards, F.col("shard")).groupBy("dim", "shard").applyInPandas(built, INDEX), "hnsw")


def stored(row: pd.Series) -> tuple[hnsw.Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, vectors, ids and offsets of an index row."""
    v = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    links, levels, at = np.frombuffer(row["links"], np.int32), [], 0
    for level, n in enumerate(row["sizes"]):
        room = hnsw.M * (1 + (level == 0))
        levels.append(links[at : at + n * room].reshape(n, room))
        at += n * room
    return hnsw.Graph(hnsw.scaled(v), levels), v, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors have equal ones, wherever they stand."""
    return (v * q).sum(axis=-1)


def searcher(most: int, width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The `most` best rows of a shard for each vector of a block, by exact products."""

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asked):
            graph, v, ids, offsets = stored(index.iloc[0])
            for block in asked["_block"]:
                q = np.stack([x["_v"] for x in block]).astype(np.float64)
                at, _ = graph.search(q, max(width, most))
                for x, mine, vector in zip(block, at, q, strict=True):
                    mine = mine[mine >= 0]
                    score = products(v[mine], vector)
                    each = np.repeat(np.arange(len(mine)), offsets[mine + 1] - offsets[mine])
                    who = np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in mine])
                    best = np.lexsort((who, -score[each]))[:most]
                    out.append((x["_h"], x["_g"], who[best].tolist(), score[each][best].tolist()))
        return pd.DataFrame(out, columns=["_h", "_g", "ids", "scores"])

    return search


def nearest(index: DataFrame, asked: DataFrame, most: int, width: int = WIDTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """_h, _g, found (array of score, minus_id; best first) for each vector asked (_h, _g, _v): its `most` best rows over all shards."""
    blocks = max(1, -(-asked.count() // block_rows))
    dealt = asked.withColumns({"_b": F.pmod("_g", F.lit(blocks)).cast("int"), "dim": F.size("_v")})
    held = written(dealt.groupBy("dim", "_b").agg(F.collect_list(F.struct("_h", "_g", "_v")).alias("_block")), "asked")
    tasks = index.select("dim", "shard").distinct().join(held.select("dim", "_b").distinct(), "dim")  # numbers of shards and blocks, no rows
    key = ["dim", "shard", "_b"]
    left, right = tasks.join(index, ["dim", "shard"]), tasks.toDF(*key).join(held, ["dim", "_b"])  # (other names of the same columns)
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(searcher(most, width), "_h long, _g long, ids array<long>, scores array<double>")
    each = found.select("_h", "_g", F.explode(F.arrays_zip("scores", "ids")).alias("_x")).select("_h", "_g", F.col("_x.scores").alias("score"), F.col("_x.ids").alias("_id"))
    order = W.partitionBy("_h", "_g").orderBy(F.desc("score"), "_id")
    top = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return top.groupBy("_h", "_g").agg(F.sort_array(F.collect_list(F.struct("_r", "score", "_id"))).alias("found"))


def search(vectors: DataFrame, asks: Callable[[Column], Column], k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id `asks` says yes to, nearest first, ties by id."""
    rows = valid(vectors, id_column, vector_column)
    index_rows = points(rows, k + 1)
    index = build_index(index_rows)
    queries = written(rows.where((F.col("_id") != NO_ID) & asks(F.col("_id"))).select("_id", "_h", "_g").distinct(), "queries")
    asked = index_rows.select("_h", "_g", "_v").join(queries.select("_h", "_g").distinct(), ["_h", "_g"], "left_semi")
    best = nearest(index, asked, k + 1, width)
    both = queries.withColumnRenamed("_id", "query_id").join(best, ["_h", "_g"])
    others = F.slice(F.filter("found", lambda x: x["_id"] != F.col("query_id")), 1, k)
    each = both.select("query_id", F.posexplode(others).alias("_p", "_x"))
    return each.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), id_again("_x._id").alias("vec_id"), F.col("_x.score").alias("score"))


def neighbour_report(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return search(vectors, lambda i: i % 20 == 0)


def recall(vectors: DataFrame, found: DataFrame, k: int = 20) -> DataFrame:
    """One row: n_queries, and the recall of `found` against all rows. Each vector is compared with all queries; for measuring, not for search."""
    from ..operators.vectors import knn

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asks = vectors.join(found.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    true = knn(rows, asks, k + 1, metric="ip").where(F.col("id") != F.col("query_id").cast("string"))
    last = true.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= k).groupBy("query_id").agg(F.max("distance").alias("_limit"), F.count(F.lit(1)).alias("_n"))
    hits = found.join(last, "query_id").where(F.round(1 - F.col("score"), 6) <= F.col("_limit")).groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.max("_n")).alias("_hits"))
    return last.join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), (F.sum(F.coalesce("_hits", F.lit(0))) / F.sum("_n")).alias("recall"))
