"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (3 to 6 characters of the text in lower case) that a text holds, hashed to 2**20 places.
Over the training documents the presence counts of each class give a feature's log-count ratio r; the
`max_features` (8,000) features with the largest |r| x sqrt(count) are kept, of those that 4 training documents or more
hold, and a logistic regression learns weights on r times presence. Both numbers belong to the model, like its penalty: with
a few thousand labelled texts, more or rarer features fit the training texts only. A score is the model's probability; texts without a kept feature get the intercept's.

Training takes at most `max_train` (12,000) labelled documents, by a hash of doc_id, whose texts are written to the
checkpoint folder once; this is the documented bound of the labelled sample. Scoring reads every whole text, a very long one
in arrays of its code points. Null and empty texts have no features. Repeated labels count as toxic if any of them does.
Repeated rows keep a row each; of rows that repeat a labelled id the first text is learnt from. With no label, or labels
of one class only, all scores are that class's share, 0 without any. A score equal to the threshold is toxic; features
of equal gain are kept by their place.
An empty table gives an empty report. Columns besides doc_id and text (doc_id and toxic of labels) are not looked at, and pass unchanged where rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_of, whole_rows

BITS = 20
SIZES = (3, 4, 5, 6)
#: Training documents, kept features, and tasks that count features, at most; training documents that hold a kept feature, at least.
MAX_TRAIN, MAX_FEATURES, TASKS, MIN_DOCS = 12_000, 8_000, 12, 4


def ngram_places(codes: np.ndarray) -> np.ndarray:
    """Hashed places of all n-grams of an array of code points, one after another by size."""
    out = []
    wide = codes.astype(np.uint64)
    for n in SIZES:
        m = len(wide) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= wide[i : i + m]
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def features(text: str) -> np.ndarray:
    """The distinct places of a text's n-grams."""
    return np.unique(ngram_places(code_points(text))) if text else np.zeros(0, np.int32)


def is_training(doc_id: str = "doc_id"):
    """Whether a label may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def training_set(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, label) of at most max_train labelled documents; a bounded set of ids is sent to the texts."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("_lid"), "toxic").where("_lid is not null and toxic is not null").where(is_training("_lid"))
        .groupBy("_lid").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("_lid", F.lit(11)), "_lid").limit(max_train)
    )
    joined = docs.select(F.col("doc_id").cast("long").alias("_lid"), text_of().alias("text")).join(F.broadcast(ids), "_lid")
    one = joined.groupBy("_lid", "label").agg(F.min("text").alias("text"))
    return checkpoint(one.select("text", F.col("label").cast("int").alias("label")).repartition(TASKS))


def ratios(train: DataFrame, max_features: int, min_docs: int = MIN_DOCS, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(places, r) of the features kept. A task sends a count for each place; the driver gets max_features rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        docs = np.zeros(2, np.int64)
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                counts[int(label > 0)][features(text)] += 1
                docs[int(label > 0)] += 1
        at = np.nonzero(counts.sum(axis=0) > 0)[0]
        yield pd.DataFrame({"place": np.append(at, -1), "clean": np.append(counts[0][at], docs[0]), "toxic": np.append(counts[1][at], docs[1])})

    sums = train.mapInPandas(count, "place int, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = checkpoint(sums)
    total = sums.where("place = -1").first()
    if total is None or not total["clean"] or not total["toxic"]:
        share = 0.0 if total is None or not total["toxic"] else 1.0
        return np.zeros(0, np.int32), np.array([share])
    r = F.log((F.col("toxic") + smooth) / (total["toxic"] + 2 * smooth)) - F.log((F.col("clean") + smooth) / (total["clean"] + 2 * smooth))
    best = sums.where((F.col("place") >= 0) & (F.col("clean") + F.col("toxic") >= min_docs)).select("place", r.alias("r"), (F.abs(r) * F.sqrt(F.col("clean") + F.col("toxic"))).alias("gain"))
    rows = best.orderBy(F.desc(F.round("gain", 9)), "place").limit(max_features).collect()
    rows.sort(key=lambda x: x["place"])
    return np.array([x["place"] for x in rows], np.int32), np.array([x["r"] for x in rows])


def logistic(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, decay: float = 20.0, toxic_weight: float = 2.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights (r included) and intercept by full-batch Adam with an L2 penalty; a toxic document counts toxic_weight times."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = r[index]
    sample = np.where(y > 0, toxic_weight, 1.0)
    w, b = np.zeros(len(r)), math.log((toxic_weight * y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, value * w[index], len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * sample
        g = (np.bincount(index, value * e[owner], len(r)) + decay * w) / len(rows)
        gb = e.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.02 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.02 * (mb / a) / (math.sqrt(vb / c) + 1e-8)
    return w * r, b


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept)."""
    train = training_set(docs, labels, max_train)
    places, r = ratios(train, max_features, min_docs)
    if not len(places):
        share = float(r[0]) if len(r) else 0.0
        return places, np.zeros(0), 30.0 if share else -30.0

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = np.full(1 << BITS, -1, np.int32)
        where[places] = np.arange(len(places), dtype=np.int32)
        for pdf in batches:
            found = [where[features(t)] for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "at": [x[x >= 0] for x in found]})

    rows = train.mapInPandas(lookup, "label int, at array<int>").toPandas()  # max_train rows of at most max_features places
    order = rows["at"].map(lambda x: (len(x), tuple(x[:8]))).sort_values(kind="stable").index  # sums run in one order
    rows = rows.loc[order]
    weights, intercept = logistic([np.asarray(x, np.int64) for x in rows["at"]], r, (rows["label"].to_numpy() > 0).astype(float))
    return places, weights, intercept


def score_column(model: tuple[np.ndarray, np.ndarray, float]):
    places, weights, intercept = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS, np.float32)
        table[places] = weights
        known = np.zeros(1 << BITS, bool)
        known[places] = True
        for text in batches:
            out = np.empty(len(text))
            for i, t in enumerate(text):
                z = intercept
                if t:
                    at = ngram_places(code_points(t))
                    at = at[known[at]]
                    z += float(table[np.unique(at)].sum(dtype=np.float64))
                out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yield pd.Series(out)

    return score


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    score = score_column(fit(docs, labels, **options))
    scored = docs.select("doc_id", score(text_of()).alias("score"))
    held = F.coalesce(~is_training(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    score = score_column(fit(docs, labels, **options))
    return whole_rows(docs).withColumn("_score", score(text_of("_doc.text"))).where(F.col("_score") < threshold).select("_doc.*")


