"""From raw documents to token ids: drop toxic texts, repeated passages and near copies, mix the sources, encode.

STAGES has the stages in order; each takes (spark, docs, sf_dir), and run() applies them to the documents. All but the last return the
columns of the documents, whatever other columns these have and however they are named, and each takes an empty table to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import bpe, jaccard, linededup, mixing, toxicity
from sheaf.llm.common import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that score 0.3 or more. Null and empty texts get the intercept's score and stay; repeated rows go or stay together; very long texts are scored whole."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the blocks of lines that an earlier document (by doc_id, nulls first, then text hash) holds. Null and empty texts stay as they are, repeated rows lose the same lines, and very long texts are cut line by line."""
    return linededup.dedup_lines(docs).select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document. Texts without words, null ones included, are one class; of repeated rows one stays; a similarity equal to the threshold is a link."""
    return jaccard.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, 3 times at most, whole. A null source is one of its own; texts without words are taken 0 times; ties in the keyed order are told apart by a row number."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: doc_id, the digests and the ids. A null text is the empty one; very long texts are encoded whole."""
    return bpe.encode_report(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the classifier nor the alignment nor the encoding can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
