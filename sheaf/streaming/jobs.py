"""Incremental jobs: resumable ingest of new rows, requests that reuse answers, and the search log by time windows.

What a stream must remember of each key (a document that is there, an answer that is stored) is in Spark's state store; a batch reads its new
rows only, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import chunking
from ..operators.analytics import log_windows

#: The store that keyed state of any kind needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups of documents whose state a task asks in one call; each document has an entry of its own there.
GROUPS = 4096


class NewDocuments(StatefulProcessor):
    """Of a group of documents lets through those that come first; of rows of a batch that repeat a document the first by content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getMapState("there", "document_id string", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first: dict[str | None, str | None] = {}
        for pdf in rows:
            for document, content in zip(pdf["document_id"], pdf["content"], strict=True):
                held = first.get(document)
                if document not in first or content is not None and (held is None or content < held):
                    first[document] = content
        new = [x for x in first if not self.there.containsKey((x,))]
        for x in new:
            self.there.updateValue((x,), (True,))
        if new:
            yield pd.DataFrame({"document_id": new, "content": [first[x] for x in new]}, dtype=object)

    def close(self) -> None:
        pass


class StoredAnswers(StatefulProcessor):
    """For each request of a key whether an answer is stored that is younger than the limit, and whose; a timer takes it away when it is too old."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long, by string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")  # of one key and one batch
        at, by = self.stored.get() if self.stored.exists() else (None, None)
        before, hits, owners = at, [], []
        for ts, request in zip((asked["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), asked["request_id"], strict=True):
            hits.append(at is not None and ts - at < self.ttl * 1000)
            if not hits[-1]:
                at, by = ts, request
            owners.append(by)
        if at != before:
            self.stored.update((at, by))
            self.handle.registerTimer(at + self.ttl * 1000)
        yield pd.DataFrame({"request_id": asked["request_id"].to_numpy(), "cache_key": key[0], "from_cache": hits, "stored_by": owners})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.stored.exists() and self.stored.get()[0] + self.ttl * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()
        yield from ()

    def close(self) -> None:
        pass


def ingest_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 5, select: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New files of a parquet folder become chunk rows in target, batch by batch; `select` makes document_id and content of their rows.

    A batch is written to a folder of its own number and replaces what an interrupted try left there. Documents that came before are known
    from keyed state and left out, so a restart neither loses nor repeats one; of rows of a batch that repeat a document
    the first by content stays. Nothing that earlier batches wrote is read.
    """
    spark.conf.set(*STORE)

    def write(batch: DataFrame, number: int) -> None:
        chunking.smart_chunks(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    docs = (rows if select is None else select(rows)).select("document_id", "content")
    grouped = docs.withColumn("_group", F.pmod(F.xxhash64("document_id"), F.lit(GROUPS)).cast("int")).groupBy("_group")
    new = grouped.transformWithStateInPandas(NewDocuments(), "document_id string, content string", "Append", "None")
    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reuse_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, ttl_seconds: int, late: str = "1 hour", files_per_batch: int = 5) -> StreamingQuery:
    """Requests (request_id, cache_key, ts) with from_cache and stored_by, as fusion.reuse_log gives them, kept by keyed state that expires."""
    spark.conf.set(*STORE)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy("cache_key").transformWithStateInPandas(StoredAnswers(ttl_seconds), "request_id string, cache_key string, from_cache boolean, stored_by string", "Append", "EventTime")
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, width: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Windowed figures of the search log, appended when the watermark passes a window."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return log_windows(rows, width).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
