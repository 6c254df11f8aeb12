"""Token ids in fixed-width bit-packed blocks.

A block holds whole documents: header, the documents' offsets, then the ids, each in the fewest bits that the
vocabulary needs, in little-endian 64-bit words. Fixed width makes the i-th id's place plain arithmetic, so a
block is read at random (`BlockReader.ids`) or unpacked whole by numpy (`BlockReader.all`). Blocks are rows
(part, block, n_ids, n_docs, data) of Parquet files, one file for each range of doc_id and text hash, so that Spark's
committer makes writes safe to repeat and any store that Spark reaches will do. Rows are in ascending order of
doc_id (nulls first), then text hash.

A null or empty text has no ids but the end id. Repeated rows are written as often as they stand there, one after
another. An empty table writes no blocks. A very long text is encoded whole, in a block of its own; of a row's text a worker
remembers no run over KEPT_RUN characters, so long runs without blanks (base64) do not fill it.
Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_again, id_of, scratch_path, text_of

MAGIC = b"TIDS"
HEADER = struct.Struct("<4sHHQQ")  # magic, version, bits, documents, ids
#: Ids after which a block ends; a longer document makes a longer block.
BLOCK_IDS = 1 << 16
#: Bytes of encoded runs that a worker keeps (about 300 an ordinary run, with what Python adds), the longest run it keeps, and bytes of text that it encodes at a time.
KEPT_BYTES, KEPT_RUN, SLICE_BYTES = 300_000_000, 256, 12_000_000
#: What an entry of the memory takes beside its run and its ids.
ENTRY_BYTES = 190
BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of the same place modulo 64 share their shift, so each of 64 lanes is packed as a vector."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: np.ndarray, start: int, stop: int, bits: int) -> np.ndarray:
    """The ids from start to stop of packed 64-bit words, without the others."""
    at = np.arange(start, stop, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = data[word] >> shift
    over = shift + np.uint64(bits) > np.uint64(64)
    if over.any():
        out[over] |= data[word[over] + 1] << (np.uint64(64) - shift[over])
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_block(doc_ids: list[int], parts: list[np.ndarray], bits: int) -> bytes:
    offsets = np.zeros(len(parts) + 1, "<u8")
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    ids = np.concatenate(parts)
    return HEADER.pack(MAGIC, 1, bits, len(parts), len(ids)) + np.array(doc_ids, "<i8").tobytes() + offsets.tobytes() + pack(ids, bits)


class BlockReader:
    def __init__(self, data: bytes):
        magic, version, self.bits, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, HEADER.size)
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, HEADER.size + 8 * self.n_docs).astype(np.int64)
        self.words = np.frombuffer(data, "<u8", -1, HEADER.size + 8 * (2 * self.n_docs + 1))

    def ids(self, k: int) -> np.ndarray:
        """The k-th document's ids."""
        return unpack(self.words, int(self.offsets[k]), int(self.offsets[k + 1]), self.bits)

    def all(self) -> np.ndarray:
        return unpack(self.words, 0, self.n_ids, self.bits)


class WordEncoder:
    """The library's ids for texts. No piece crosses a space or a line end, so what stands between them is encoded once for each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.kept: dict[str, bytes] = {}
        self.bytes = 0
        self.check_blanks()

    def check_blanks(self) -> None:
        """Refuses a tokenizer whose pieces cross blanks or line ends, or that marks where a text begins: its ids of a text are not those of its runs."""
        runs = ["One", "two", "", "3", "x.y", "", "", "Ünï", "a"]
        for blank in (" ", "\n"):
            text = blank.join(runs)
            whole, parts = self.model.encode(text, add_special_tokens=False).ids, self.model.encode(runs, is_pretokenized=True, add_special_tokens=False).ids
            if whole != parts or whole != [i for r in runs for i in self.model.encode(r, add_special_tokens=False).ids]:
                raise ValueError("this tokenizer's pieces cross blanks or line ends")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end)."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary.to_pylist()
        new = [r for r in runs if r not in self.kept]
        here: dict[str, bytes] = {}
        if new:
            found = self.model.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4"), np.array(found.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(new) + 1))
            data = ids.tobytes()
            here = {r: data[4 * a : 4 * b] for r, a, b in zip(new, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        parts = [here[r] if r in here else self.kept[r] for r in runs]
        short = {r: x for r, x in here.items() if len(r) <= KEPT_RUN}
        more = sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)
        if self.bytes + more > KEPT_BYTES:
            self.kept.clear()
            self.bytes = 0
        self.kept.update(short)
        self.bytes += more
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        size = sizes[codes]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text."""
    sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    lo = 0
    while lo < batch.num_rows:
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes every text, appends end_id, and writes the blocks to path."""
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        part, block = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        parts: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, parts, n, block
            out = pa.RecordBatch.from_pydict({"part": [part], "block": [block], "n_ids": [n], "n_docs": [len(parts)], "data": [build_block(doc_ids, parts, bits)]}, schema=BLOCK_SCHEMA)
            doc_ids, parts, n, block = [], [], 0, block + 1
            return out

        for batch in batches:
            for some in slices(batch):
                ids, bounds = encoder.encode(some["text"])
                for doc_id, a, b in zip(some["doc_id"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.concatenate([ids[a:b], end]))
                    n += len(parts[-1])
                    if n >= BLOCK_IDS:
                        yield flush()
        if parts:
            yield flush()

    rows = docs.select(id_of().alias("doc_id"), text_of().alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # null or repeated ids are many ranges
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = ordered.mapInArrow(blocks, "part int, block int, n_ids long, n_docs long, data binary")
    packed.write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    table = spark.read.schema("part int, block int, n_ids long, n_docs long, data binary").parquet(path)
    sizes = table.select("part", "block", "n_ids")
    inner = sizes.withColumn("_in", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    # a row for each file, of which there are as many as the writer had tasks
    before = totals.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = inner.join(before, "part").select("part", "block", (F.col("_in") + F.col("_before")).alias("first"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, block, data in zip(pdf["part"], pdf["block"], pdf["data"], strict=True):
                reader = BlockReader(data)
                ids = reader.all()
                at = reader.offsets
                yield pd.DataFrame({
                    "part": part, "block": block, "doc_id": reader.doc_ids, "at": at[:-1], "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)],
                })

    read = table.select("part", "block", "data").mapInPandas(documents, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "block"]).select(id_again().alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def packed_report(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs' ids to the shared scratch folder and reads them back."""
    from .bpe import default_vocabulary

    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer or default_vocabulary(), end_id)
    return read_ids(docs.sparkSession, path)
