"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, scratch_path  # noqa: F401  (scratch_path is for the operators)

#: Characters of text that a Python task turns into arrays at a time.
CHUNK_CHARS = 2_000_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Stands for a null doc_id inside the operators: it sorts first, and Python gets whole numbers only.
NO_ID = -(1 << 63)


def id_of(column: str | Column = "doc_id") -> Column:
    """The id, NO_ID for null."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NO_ID))


def id_again(column: str = "doc_id") -> Column:
    """id_of undone."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def with_row_key(docs: DataFrame) -> DataFrame:
    """_id, _th and text of each row of docs: the id and a hash of the text, equal for repeated rows only."""
    return docs.select(id_of().alias("_id"), F.xxhash64(text_of()).alias("_th"), text_of().alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """One column _doc with all columns of docs, so that theirs can have any name."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"))


def in_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words, and the offsets of each text's words in them."""
    lists = [t.split() for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = list(chain.from_iterable(lists))
    table = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in table), np.uint64, len(table))
    codes = np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))
    return hashes[codes], offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of so many words; a shorter text has one run of all its words, an empty one none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(out)


def constant_array(values: list, kind: str = "string") -> Column:
    """A literal array, which the optimiser builds once; the values hold no unit separators."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f").cast(f"array<{kind}>")
