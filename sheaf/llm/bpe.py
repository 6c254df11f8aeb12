"""BPE encoding and decoding of a public word-level vocabulary.

Encoding: special tokens are cut out of the text as it stands; the rest is normalised (NFC, white space to a
space, lower case character by character) and split into pieces; a piece's UTF-8 bytes become symbols, the
last one with the end-of-word mark. Neighbours merge by rank from a priority queue over a doubly linked list
of the symbols; entries whose symbols have changed since are stale and skipped. Decoding concatenates the
ids' vocabulary strings, between spaces, as the vocabulary has no decoder of its own.

Symbols are ids while they merge, and a pair of them is one number. An entry of the queue is one number too,
its rank and place; it is stale if the pair at its place has another rank by then.

A null text counts as the empty one, which has no ids and decodes to the empty string. Text is handled
between spaces and line ends, which no piece crosses, so a worker keeps the runs that it has encoded, and
the pieces, which runs share; each memory holds so many entries at most, none of a long run, and then starts anew.
Repeated rows keep a row each. A very long text is encoded whole; pairs of one rank merge from the left.
An empty table gives an empty report. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_again, id_of, text_of

#: Ids that a worker holds before it sends them on.
SENT_IDS = 200_000
#: White space as the vocabulary's patterns mean it (the property White_Space), as members of a class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: What a worker remembers at most, and the longest run or piece that it remembers: some 300 bytes an entry, 2 kB at worst.
KEPT_RUNS, KEPT_PIECES, KEPT_CHARS = 150_000, 400_000, 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        self.pieces = regex.compile(pattern)
        self.unknown = max(self.vocab.values()) + 1  # no pair holds it
        self.ranks = {self.vocab[a] * (self.unknown + 1) + self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s, self.unknown) for s in symbols]
        self.last = [self.vocab.get(s + self.end, self.unknown) for s in symbols]
        self.marks = {s[0] for s in self.special}
        self.known: dict[str, tuple[int, ...]] = {}
        self.seen: dict[str, tuple[int, str, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, leftmost first among equals."""
        n, wide, rank_of, merged = len(symbols), self.unknown + 1, self.ranks.get, self.merged
        queue = [r * n + i for i in range(n - 1) if (r := rank_of(symbols[i] * wide + symbols[i + 1])) is not None]
        heapq.heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if symbols[i] < 0 or j == n or rank_of(symbols[i] * wide + symbols[j]) != rank:
                continue  # stale
            symbols[i], symbols[j] = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(symbols[i] * wide + symbols[k])) is not None:
                    heapq.heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] * wide + symbols[i])) is not None:
                heapq.heappush(queue, r * n + h)
        return [s for s in symbols if 0 <= s < self.unknown]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KEPT_PIECES:
                self.known.clear()
            data = piece.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            found = tuple(self.merge(symbols))
            if len(piece) <= KEPT_CHARS:
                self.known[piece] = found
        return found

    def encode_run(self, run: str) -> tuple[int, ...]:
        """The ids of text without spaces."""
        ids: list[int] = []
        for k, part in enumerate([run] if self.marks.isdisjoint(run) else self.cut.split(run)):
            if k % 2:
                ids.append(self.special[part])
                continue
            plain = part if part.isascii() else unicodedata.normalize("NFC", part)
            plain = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()  # the one letter whose lower case depends on its place
            for piece in self.pieces.findall(plain):
                ids += self.encode_piece(piece)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return [i for run in text.replace("\n", " ").split(" ") if run for i in self.encode_run(run)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One vocabulary for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def runs_of(text: str) -> list[str]:
    return [r for r in text.replace("\n", " ").split(" ") if r]


def encode_report(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_tokens, and hashes of its ids and of what they decode to; the ids too, if asked for."""
    path = path or default_vocabulary()
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        kept = bpe.seen
        for pdf in batches:
            rows, held = [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                n, ids, strings = 0, [], []
                for run in runs_of(text):
                    found = kept.get(run)
                    if found is None:
                        if len(kept) >= KEPT_RUNS:
                            kept.clear()
                        new = bpe.encode_run(run)
                        found = (len(new), " ".join(map(str, new)), bpe.decode(new))
                        if len(run) <= KEPT_CHARS:
                            kept[run] = found
                    if found[0]:
                        n += found[0]
                        ids.append(found[1])
                        strings.append(found[2])
                joined = " ".join(ids)
                hashes = sha256(joined.encode()).hexdigest(), sha256(" ".join(strings).encode("utf-8", "surrogatepass")).hexdigest()
                if with_ids:
                    rows.append((doc_id, n, *hashes, np.fromstring(joined, np.int32, sep=" ") if n else np.zeros(0, np.int32)))
                    held += n
                else:
                    rows.append((doc_id, n, *hashes))
                if held >= SENT_IDS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    encoded = docs.select(id_of().alias("doc_id"), text_of().alias("text")).mapInPandas(encode, schema)
    return encoded.withColumn("doc_id", id_again())
