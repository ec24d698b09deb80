"""Byte-level BPE encoding of whole texts with a public vocabulary.

A text is split by the vocabulary's pattern; each piece becomes a doubly linked list of byte symbols, and a priority
queue of (rank, position) merges the pair of lowest rank first. Entries whose symbols changed meanwhile are stale and skipped.
Pieces recur, so each worker keeps their ids in a bounded table. Decoding joins the vocabulary's byte strings.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; blank, odd and very long
texts are encoded like any other, in O(n log n) for a single piece of n bytes.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that the public vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces kept by a worker.
KEPT = 200_000


class BytePairEncoder:
    """Encoder and decoder over a table of mergeable ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.strings = {i: s for s, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> BytePairEncoder:
        """Read lines of a base64 string and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(s): int(r) for s, r in map(bytes.split, f)})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(ranks[s], i, 2) for i in range(n - 1) if (s := piece[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, length = heapq.heappop(queue)
            own = symbol[i]
            if own is None or (j := right[i]) >= n or len(own) + len(symbol[j]) != length:
                continue  # stale: one of the two was merged meanwhile
            joined = own + symbol[j]
            symbol[i], symbol[j] = joined, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (rank := ranks.get(joined + symbol[k])) is not None:
                    heapq.heappush(queue, (rank, i, length + len(symbol[k])))
            h = left[i]
            if h >= 0 and (rank := ranks.get(symbol[h] + joined)) is not None:
                heapq.heappush(queue, (rank, h, len(symbol[h]) + length))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty."""
        if not text:
            return []
        kept, ids = self.kept, []
        for piece in self.split(text):
            found = kept.get(piece)
            if found is None:
                found = self.merge(piece.encode())
                if len(piece) <= 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


_LOADED: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoder.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _LOADED[path]


def shipped(path: str) -> str:
    """``path``, given to the workers of the active session, which need no such folder of their own."""
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def vocabulary(name: str, folder: str = VOCABULARY_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_column(text: Column, path: str) -> Column:
    """array<int> of each text."""
    shipped(path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], index=texts.index)

    return encode(text)


def count_column(text: Column, path: str) -> Column:
    """Number of ids of each text."""
    shipped(path)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([len(own.encode(t)) for t in texts], index=texts.index, dtype="int64")

    return count(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each list of ids; null for null."""
    shipped(path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for lists in batches:
            yield pd.Series([None if x is None else own.decode(list(x)) for x in lists], index=lists.index, dtype="object")

    return decode(ids)


def encode_corpus(df: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """doc_id, ids: one row per document."""
    return df.select(F.col(doc_id).alias("doc_id"), encode_column(F.col(text).cast("string"), path).alias("ids"))
