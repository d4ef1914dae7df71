"""Problem 8: encoding of a corpus with a public byte-pair tokenizer.

A text is cut before every run of blanks, so that equal pieces, each a run of
blanks and what follows it, recur and are encoded once a worker.  A piece's
words are encoded with a contiguous rank array: part boundaries and the ranks
of adjacent parts; the least is found by scanning, its boundary deleted and
the neighbouring ranks refreshed.  Words over ``LONG`` bytes use a heap in
place of the scan, with the same result.

Null and empty texts give the empty list; blank texts are encoded as they
stand.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

# Fixed value: how the tokenizer cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
_NONE = 1 << 30


class Encoder:
    """Encodes texts under a table of byte strings and their ranks."""

    MEMO = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.words = regex.compile(PATTERN).findall
        self.pieces = regex.compile(r"\s*\S+|\s+").findall
        self.memo: dict[str, bytes] = {}
        self.own: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > LONG:
            return self._merge_long(word)
        bounds = list(range(len(word) + 1))
        own = [ranks.get(word[k : k + 2], _NONE) for k in range(len(word) - 1)]
        while own:
            least = min(own)
            if least == _NONE:
                break
            k = own.index(least)
            del bounds[k + 1], own[k]
            if k < len(own):
                own[k] = ranks.get(word[bounds[k] : bounds[k + 2]], _NONE)
            if k:
                own[k - 1] = ranks.get(word[bounds[k - 1] : bounds[k + 1]], _NONE)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        live = bytearray(b"\1") * n
        while heap:
            r, k, end = heapq.heappop(heap)
            if not live[k] or after[k] >= n or after[after[k]] != end:
                continue
            gone = after[k]
            live[gone] = 0
            after[k] = end
            if end < n:
                before[end] = k
                if (r := ranks.get(word[k : after[end]])) is not None:
                    heapq.heappush(heap, (r, k, after[end]))
            if before[k] >= 0:
                b = before[k]
                if (r := ranks.get(word[b:end])) is not None:
                    heapq.heappush(heap, (r, b, end))
        out, k = [], 0
        while k < n:
            out.append(ranks[word[k : after[k]]])
            k = after[k]
        return out

    def piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for word in self.words(piece):
            own = self.own.get(word)
            if own is None:
                own = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(self.own) >= self.MEMO:
                    self.own.clear()
                self.own[word] = own
            ids += own
        out = np.array(ids, np.int32).tobytes()
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        if len(piece) < 200:
            self.memo[piece] = out
        return out

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers in a row."""
        if not text:
            return b""
        get, encode = self.memo.get, self.piece
        return b"".join([get(p) or encode(p) for p in self.pieces(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def load_ranks(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> dict[bytes, int]:
    """A vocabulary file's byte strings with their ranks; ``folder`` is where it lies."""
    with open(common.tokenizer_path(name, folder), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _encoder(spark: SparkSession, name: str, folder: str | None):
    common.ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(name, folder))
    key = common.fresh_key()
    return lambda: common.kept(key, lambda: Encoder(ranks.value))


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id_col, ids) of every row."""
    encoder = _encoder(df.sparkSession, name, folder)
    kind = dict(df.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder().packed
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                own = [packed(t) for t in common.column(part, "text")]
                ends = np.cumsum([0, *(len(x) // 4 for x in own)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return common.rows_of(df, id=F.col(id_col), text=F.col(text)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_count(spark: SparkSession, text: Column, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> Column:
    """The number of tokens of a text; 0 for null."""
    encoder = _encoder(spark, name, folder)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = encoder().packed
        for texts in batches:
            yield texts.map(lambda t: len(packed(t)) // 4).astype("int32")

    return count(text)
