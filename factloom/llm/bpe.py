"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, over whole documents.

Merging one pre-token: its symbols form a doubly linked list. Every adjacent pair that
has a merge rank is put into the bucket of that rank. A three-level bitmap over the
ranks tells the lowest non-empty bucket by find-first-set, so the next merge is found in
constant time, however long the pre-token is. A bucket holds positions; a position whose
pair has changed since it was put there is stale and is skipped when it is met.

Encoding a pre-token of n bytes takes O(n) queue operations, against O(n^2) of a scan for
the least rank. Pre-tokens recur, so their ids are kept in a bounded per-worker cache.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The public pre-token pattern of the byte-level BPE family (a fixed value, as published with the vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 1 << 18
#: Longest pre-token that is kept in the cache.
CACHE_LENGTH = 64


class RankQueue:
    """Priority queue over small integers: buckets plus a bitmap of bitmaps of bitmaps, 64 ways each."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def least(self) -> int:
        """The lowest rank that has a bucket, or -1."""
        top = self.top
        if not top:
            return -1
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = (b << 6) + (mid & -mid).bit_length() - 1
        low = self.low[a]
        return (a << 6) + (low & -low).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Remove and return the bucket of a rank that least() has given."""
        bucket = self.buckets.pop(rank)
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return bucket


class ByteBpe:
    """ranks: bytes of a token -> its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PRE_TOKEN) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str = PRE_TOKEN) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token. Within a bucket, positions go left to right, as merges of one rank must."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, rank_of = RankQueue(), [-1] * n
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2], -1)
            if rank >= 0:
                rank_of[i] = rank
                queue.push(rank, i)
        while (rank := queue.least()) >= 0:
            bucket = queue.take(rank)
            bucket.sort()
            for i in bucket:
                if rank_of[i] != rank or part[i] is None:
                    continue  # stale
                j = after[i]
                part[i] += part[j]
                part[j] = None
                rank_of[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    new = ranks.get(part[i] + part[k], -1)
                    rank_of[i] = new
                    if new >= 0:
                        queue.push(new, i)
                else:
                    rank_of[i] = -1
                h = before[i]
                if h >= 0:
                    new = ranks.get(part[h] + part[i], -1)
                    rank_of[h] = new
                    if new >= 0:
                        queue.push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def _miss(self, token: str) -> tuple[int, ...]:
        ids = tuple(self.merge(token.encode("utf-8", "surrogatepass")))
        if len(token) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, miss = self.cache.get, self._miss
        return list(itertools.chain.from_iterable([get(t) or miss(t) for t in self.find(text)]))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One per Python worker; workers are reused, so the cache of pre-tokens outlives a task."""
    return ByteBpe.from_file(path)


def default_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, without special tokens. Narrow: one scan of two columns, no shuffle.

    A null and an empty text give an empty list. Special-token strings in a text are ordinary text. Repeated
    rows and keys come out as often as they came in; other columns are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            counts, flat = [0], []
            for value in batch.column(1):
                s = value.as_py()
                if s:
                    flat += encode(s)
                counts.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    pruned = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = pruned.schema["k"].dataType.simpleString()
    return pruned.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
