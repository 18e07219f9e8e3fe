"""Packing of documents into containers of fixed token capacity, along a space-filling curve.

Every document gets a vector of few dimensions: a signed random projection of its token
counts, brought to unit length before. The position of that vector on a Hilbert curve is the sort key,
so that documents alike in wording stand near each other. The rows are range-sorted by (key, document),
and each range is packed in the curve's order: a document goes into the container among the OPEN last
ones that it fills best, and if none has room the fullest of them is closed for a new one. So a
container's members are neighbours on the curve, and a range leaves at most OPEN containers unfilled.
No range holds more than its share of equal keys, because the document's id breaks ties.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bpe import default_path, tokenizer
from factloom.llm.common import materialize

DIMENSIONS, BITS = 8, 7
#: Containers of a specification that are open at a time: how far along the curve a container may reach.
OPEN = 16
#: Most packing specifications, a small table given by the caller.
MOST_SPECS = 1000
#: Hashes of a document's signature, by which the likeness of container mates is measured.
SIGNATURE = 32


@functools.lru_cache(maxsize=8)
def encoder(name: str, path: str | None = None) -> Callable[[str], list[int]]:
    """Ids of a text by a public tokenizer, without special tokens; one a Python worker. path: its .tiktoken file, else the installed one is used."""
    if path:
        return tokenizer(path).encode
    import public_tokenizers

    if name.startswith("byte_bpe"):
        return tokenizer(default_path(name)).encode
    if name.startswith("word_bpe"):
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        words.encode_special_tokens = True
        return lambda text: words.encode(text, add_special_tokens=False).ids
    if name.startswith("piece_bpe"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model")).encode
    raise ValueError(f"no such tokenizer: {name}")


def projection(seed: int = 9, vocabulary: int = 65_536, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (vocabulary, dimensions))


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, d), each coordinate below 2**bits.

    Skilling's transposition ("Programming the Hilbert curve", 2004), on whole columns.
    """
    x = cells.astype(np.int64).T.copy()
    d, top = x.shape[0], 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measured(docs: DataFrame, names: tuple[str, ...] = ("byte_bpe_50k",), path: str | None = None) -> DataFrame:
    """(doc_id, sizes, curve) of every document: its tokens by each tokenizer, and its place by the first; null and empty texts have no tokens and curve 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, signs = [encoder(n, path) for n in names], projection()
        for batch in batches:
            sizes = np.zeros((batch.num_rows, len(names)), np.int64)
            points = np.zeros((batch.num_rows, DIMENSIONS))
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                for k, encode in enumerate(encoders if text else ()):
                    ids = encode(text)
                    sizes[i, k] = len(ids)
                    if k == 0 and ids:
                        found, counts = np.unique(np.asarray(ids) % len(signs), return_counts=True)
                        points[i] = counts @ signs[found] / np.sqrt(np.square(counts, dtype=np.float64).sum())
            cells = ((1 + points / (1 + np.abs(points))) / 2 * ((1 << BITS) - 1)).astype(np.int64)
            keys = np.where(sizes[:, 0] > 0, hilbert_index(cells), 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sizes.size + 1, len(names)), pa.int32()), pa.array(sizes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(keys)], names=["doc_id", "sizes", "curve"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, sizes array<bigint>, curve bigint")


class Filling:
    """The open containers of one specification in one range."""

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        self.capacity, self.most, self.opened = capacity, most, 0
        self.rooms: list[int] = []  # ascending
        self.bins: list[int] = []

    def put(self, size: int) -> int:
        """The container of the next item: the open one it fills best, else a new one."""
        at = bisect.bisect_left(self.rooms, size)
        if at < len(self.rooms):
            room, which = self.rooms.pop(at), self.bins.pop(at)
        else:
            room, which = self.capacity, self.opened
            self.opened += 1
            if len(self.rooms) >= self.most:
                del self.rooms[0], self.bins[0]  # the fullest
        room -= size
        if room or not size:
            at = bisect.bisect_left(self.rooms, room)
            self.rooms.insert(at, room)
            self.bins.insert(at, which)
        return which


def pack(docs: DataFrame, specs: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """(pack_id, container, doc_id, piece, start_token, n_tokens): where every document or piece goes.

    specs: pack_id, tokenizer (null: byte_bpe_50k; an unknown name is an error), capacity_tokens. A document longer than the
    capacity is cut into full pieces and a rest; no other is cut. Documents without tokens stand in a container like any
    other (size 0). A null pack_id and a null or non-positive capacity give no rows, an empty table gives none. Repeated
    and null doc_ids are packed row by row. container is unique within a pack_id, also where specifications share one.
    """
    spark = docs.sparkSession
    has_name = "tokenizer" in specs.columns
    rows = specs.select("pack_id", "capacity_tokens", F.col("tokenizer") if has_name else F.lit(None).cast("string").alias("tokenizer")).limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} packing specifications")
    asked = sorted({(int(r.pack_id), int(r.capacity_tokens), r.tokenizer or "byte_bpe_50k") for r in rows if r.pack_id is not None and (r.capacity_tokens or 0) > 0})
    schema = "pack_id bigint, container bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint"
    if not asked:
        return spark.createDataFrame([], schema)
    names = tuple(sorted({name for *_, name in asked}))
    for name in names:
        encoder(name, path)  # an unknown tokenizer shows here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filling = [Filling(capacity) for _, capacity, _ in asked]
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch.column(1).values.to_numpy().reshape(-1, len(names)) if batch.num_rows else np.zeros((0, len(names)), np.int64)
            for n, (pack_id, capacity, name) in enumerate(asked):
                put, size = filling[n].put, sizes[:, names.index(name)]
                pieces = np.maximum(1, -(-size // capacity))
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                container = base + np.array([put(x) for x in length.tolist()], np.int64) * len(asked) + n
                columns = [pa.array(np.full(len(doc), pack_id)), pa.array(container), batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, names=["pack_id", "container", "doc_id", "piece", "start_token", "n_tokens"])

    # written once: the range sort samples its input first, which would encode every text twice
    sized = materialize(measured(docs, names, path))
    ranged = sized.repartitionByRange(partitions, "curve", "doc_id") if partitions else sized.repartitionByRange("curve", "doc_id")  # as many ranges as its size takes
    return ranged.sortWithinPartitions("curve", "doc_id").select("doc_id", "sizes").mapInArrow(run, schema)


def signatures(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, signature): the least of SIGNATURE hashes over a document's distinct tokens; documents without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder("byte_bpe_50k", path)
        factors = np.random.default_rng(3).integers(1, 1 << 62, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            ids, out = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(np.asarray(encode(value), np.uint64)) if value else np.empty(0, np.uint64)
                if len(found):
                    with np.errstate(over="ignore"):
                        mixed = (found[:, None] + np.uint64(1)) * factors
                        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                    ids.append(key)
                    out.append((mixed >> np.uint64(1)).min(axis=0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, signature array<bigint>")


def likeness(packed: DataFrame, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(pack_id, likeness, by_chance): mean likeness (Jaccard, of the sets of tokens) of documents beside each other in a container, and of ones drawn anywhere."""
    signed = signatures(docs, path)
    members = packed.where("piece = 0").select("pack_id", "container", "doc_id").join(signed, "doc_id")
    same = F.aggregate(F.zip_with("signature", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SIGNATURE))
    inside = members.withColumn("other", F.lag("signature").over(Window.partitionBy("pack_id", "container").orderBy("doc_id")))
    mates = inside.where("other is not null").groupBy("pack_id").agg(F.avg(same).alias("likeness"))
    anywhere = signed.withColumn("h", F.xxhash64("doc_id")).withColumn("other", F.lag("signature").over(Window.partitionBy(F.expr("pmod(h, 256)")).orderBy("h")))
    chance = anywhere.where("other is not null").agg(F.avg(same).alias("by_chance"))
    return mates.crossJoin(chance)  # one row


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of used room of each specification; specifications that share a pack_id are summed up under the larger capacity."""
    per_bin = packed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"))
    per_spec = per_bin.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return specs.groupBy("pack_id").agg(F.max("capacity_tokens").alias("capacity_tokens")).join(per_spec, "pack_id").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
