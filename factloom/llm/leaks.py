"""Held-out passages inside a training corpus, by winnowing.

Both sides become streams of units: words (parted by white space, without letter case and
punctuation) or, in scripts without word spaces, single letters and digits. Of all hashes of k
consecutive units, the least of every window of w is kept (Schleimer, Wilkerson and Aiken,
"Winnowing", 2003). Any shared span of k + w - 1 units then shares at least one kept hash, so no
passage of the wanted length is missed. Hashes are joined, hits on one diagonal are counted
against what the wanted length guarantees, and the survivors are extended unit by unit.

A phrase of k units that many documents and many records have (a set phrase, a form letter) would bring
all of them together. So documents are first joined with the records' distinct hashes, one row each, and
what is left is joined on the hash together with the hash REACH units before or after it: a span of the
wanted length that holds k units goes on for REACH units at least on one of their sides, so this loses
nothing, and only phrases of k + REACH units can still meet without being leaks.

Held-out texts are fingerprinted once per distinct text, however many records have them. Claims
too short for the guarantee are found by hashing their whole length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Units that count as a leak, units a hash, hashes a window; by kind of stream.
NEED = {"w": 30, "c": 60}
GRAM = {"w": 10, "c": 24}
WINDOW = {"w": 6, "c": 16}
#: Half of what a wanted span has besides a hash's units: it has as much before them or after them.
REACH = {k: -(-(NEED[k] - GRAM[k]) // 2) for k in NEED}
#: Candidates of a document that are worked on together.
TOGETHER = 64
#: A text is a letter stream if at least this share of its letters is Han, Kana or Thai.
UNSPACED_SHARE = 0.1
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
COMMAND = re.compile(r"\\[A-Za-z]+\*?")
NOISE = re.compile(r"[\W_]+")
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)
CACHE_ENTRIES = 1 << 19
_words: dict[str, int] = {}


#: Markup whose own words aren't the text's: what it leaves behind.
NOTES = re.compile(r"<ref\b[^<>]*?(?:/>|>.*?</ref>)|\{\{[^{}]*\}\}|!\[[^\[\]]*\]\([^()\s]*\)", re.S)
LINKS = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[([^\[\]]*)\]\([^()\s]*\)")
REFERENCES = re.compile(r"\\(?:cite|label|ref)[a-z]*\*?\{[^{}]*\}")


#: What may be such markup, the marks of templates and comments, and the texts that tags show.
NOTED = re.compile(r"<ref\b|<!--|\{\{|!\[|\b(?:alt|title)\s*=\s*[\"']")
MARKS = re.compile(r"<!--|-->|\{\{|\}\}|\|(?:\s*\w+\s*=)?")
SHOWN = re.compile(r"\b(?:alt|title)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def plain(text: str, notes: bool = False) -> str:
    """Without markup that may stand around or within a passage. notes: footnotes, templates, comments and alternative texts lose only their marks."""
    if "&" in text:
        text = html.unescape(text)
    if notes:
        if "{{" in text or "<!--" in text:
            text = MARKS.sub(" ", LINKS.sub(lambda m: m[1] if m[1] is not None else m[2], text))
        text = TAG.sub(lambda m: " " + " ".join(x or y for x, y in SHOWN.findall(m[0])) + " ", text)
    elif "<ref" in text or "{{" in text or "![" in text:
        text = NOTES.sub(" ", text)
    if "[[" in text or "](" in text:
        text = LINKS.sub(lambda m: m[1] if m[1] is not None else m[2], text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "\\" in text:
        text = COMMAND.sub(" ", REFERENCES.sub(" ", text))
    return text


def readings(text: str) -> tuple[bool, ...]:
    """Values of `notes` with which a document is read: a passage may go on around a note, or stand in one."""
    return (False, True) if NOTED.search(html.unescape(text) if "&" in text else text) else (False,)


def _word(raw: str) -> int:
    bare = NOISE.sub("", unicodedata.normalize("NFKC", raw).casefold())
    value = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) or 1 if bare else 0
    if len(_words) >= CACHE_ENTRIES:
        _words.clear()
    _words[raw] = value
    return value


def words(text: str, notes: bool = False) -> np.ndarray:
    """A hash for each word; words of punctuation only are left out."""
    get = _words.get
    found = [get(x) if x in _words else _word(x) for x in plain(text, notes).split()]
    units = np.array(found, np.uint64)
    return units[units != 0]


def letters(text: str, notes: bool = False) -> np.ndarray:
    """The code points of all letters and digits."""
    bare = NOISE.sub("", unicodedata.normalize("NFKC", plain(text, notes)).casefold())
    return np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def unspaced(text: str) -> bool:
    n = len(UNSPACED.findall(text))
    return n > 0 and n >= UNSPACED_SHARE * sum(map(str.isalpha, text))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = units * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(28)
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of every window of w (the last one of equals); of all, if there are fewer than w."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    if len(hashes) <= w:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(windows)) + w - 1 - np.argmin(windows[:, ::-1], axis=1))


Prints = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _no_prints() -> Prints:
    return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)


def fingerprints(streams: list[np.ndarray], kind: str, exact: tuple[int, ...] = ()) -> Prints:
    """(stream number, hash, position, hash REACH units before, and after; 0 for none) of a batch of streams, worked on as one long array."""
    k = GRAM[kind]
    if not streams:
        return _no_prints()
    sizes = np.array([len(s) for s in streams], np.int64)
    starts = np.cumsum(sizes) - sizes
    units = np.concatenate(streams)
    owner = np.repeat(np.arange(len(streams)), sizes)
    out = []
    for length in (k, *exact):
        hashes = grams(units, length)
        n = len(hashes)
        if not n:
            continue
        inside = owner[:n] == owner[length - 1 : length - 1 + n]
        if length == k:
            at = winnow(np.where(inside, hashes, NO_HASH), WINDOW[kind])
            at = at[inside[at]]
            beside = []
            for step in (-REACH[kind], REACH[kind]):
                to = np.clip(at + step, 0, n - 1)
                there = (at + step == to) & (owner[to] == owner[at]) & inside[to]
                beside.append(np.where(there, (hashes[to] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)).astype(np.uint32).view(np.int32))
            out.append((owner[at], hashes[at], at - starts[owner[at]], *beside))
        else:
            at = np.flatnonzero(inside)
            none = np.zeros(len(at), np.int32)
            out.append((owner[at], hashes[at] ^ np.uint64(length * 0x9E3779B9), at - starts[owner[at]], none, none))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _no_prints()


def least_length(kind: str) -> int:
    return GRAM[kind] + WINDOW[kind] - 1


RECORD_SCHEMA = "text_id binary, kind string, need int, units array<bigint>"


def _record_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, needs, units = [], [], []
        for text, whole in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kind = "c" if unspaced(text) else "w"
            found = letters(text) if kind == "c" else words(text)
            need = min(NEED[kind], len(found)) if whole else NEED[kind]
            kinds.append(kind)
            needs.append(need if 0 < need <= len(found) else 0)
            units.append(found.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(needs, pa.int32()), pa.array(units, pa.list_(pa.int64()))], names=["text_id", "kind", "need", "units"])


def _batch(prints: list[tuple], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    """Prints of several kinds as one batch; ids are those of the rows."""
    rows, hashes, at, before, after, *more = (np.concatenate([p[j] for p in prints]) for j in range(len(prints[0])))
    columns = [pa.array(hashes.astype(np.uint64).view(np.int64)), ids.take(pa.array(rows.astype(np.int64))), pa.array(at.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in more], names=names)


def _record_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, needs = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        units = batch.column(3)
        parts = []
        for kind in GRAM:
            rows = [i for i, x in enumerate(kinds) if x == kind and needs[i] >= least_length(kind)]
            streams = [units[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in rows]
            owner, hashes, at, before, after = fingerprints(streams, kind)
            owner = np.array(rows, np.int64)[owner]
            parts.append((owner, hashes, at, before, after, needs[owner] >= NEED[kind]))
            for i, x in enumerate(kinds):
                if x == kind and 0 < needs[i] < least_length(kind):
                    stream = units[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    whole = grams(stream, len(stream)) ^ np.uint64(len(stream) * 0x9E3779B9)
                    zero = np.zeros(1, np.int32)
                    parts.append((np.array([i]), whole, zero, zero, zero, np.array([False])))
        yield _batch(parts, batch.column(0), ["hash", "text_id", "at", "before", "after", "wide"])


def _doc_prints(exact: dict[str, tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                texts = batch.column(1).to_pylist()
                read = [(i, notes) for i, t in enumerate(texts) for notes in readings(t)]
                spaceless = [(i, notes) for i, notes in read if UNSPACED.search(texts[i])]
                parts = []
                for kind, rows, of in (("w", read, words), ("c", spaceless, letters)):
                    owner, *rest = fingerprints([of(texts[i], notes) for i, notes in rows], kind, exact.get(kind, ()))
                    parts.append((np.array([i for i, _ in rows], np.int64)[owner], *rest))
                yield _batch(parts, batch.column(0), ["hash", "doc_id", "doc_at", "before", "after"])

    return run


def longest_run(doc: np.ndarray, record: np.ndarray, diagonal: int) -> int:
    """Most consecutive equal units where record[i] stands against doc[i + diagonal]."""
    lo, hi = max(0, -diagonal), min(len(record), len(doc) - diagonal)
    if hi <= lo:
        return 0
    differ = np.flatnonzero(record[lo:hi] != doc[lo + diagonal : hi + diagonal])
    edges = np.concatenate([[-1], differ, [hi - lo]])
    return int(np.diff(edges).max()) - 1


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for doc_id, text, candidates in zip(frame["doc_id"], frame["text"], frame["candidates"], strict=True):
            streams = {}
            done = set()
            for c in candidates:
                if c["text_id"] in done:
                    continue
                kind = c["kind"]
                if kind not in streams:
                    streams[kind] = [(letters if kind == "c" else words)(text, notes) for notes in readings(text)]
                units = np.asarray(c["units"], np.int64).view(np.uint64)
                if any(longest_run(s, units, int(c["diagonal"])) >= c["need"] for s in streams[kind]):
                    done.add(c["text_id"])
                    out.append((c["text_id"], doc_id))
        yield pd.DataFrame(out, columns=["text_id", "doc_id"]).astype({"doc_id": "int64"})


def leaked(records: DataFrame, docs: DataFrame, key: str = "claim_id", passages: str = "context", wholes: str = "claim") -> DataFrame:
    """(key, doc_id): records and documents that hold at least NEED consecutive units of the record's texts, or its whole claim if that is shorter.

    records: only held-out rows. Null and empty texts match nothing, a null key is left out; equal texts of many records
    are searched once and all their records come out, once a document. An empty table gives no rows.
    """
    texts = records.select(F.col(key).alias("key"), F.explode(F.array(F.struct(F.col(passages).alias("text"), F.lit(False).alias("whole")), F.struct(F.col(wholes).alias("text"), F.lit(True).alias("whole")))).alias("x"))
    texts = texts.select("key", "x.text", "x.whole").where("key is not null and text is not null and trim(text) <> ''")
    texts = texts.select("key", F.unhex(F.md5(F.concat(F.col("whole").cast("string"), "text"))).alias("text_id"), "text", "whole")
    owners = texts.select("key", "text_id").distinct()
    parsed = texts.groupBy("text_id").agg(F.first("text").alias("text"), F.first("whole").alias("whole")).mapInArrow(_record_units, RECORD_SCHEMA).where("need > 0")
    parsed = materialize(parsed)
    short = parsed.where(" or ".join(f"(kind = '{k}' and need < {least_length(k)})" for k in GRAM)).select("kind", "need").distinct().collect()  # at most the sum of the least lengths
    exact = {k: tuple(sorted(r.need for r in short if r.kind == k)) for k in GRAM}
    prints = parsed.mapInArrow(_record_prints, "hash bigint, text_id binary, at int, before int, after int, wide boolean")
    of_docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    doc_prints = of_docs.mapInArrow(_doc_prints(exact), "hash bigint, doc_id bigint, doc_at int, before int, after int")
    # both joins have keys that a set phrase doesn't fill on both sides: see the module's docstring
    met = doc_prints.join(prints.select("hash").distinct(), "hash", "left_semi")
    beside = lambda always: F.explode(F.filter(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("unit")), F.struct(F.lit("a").alias("side"), F.col("after").alias("unit")), F.when(always, F.struct(F.lit("-").alias("side"), F.lit(1).alias("unit")))), lambda x: x["unit"] != 0))
    of_docs_by = met.select("hash", "doc_id", "doc_at", beside(F.lit(True)).alias("x")).select("hash", "doc_id", "doc_at", "x.side", "x.unit")
    wide = prints.where("wide").select("hash", "text_id", "at", beside(F.lit(False)).alias("x")).select("hash", "text_id", "at", "x.side", "x.unit")
    short = prints.where("not wide").select("hash", "text_id", "at", F.lit("-").alias("side"), F.lit(1).alias("unit"))
    hits = of_docs_by.join(wide.union(short), ["hash", "side", "unit"]).groupBy("text_id", "doc_id", (F.col("doc_at") - F.col("at")).alias("diagonal")).agg(F.count_distinct("at").alias("hits"))
    # kept hashes that a shared span of `need` units has at least: one a window
    window = F.when(F.col("kind") == "c", WINDOW["c"]).otherwise(WINDOW["w"])
    gram = F.when(F.col("kind") == "c", GRAM["c"]).otherwise(GRAM["w"])
    sure = F.greatest(F.lit(1), F.floor((F.col("need") - gram + 1) / window))
    # a page that reprints a test set has many: they are worked on in lots of bounded size
    lot = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("text_id", "diagonal")) - 1) / TOGETHER)
    lots = hits.join(parsed.select("text_id", "kind", "need"), "text_id").where(F.col("hits") >= sure).withColumn("lot", lot)
    grouped = lots.drop("kind", "need").join(parsed, "text_id").groupBy("doc_id", "lot").agg(F.collect_list(F.struct("text_id", "kind", "need", "diagonal", "units")).alias("candidates"))
    found = grouped.join(of_docs, "doc_id").select("doc_id", "text", "candidates").mapInPandas(_verify, "text_id binary, doc_id bigint")
    return found.join(owners, "text_id").select(F.col("key").alias(key), "doc_id").distinct()


def report(found: DataFrame, records: DataFrame, key: str = "claim_id") -> DataFrame:
    """Leaks by split and paper: records leaked and documents concerned."""
    names = records.select(key, "split", "paper_id").where(F.col(key).isNotNull()).distinct()
    return found.join(names, key).groupBy("split", "paper_id").agg(F.count_distinct(key).alias("records"), F.count_distinct("doc_id").alias("documents"))
