"""Same or near-same records across splits, by content-defined chunks.

A record's normalised text is cut where a rolling hash of its last characters hits a mask, so an
edit changes only the chunks around it. Chunk digests are joined between the train and the
evaluation side, and the lengths of shared chunks are summed into an overlap fraction of each pair
of records. Pairs with enough overlap are then checked exactly for what may differ.

A record about another number is another record, so a digest covers the record's numbers as well as
the chunk: phrases of a template that a third of all records share don't meet in one join key. Of the
digests that stand on both sides, each record is looked up by its rarest ones only: those in front of the
last ones that together are too short for the wanted overlap. Two records with enough overlap share at
least one of these (the rarest that they share at all), so nothing is lost, and a phrase that a third of
both sides has is a key only for records that consist of little else.
Equal records are one class until the very end, however often they were delivered.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Rolling window in characters; a cut where the hash has CUT_BITS zero bits; least length of a chunk.
ROLL, CUT_BITS, LEAST_CHUNK = 6, 3, 6
#: Least share of the longer record's characters in shared chunks.
OVERLAP = 0.25
#: Share of a text's words that may be reworded, and words that always may.
REWORDED, FEW = 0.35, 4
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+(?:[-+./'’][\p{L}\p{M}\p{N}]+)*\+?")
HYPHENS = regex.compile(r"[‐-―−﹘﹣－]")
SPACES = regex.compile(r"[\s­​-‏‪-‮⁠﻿]+")
DIGITS = regex.compile(r"\p{N}+")
#: Words that tell German, which capitalises its nouns, and the least share of a text's words; share of the longer words with a capital in a title.
GERMAN = frozenset("der das den dem und ist sind auf für mit von bei als nicht ein eine einen einem einer wird werden zeigt dass aus im zu je gegen durch über nach ohne".split())
GERMAN_SHARE, TITLE_SHARE = 0.08, 0.6
#: What tells a German noun from a name: an article before it and its adjectives, or its ending.
ARTICLES = frozenset("der die das den dem des ein eine einen einem einer eines kein keine keinen jede jeder jedes jeden diese dieser dieses diesen".split())
ADJECTIVE = regex.compile(r"\p{Ll}{2,}e[nrsm]?")
NOUN = regex.compile(r"\p{L}{2,}(?:ung|heit|keit|schaft|tion|tät|nis|ismus)(?:s|en|sen|se)?")
#: Whether a word names something: no; perhaps (a capital where nouns or all words have one); yes.
PLAIN, PERHAPS, NAME = 0, 1, 2


def folded(text: str | None) -> str:
    """Unicode form, hyphens, ampersands and white space made alike; letter case is kept."""
    text = HYPHENS.sub("-", unicodedata.normalize("NFKC", text or ""))
    return SPACES.sub(" ", text).replace("&", " and ").strip()


def normal(text: str | None) -> str:
    """The words in lower case, without punctuation."""
    return " ".join(WORD.findall(folded(text).casefold()))


def numbers(text: str) -> tuple[str, ...]:
    return tuple(sorted(DIGITS.findall(text)))


def chunks(text: str) -> list[str]:
    """Cut after every character where the hash of the last ROLL characters has CUT_BITS zero bits."""
    n = len(text)
    if n <= ROLL:
        return [text] if text else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        rolling = np.zeros(n - ROLL + 1, np.uint64)
        for j in range(ROLL):
            rolling = rolling * np.uint64(0x100000001B3) + points[j : n - ROLL + 1 + j]
        rolling *= np.uint64(0x9E3779B97F4A7C15)
    cuts = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + ROLL
    out, last = [], 0
    for c in cuts.tolist():
        if c - last >= LEAST_CHUNK:
            out.append(text[last:c])
            last = c
    if last < n:
        out.append(text[last:])
    return out


def pieces(claim: str | None, caption: str | None) -> tuple[dict[str, int], int, int]:
    """A record's chunks with their summed lengths, the length of its normalised text, and the hash of its numbers."""
    text = normal(claim) + "\n" + normal(caption)
    found: dict[str, int] = {}
    for x in chunks(text):
        found[x] = found.get(x, 0) + len(x)
    return found, len(text), xxhash.xxh3_64_intdigest(" ".join(numbers(text)).encode())


def overlap(a: tuple[dict[str, int], int, int], b: tuple[dict[str, int], int, int]) -> float:
    """Share of the longer record's characters in shared chunks; 0 where the numbers differ."""
    if a[2] != b[2]:
        return 0.0
    return sum(min(n, b[0][x]) for x, n in a[0].items() if x in b[0]) / max(1, a[1], b[1])


DIGESTS = "class_id binary, digest bigint, size int, total int"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, digests, sizes, totals = [], [], [], []
        for i, (claim, caption) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            found, total, salt = pieces(claim, caption)
            for x, size in found.items():
                rows.append(i)
                digests.append(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=salt))
                sizes.append(size)
                totals.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(totals, pa.int32())], names=[x.split()[0] for x in DIGESTS.split(", ")])


def _slip(a: str, b: str, name: int) -> bool:
    """b is a slip of typing of a: neighbours swapped, or (not within a name) a letter lost, added or changed, at most two of them (one in what may be a name)."""
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        swapped = sorted(a) == sorted(b) and len(at) <= 4
        return swapped or (name != NAME and len(at) <= 1 + (len(a) > 6 and name == PLAIN) and len(a) > 3)
    if name == NAME or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def _capitals_tell(text: str) -> bool:
    """A capital within a sentence makes a name: the text isn't German, nor a title whose words all have one."""
    words = WORD.findall(text)
    long = [w for w in words if len(w) > 3 and w[0].isalpha()]
    title = len(long) > 3 and sum(w[0].isupper() for w in long) >= TITLE_SHARE * len(long)
    return not title and sum(w.casefold() in GERMAN for w in words) < GERMAN_SHARE * max(1, len(words))


def _noun(words: list[str]) -> bool:
    """The last of the words is a German noun by its ending, or by an article or a number before it and its adjectives."""
    if NOUN.fullmatch(words[-1]):
        return True
    i = len(words) - 2
    while i >= 0 and words[i].casefold() not in ARTICLES and ADJECTIVE.fullmatch(words[i]):
        i -= 1
    return i >= 0 and (words[i].casefold() in ARTICLES or words[i][0].isdigit())


def _tokens(text: str, tell: bool = True, small: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """(word in lower case, whether it names something: it has a digit, inner capitals, or a capital within a sentence).

    Where capitals don't tell, a word that has only its first as a capital may be a name; not if it is known in small letters.
    """
    text = folded(text)
    letters = [c for c in text if c.isalpha()]
    cased = sum(map(str.isupper, letters)) < 0.6 * max(1, len(letters))
    out = []
    before: list[str] = []
    for m in WORD.finditer(text):
        w = m[0]
        before = [*before[-4:], w]
        starts = m.start() == 0 or text[: m.start()].rstrip(" “\"'«(")[-1:] in ("", ".", "!", "?", ":", "。")
        name = PLAIN
        if any(map(str.isdigit, w)) or cased and any(map(str.isupper, w[1:])):
            name = NAME
        elif cased and w[:1].isupper() and not starts:
            name = NAME if tell else PLAIN if w.casefold() in small or _noun(before) else PERHAPS
        out.append((w.casefold(), name))
    return out


def alike(a: str | None, b: str | None) -> bool:
    """Equal but for letter case, spacing, punctuation, Unicode form, slips of typing, missing short words or a reworded phrase.

    A null is like a null or an empty text only.
    """
    x, y = _tokens(a or ""), _tokens(b or "")
    p, q = [w for w, _ in x], [w for w, _ in y]
    if p == q:
        return True
    one, two = folded(a), folded(b)
    if not (_capitals_tell(one) and _capitals_tell(two)):
        small = frozenset(w for w in WORD.findall(f"{one} {two}") if w.islower())
        x, y = _tokens(one, False, small), _tokens(two, False, small)
    if not p or not q or numbers(" ".join(p)) != numbers(" ".join(q)):
        return False
    # equal words at both ends need no alignment
    head = next((i for i, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
    tail = next((i for i, (u, v) in enumerate(zip(p[head:][::-1], q[head:][::-1], strict=False)) if u != v), min(len(p), len(q)) - head)
    most = max(FEW, REWORDED * max(len(p), len(q)))
    x, y, p, q = (z[head : len(z) - tail] for z in (x, y, p, q))
    changed = 0
    for op, i, j, k, m in SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = x[i:j], y[k:m]
        if "".join(w for w, _ in left) == "".join(w for w, _ in right):
            continue  # spacing
        if len(left) == len(right) and all(u == v or _slip(u, v, NAME if NAME in (s, t) else min(s, t)) for (u, s), (v, t) in zip(left, right, strict=True)):
            continue
        names = [sorted(w for w, name in side if name) for side in (left, right)]
        if names[0] != names[1]:
            return False
        changed += max(len(left), len(right))
    return changed <= most


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = functools.lru_cache(maxsize=4096)(pieces)
    for f in frames:
        shares = [overlap(known(a, c), known(b, d)) for a, b, c, d in zip(f["claim_a"], f["claim_b"], f["caption_a"], f["caption_b"], strict=True)]
        keep = [x >= OVERLAP and alike(a, b) and alike(c, d) for x, a, b, c, d in zip(shares, f["claim_a"], f["claim_b"], f["caption_a"], f["caption_b"], strict=True)]
        yield f.assign(overlap=shares).loc[keep, ["a", "b", "overlap"]]


def keyed(train: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, class_id) of either side: the digests that stand on both sides and by which a record is looked up, its rarest ones.

    Every join has one row a digest on its other side, so a hot digest can be split. The train side is worked out once, the
    smaller held-out side twice.
    """
    shared = materialize(train.join(held.select("digest").distinct(), "digest", "left_semi"))
    counted = shared.groupBy("digest").agg(F.count("*").alias("n"))

    def rarest(digests: DataFrame) -> DataFrame:
        # the lengths of this digest and of all more frequent ones
        onward = F.sum("size").over(Window.partitionBy("class_id").orderBy(F.desc("n"), F.desc("digest")).rowsBetween(Window.unboundedPreceding, 0))
        return digests.join(counted, "digest").withColumn("onward", onward).where(F.col("onward") >= OVERLAP * F.col("total")).select("digest", "class_id")

    return rarest(shared), rarest(held)


def side(split: Column) -> Column:
    """'train', 'eval' (dev and test), or null."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", "train").when(s.isin("dev", "test"), "eval")


def cross_split(records: DataFrame) -> DataFrame:
    """(train_row, eval_row, overlap): rows of train and of dev or test that are the same record or almost.

    Rows with a null row_id, with another split, or without a claim match nothing; a null and an empty caption are alike.
    Every row of equal records is listed. An empty table gives no rows.
    """
    rows = records.select("row_id", side(F.col("split")).alias("side"), F.coalesce("claim", F.lit("")).alias("claim"), F.coalesce("caption", F.lit("")).alias("caption"))
    rows = rows.where("row_id is not null and side is not null and trim(claim) <> ''").withColumn("class_id", F.unhex(F.md5(F.concat_ws("\x1f", "claim", "caption"))))
    classes = rows.groupBy("class_id").agg(F.bool_or(F.col("side") == "train").alias("train"), F.bool_or(F.col("side") == "eval").alias("eval"), F.first("claim").alias("claim"), F.first("caption").alias("caption"))
    classes = materialize(classes)
    members = rows.select("class_id", "row_id", "side")
    of = lambda name: classes.where(name).select("class_id", "claim", "caption").mapInArrow(_digests, DIGESTS)
    of_train_keys, of_eval_keys = keyed(of("train"), of("eval"))
    shared = of_train_keys.withColumnRenamed("class_id", "a").join(of_eval_keys.withColumnRenamed("class_id", "b"), "digest").select("a", "b").distinct()
    text = classes.select("class_id", "claim", "caption")
    pairs = shared.join(text.select(F.col("class_id").alias("a"), F.col("claim").alias("claim_a"), F.col("caption").alias("caption_a")), "a")
    pairs = pairs.join(text.select(F.col("class_id").alias("b"), F.col("claim").alias("claim_b"), F.col("caption").alias("caption_b")), "b")
    found = pairs.mapInPandas(_check, "a binary, b binary, overlap double")
    of_train = members.where("side = 'train'").select(F.col("class_id").alias("a"), F.col("row_id").alias("train_row"))
    of_eval = members.where("side = 'eval'").select(F.col("class_id").alias("b"), F.col("row_id").alias("eval_row"))
    return found.join(of_train, "a").join(of_eval, "b").select("train_row", "eval_row", "overlap")


def report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Evaluation rows with an overlap, and pairs, by split and source of the evaluation row."""
    who = records.select(F.col("row_id").alias("eval_row"), "split", "source")
    return pairs.join(who, "eval_row").groupBy("split", "source").agg(F.count_distinct("eval_row").alias("rows"), F.count("*").alias("pairs"))
