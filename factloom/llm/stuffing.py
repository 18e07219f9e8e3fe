"""Keyword-stuffed and link-list pages, by labelling lines with a hidden Markov model.

A page is cut into lines, and long lines into stretches of some words. Each line gets a few discrete
features (share of links, of hash tags, of words the page keeps repeating, of separators and of short
items), whose likelihoods under each label, like the chances of a label to go on or to change, are fitted on
a bounded labelled sample (`stuffing_fit`). Labels stick to their neighbours, so Viterbi smooths over a stray prose-like line within a list and a stray list-like line within prose. A page is
flagged if the words of lines labelled other than prose are more than half of its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.stuffing_fit import LABEL_OF, Model, fitted

LABELS = ("prose", "links", "tags", "menu")
#: Words of a line beyond which it is cut (at a sentence end if there is one near, else anywhere).
STRETCH = 24
#: A word is repeated if the page has it twice at least and it makes up REPEATED_SHARE of the page's words.
REPEATED_SHARE = 0.012
#: Words below that share are repeated too, from twice on, if the page's words recur so many times on average and evenly (entropy against
#: that of equal counts), or if those below the share do on a page where no more than ENDED_SHARE of the lines end with a final mark.
RECURRING, EVEN, ENDED_SHARE = 3, 0.95, 0.2
FLAGGED_SHARE = 0.5
#: Edges of the feature bins.
BINS = {"links": (0.12, 0.3), "hash": (0.15, 0.5), "repeated": (0.55, 0.75, 0.9), "items": (0.12, 0.3), "final": (1,)}

#: Hosts without a protocol end in a country's two letters or a common ending, in small letters; endings of program files aren't countries.
HOST = r"(?<![\w.@])[a-z0-9](?:[\w-]*\w)?(?:\.[\w-]+)*\.(?:(?!(?:py|js|md|rs|sh|ts|cc|hs|pl|ps|so|gz|al)\b)[a-z]{2}|com|net|org|edu|gov|info|biz|shop|store|online|site|website|blog|app|dev|xyz|club|top|live|news|test|example|invalid|localhost)(?![\w.-]*\w)(?:/\S*)?"
URL = re.compile(r"(?:https?://|www\.)\S+|" + HOST, re.I)
HREF = re.compile(r"<a\s[^>]*>(.*?)</a>|\[([^\]\n]*)\]\(\s*(?:https?:|www\.|//)[^)\s]*\)", re.I | re.S)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
CITED = re.compile(r"\bdoi\b|\bet al\b|^\s*\[\d+\]", re.I)
SEPARATOR = re.compile(r"[|;•·»›>]+|,(?!\d)")
FINAL = re.compile(r"(?<=[.!?。！？।؟])[\"”»’)\]]*\s+|(?<=[。！？])")
ENDED = re.compile(r"[.!?。！？।؟][\"”»’)\]]*$")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]+")
TRIM = re.compile(r"^[\W_]+|[\W_]+$")
PART = re.compile(r"\w+")
LINK = "\x00link"


def lines_of(text: str) -> list[list[str]]:
    """The page's lines as lists of words; links are single words, long lines are cut."""
    text = HREF.sub(lambda m: f" {LINK}{'x' * len(PART.findall(m[0]))} ", text)
    out = []
    for line in TAG.sub(" ", text).splitlines():
        words = line.split()
        if not words:
            continue
        if len(words) <= STRETCH:
            out.append(words)
            continue
        stretch: list[str] = []
        for sentence in FINAL.split(line):
            words, at = sentence.split(), 0
            while at < len(words):
                room = STRETCH - len(stretch)
                if stretch and len(words) - at > room and len(stretch) >= STRETCH // 3:
                    out.append(stretch)
                    stretch, room = [], STRETCH
                stretch = stretch + words[at : at + room]
                at += room
                if len(stretch) >= STRETCH:
                    out.append(stretch)
                    stretch = []
        if stretch:
            if len(stretch) < 6 and out:
                out[-1] = out[-1] + stretch
            else:
                out.append(stretch)
    return out


def weight(word: str) -> float:
    """How many words this is: a link has as many as it is spelled with, two letters of an unspaced script count as one."""
    if word.startswith(LINK):
        return max(1.0, len(word) - len(LINK))
    if URL.search(word):
        return float(len(PART.findall(word)))
    m = UNSPACED.findall(word)
    return 1.0 if not m else max(1.0, sum(map(len, m)) / 2)


#: What is known of a word: its key (empty for links and words with digits), its weight, whether it is a link, whether it is a tag.
Known = tuple[str, float, bool, bool]
CACHE_ENTRIES = 1 << 18
_known: dict[str, Known] = {}


def known(word: str) -> Known:
    key = TRIM.sub("", word).casefold()
    link = word.startswith(LINK) or (("." in word or "://" in word) and URL.search(word) is not None)
    plain = "" if word.startswith(LINK) or any(map(str.isdigit, key)) else key
    out = (plain, weight(word), link, word[0] == "#" and len(word) > 2 and not word[1:].isdigit())
    if len(word) <= 40:
        if len(_known) >= CACHE_ENTRIES:
            _known.clear()
        _known[word] = out
    return out


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum([value >= e for e in edges])


def piled(counts: list[int], words: int) -> bool:
    """So many even counts are those of a pile of keywords, not of a text's rarer words, half of which stand there once."""
    n = sum(counts)
    if n < RECURRING * len(counts) or 2 * n < words:
        return False
    return math.log(n) - sum([c * math.log(c) for c in counts]) / n >= EVEN * math.log(len(counts))


def features(lines: list[list[str]]) -> tuple[list[tuple[int, ...]], list[float]]:
    """The feature bins and the weight of every line."""
    get = _known.get
    facts = [[get(w) or known(w) for w in words] for words in lines]
    counts = Counter([k[0] for line in facts for k in line])
    counts.pop("", None)
    total = sum(counts.values())
    least = max(2, REPEATED_SHARE * total)
    often = {w for w, n in counts.items() if n >= least}
    if len(often) < len(counts):
        words = sum(map(len, lines))
        few_ended = sum([ENDED.search(line[-1]) is not None for line in lines]) <= ENDED_SHARE * len(lines)
        if piled([*counts.values()], words) or few_ended and piled([n for n in counts.values() if n < least], words):
            often = {w for w, n in counts.items() if n >= 2}
    out, weights = [], []
    for words, line in zip(lines, facts, strict=True):
        n = len(words)
        raw = " ".join(words)
        link = sum([k[2] for k in line])
        if link and CITED.search(raw):
            link = 0
        texts = [k[0] for k in line if k[0]]
        again = sum([k in often for k in texts]) / len(texts) if len(texts) > 1 else 0.0
        out.append((_bin(link / n, BINS["links"]), _bin(sum([k[3] for k in line]) / n, BINS["hash"]), _bin(again, BINS["repeated"]), _bin(len(SEPARATOR.findall(raw)) / n, BINS["items"]), int(ENDED.search(raw[-8:]) is not None)))
        weights.append(sum([k[1] for k in line]))
    return out, weights


def states_of(observed: list[tuple[int, ...]], model: Model | None = None) -> list[int]:
    """The most likely states of the lines together (Viterbi); ties go to the earlier state."""
    m = model or fitted()
    states = range(len(LABEL_OF))
    score = list(m.start)
    back = []
    known: dict[tuple[int, ...], list[float]] = {}
    for t, o in enumerate(observed):
        emit = known.get(o)
        if emit is None:
            emit = known[o] = [sum([f[b] for f, b in zip(m.emit[s], o, strict=True)]) for s in states]
        if t:
            left = [a + b for a, b in zip(score, m.leave, strict=True)]
            best = max(states, key=left.__getitem__)
            second = max([s for s in states if s != best], key=left.__getitem__)
            came, new = [], []
            for s in states:
                source = second if s == best else best
                moved, stayed = left[source] + m.arrive[s], score[s] + m.stay[s]
                came.append(s if stayed >= moved else source)
                new.append(max(stayed, moved))
            back.append(came)
            score = new
        score = [a + b for a, b in zip(score, emit, strict=True)]
    if not observed:
        return []
    path = [max(states, key=score.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def labels(observed: list[tuple[int, ...]], model: Model | None = None) -> list[int]:
    """The label of every line."""
    return [LABEL_OF[s] for s in states_of(observed, model)]


def shares(text: str, model: Model | None = None) -> tuple[list[float], int]:
    """Share of the page's words under each label, and the number of its lines."""
    lines = lines_of(text)
    got = [0.0] * len(LABELS)
    observed, weights = features(lines)
    for w, label in zip(weights, labels(observed, model), strict=True):
        got[label] += w
    total = sum(got)
    return [x / total for x in got] if total else got, len(lines)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines, prose, links, tags, menu, stuffed): word share of each label, and whether the page is flagged.

    One narrow pass. A null, empty or blank text has no lines, shares of 0 and isn't flagged. Every row is judged for
    itself, repeated rows alike; other columns are not read. The model is fitted once, on the driver.
    """
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shares(x, model) if x else ([0.0] * 4, 0) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[0][i] for r in rows], pa.float64()) for i in range(4)]
            flag = pa.array([sum(r[0][1:]) > FLAGGED_SHARE for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int32()), *columns, flag], names=["k", "lines", *LABELS, "stuffed"])

    pruned = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = pruned.schema["k"].dataType.simpleString()
    return pruned.mapInArrow(run, f"k {kind}, lines int, prose double, links double, tags double, menu double, stuffed boolean").withColumnRenamed("k", key)
