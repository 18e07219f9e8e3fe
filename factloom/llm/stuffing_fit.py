"""Fitting of the line model: parameters counted on a bounded sample of labelled pages.

The sample is written by a generator: PAGES pages of invented words in several scripts, each a mixture of
prose (with tables, references and abbreviation lists, which count as prose), link lists, tag piles and
menus, with stray lines of another kind among them. What is counted: which label a page starts with, how
often a label is followed by itself or by another, and each feature's bins under each label.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from dataclasses import dataclass

#: Size and seed of the labelled sample, and what is added to every count.
PAGES, SEED, SMOOTHING = 400, 17, 2.0

Line = tuple[str, int]
#: States of the model, and the label each belongs to: prose has running text, such text without final marks, and harmless lists; tags have hash tags and keyword lists.
STATES = ("text", "unmarked", "listed", "links", "hashes", "keywords", "menu")
LABEL_OF = (0, 0, 0, 1, 2, 2, 3)
TEXT, UNMARKED, LISTED, LINKS, HASHES, KEYWORDS, MENU = range(7)
_ALPHABETS = [("bcdfghklmnprstvz", "aeiou"), ("бвгдзклмнпрстф", "аеиоу"), ("ابتدرسفكلمن", "اوي"), ("कगतदनपबमरलस", "ािुे")]
#: Scripts that don't part words; the second of them has no final marks.
_UNSPACED = [("".join(map(chr, range(0x4E00, 0x4E00 + 600))), "。"), ("".join(map(chr, range(0x0E01, 0x0E2F))), "")]
_ENDINGS = ("com", "net", "org", "de", "fr", "io", "info", "co.uk", "shop", "example", "test")
_LURES = ("buy", "cheap", "best", "free", "online", "price", "review", "near me", "download", "discount", "2031", "pdf", "купить", "kaufen", "gratis")


class Writer:
    """A page's vocabulary: function words that recur, content words by a Zipf law, names."""

    def __init__(self, rng: random.Random, unmarked: bool = False) -> None:
        self.rng = rng
        self.unspaced = _UNSPACED[unmarked or rng.random() < 0.75] if unmarked or rng.random() < 0.4 else None
        self.again = rng.uniform(0.3, 0.95)
        self.phrases = ["".join(rng.choice(self.unspaced[0]) for _ in range(rng.randint(4, 20))) for _ in range(25)] if self.unspaced else []
        consonants, vowels = rng.choice(_ALPHABETS)
        word = lambda n: "".join(rng.choice(consonants if k % 2 == 0 else vowels) for k in range(n))
        self.function = [word(rng.randint(1, 4)) for _ in range(25)]
        self.content = [word(rng.randint(4, 10)) for _ in range(500)]
        self.cumulated = list(itertools.accumulate(1 / (i + 3) for i in range(500)))
        self.names = [f"{word(6).capitalize()}{rng.choice(['', '', '-S', '-XL', ' 2'])}" for _ in range(rng.randint(3, 14))]
        self.hosts = [f"{word(7) if consonants[0] == 'b' else 'site' + str(rng.randint(1, 99))}.{rng.choice(_ENDINGS)}" for _ in range(rng.randint(2, 8))]
        self.lures = rng.sample(_LURES, rng.randint(2, 6))

    def sentence(self) -> str:
        rng = self.rng
        if self.unspaced:
            letters, mark = self.unspaced
            run = lambda: rng.choice(self.phrases) if rng.random() < self.again else "".join(rng.choice(letters) for _ in range(rng.randint(6, 30)))
            return f" {rng.choice(self.names)} ".join(run() for _ in range(rng.randint(1, 3))) + (f" {rng.random() * 90:.1f} {run()}" if rng.random() < 0.4 else "") + mark
        n = rng.randint(6, 24)
        words = [rng.choice(self.function) if rng.random() < 0.4 else rng.choices(self.content, cum_weights=self.cumulated)[0] for _ in range(n)]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = rng.choice(self.names)
        if rng.random() < 0.3:
            words[rng.randrange(n)] = f"{rng.random() * 100:.1f}"
        if rng.random() < 0.4:
            words[n // 2] += ","
        return " ".join(words).capitalize() + rng.choice(".....?!")

    def prose(self) -> list[Line]:
        state = UNMARKED if self.unspaced and not self.unspaced[1] else TEXT
        out = [(" ".join(self.sentence() for _ in range(self.rng.randint(1, 5))), state) for _ in range(self.rng.randint(1, 6))]
        if self.rng.random() < 0.3:  # a heading, or a line whose end is missing
            out.insert(0, (" ".join(self.sentence().rstrip(".?!").split()[: self.rng.randint(2, 12)]), UNMARKED))
        return out

    def listed(self) -> list[Line]:
        """Tables, references, abbreviations and dialogues: lists that aren't spam."""
        rng, kind = self.rng, self.rng.randrange(6)
        n = rng.randint(4, 25)
        if kind == 0:
            end = rng.choice(["https://{0}/10.9/{1}", "doi: 10.1000/{1}", "20{1:02}.", "pp. {1}-{1}5."])
            venue = f"{rng.choice(self.content).capitalize()} {rng.choice(self.function)} {rng.choice(self.content)}"
            return [("References", LISTED)] + [(f"[{i}] {rng.choice('ABCD')}. {rng.choice(self.content).capitalize()} {self.function[0]} {rng.choice('EFGH')}. {rng.choice(self.content).capitalize()}. {self.sentence()[:60].rstrip('.?!')}. {venue}, 20{i:02}. {end.format(rng.choice(self.hosts), i)}", LISTED) for i in range(1, n)]
        if kind in (1, 2):
            bar = rng.choice(["\t", " | ", "  ", "; "])
            first = self.names if kind == 1 else self.content
            return [(bar.join([rng.choice(first), *[f"{rng.random() * 90:.{rng.randint(0, 2)}f}" for _ in range(rng.randint(1, 5))], *([rng.choice(self.function)] if rng.random() < 0.3 else [])]), LISTED) for _ in range(n)]
        if kind == 3:
            link = rng.choice([": ", " - ", ", "])
            return [(f"{rng.choice(self.content).upper()[:4]}{link}{rng.choice(self.content)} {rng.choice(self.content)} {rng.choice(self.function)} {rng.choice(self.content)}{rng.choice(['.', ''])}", LISTED) for _ in range(n)]
        if kind == 4:
            return [(f"{rng.choice(self.names)}: {self.sentence()}", LISTED) for _ in range(n)]
        return [("Keywords: " + "; ".join(rng.choice([self.content, self.names])[:6]), LISTED), *self.prose()]

    def links(self) -> list[Line]:
        rng, kind, out = self.rng, self.rng.randrange(6), []
        url = lambda: f"{rng.choice(['https://', 'http://', 'www.', ''])}{rng.choice(self.hosts)}{rng.choice(['', '/', '/x'])}{rng.choice(['', str(rng.randint(1, 999))])}"
        for _ in range(rng.randint(5, 30)):
            name, lure = rng.choice(self.names), rng.choice(self.lures)
            line = [f"{url()}", f'<a href="http://{rng.choice(self.hosts)}/{rng.randint(1, 99)}">{name} {lure}</a>', f"- [{name} {lure}](https://{rng.choice(self.hosts)}/{rng.randint(1, 99)})", f"{name} >> {url()}", f"{name} {lure} | {url()} | {url()}", f"{' '.join([name] * rng.randint(1, 6))} {url()}"][kind]
            out.append((line, LINKS) if rng.random() > 0.06 else (f"{name} {rng.choice(self.content)}", LINKS))
        return out

    def tags(self) -> list[Line]:
        rng, kind = self.rng, self.rng.randrange(6)
        item = lambda: f"{rng.choice(self.names)} {rng.choice(self.lures)}" if rng.random() < 0.7 else f"{rng.choice(self.lures)} {rng.choice(self.names)}"
        n = rng.randint(20, 120)
        if kind == 0:
            return [(", ".join(item() for _ in range(n)), KEYWORDS)]
        if kind == 1:
            return [(" ".join(f"#{rng.choice(self.names).replace(' ', '')}{rng.choice(self.lures).replace(' ', '')}" for _ in range(n)), HASHES)]
        if kind == 2:
            return [("Tags: " + rng.choice([" | ", "; ", " · "]).join(item() for _ in range(n)), KEYWORDS)]
        if kind == 3:
            return [(" ".join(rng.choice(self.names) for _ in range(n)), KEYWORDS)]
        if kind == 4:  # keywords dressed up as sentences
            thing = f"{rng.choice(self.names)} {rng.choice(self.content)}"
            return [(" ".join(f"{rng.choice(self.lures).capitalize()} {thing} {rng.choice(self.lures)} {thing}." for _ in range(n // 4)), KEYWORDS)]
        return [(f"{item()}, {item()}, {item()}{rng.choice(['', '.'])}", KEYWORDS) for _ in range(n // 4)]

    def menu(self) -> list[Line]:
        rng = self.rng
        return [(f"{rng.choice(self.names)} {rng.choice(['set', 'item', 'kit'])} {rng.randint(1, 900)},00 {rng.choice(['SKU', 'Art.', 'No.'])}-{rng.randint(1, 9999)} {rng.choice(self.lures)}" if rng.random() < 0.9 else rng.choice(self.lures), MENU) for _ in range(rng.randint(10, 40))]


def page(rng: random.Random) -> list[Line]:
    """A page of labelled lines: one in ten is short and without final marks; of the others a third are prose, a third are spam, the rest have both."""
    if rng.random() < 0.1:  # short ones without final marks, where chance makes much of a line repeat
        return [(" ".join(x for w in [Writer(rng, unmarked=True)] for x in (w.sentence() for _ in range(rng.randint(2, 6)))), UNMARKED)]
    w = Writer(rng)
    spam = lambda: rng.choice((w.links, w.tags, w.menu))()
    fine = lambda: w.prose() if rng.random() < 0.5 else w.listed()
    kind = rng.randrange(3)
    if kind == 0:
        return [*fine(), *(fine() if rng.random() < 0.6 else []), *(fine() if rng.random() < 0.4 else [])]
    if kind == 1:
        return [*([(w.sentence(), TEXT)] if rng.random() < 0.4 else []), *spam(), *([(w.sentence(), TEXT)] if rng.random() < 0.3 else [])]
    return [*fine(), *spam(), *(fine() if rng.random() < 0.5 else [])]


def labelled(n: int, seed: int) -> list[list[Line]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]


@dataclass(frozen=True)
class Model:
    """Log-probabilities: start[s]; stay[s]; leave[s] and arrive[t] for a change from s to t; emit[s][f][bin]."""

    start: tuple[float, ...]
    stay: tuple[float, ...]
    leave: tuple[float, ...]
    arrive: tuple[float, ...]
    emit: tuple[tuple[tuple[float, ...], ...], ...]


def observed(lines: list[Line]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Feature bins and states of a page's lines as the model sees them: long lines are cut, features are the whole page's."""
    from factloom.llm import stuffing

    cut, labels = [], []
    for text, label in lines:
        pieces = stuffing.lines_of(text)
        cut += pieces
        labels += [label] * len(pieces)
    return stuffing.features(cut)[0], labels


def fit(pages: list[list[Line]]) -> Model:
    from factloom.llm import stuffing

    states, sizes = len(STATES), [len(e) + 1 for e in stuffing.BINS.values()]
    start, arrive = [SMOOTHING] * states, [SMOOTHING] * states
    stay, leave = [SMOOTHING] * states, [SMOOTHING] * states
    emit = [[[SMOOTHING] * n for n in sizes] for _ in range(states)]
    for lines in pages:
        seen, labels = observed(lines)
        for t, (bins, s) in enumerate(zip(seen, labels, strict=True)):
            for f, b in enumerate(bins):
                emit[s][f][b] += 1
            if t == 0:
                start[s] += 1
            elif labels[t - 1] == s:
                stay[s] += 1
            else:
                leave[labels[t - 1]] += 1
                arrive[s] += 1
    share = lambda xs: tuple(math.log(x / sum(xs)) for x in xs)
    return Model(share(start), tuple(math.log(a / (a + b)) for a, b in zip(stay, leave, strict=True)), tuple(math.log(b / (a + b)) for a, b in zip(stay, leave, strict=True)), share(arrive), tuple(tuple(share(f) for f in s) for s in emit))


@functools.lru_cache(maxsize=1)
def fitted() -> Model:
    """The model of the standing sample: the same everywhere and every time."""
    return fit(labelled(PAGES, SEED))
