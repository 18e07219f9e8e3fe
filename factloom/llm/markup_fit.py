"""Fitting of the segment classifier: costs counted on a bounded sample of labelled texts.

The sample is written by a generator: TEXTS texts of invented words with constructs of HTML, Markdown, wiki
and LaTeX, and with the signs of plain text that look like them (comparisons, citations, stars of
significance, products, money, sets, absolute values, names with underscores, lines that break before a
sign). Every piece says whether it is content, markup, or boilerplate within markup. What is counted is how
often each code of a segment or of a construct is markup; a cost is a negative logarithm of that share.
"""

from __future__ import annotations

import functools
import math
import random
from collections import defaultdict

#: Size and seed of the labelled sample; what is added to every count; costs are integers, SCALE to a nat, at most MOST. A construct's
#: costs count twice: it stands for all its members, each of which sees a part of it only.
TEXTS, SEED, SMOOTHING, SCALE, MOST = 3000, 23, 0.5, 2.0, 14

Piece = tuple[str, bool]
Costs = dict[str, tuple[int, int]]


class Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.vocabulary = ["".join(rng.choice("bcdfglmnprst" if k % 2 == 0 else "aeiou") for k in range(rng.randint(2, 9))) for _ in range(80)]

    def words(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(low, high)))

    def name(self) -> str:
        return self.rng.choice(self.vocabulary).capitalize()

    def plain(self) -> str:
        rng, w = self.rng, self.words
        n, m = rng.randint(1, 99), rng.randint(1, 9)
        return rng.choice([
            lambda: f"With p < 0.0{m} and n > {n}, {w()}.", lambda: f"{w()}, <{n} {w()} or >{m}% of R&D {w()}.", lambda: f"{w()} et al. [{n}], {w()}.[{m}]", lambda: f"{w()}, * marks p < 0.05, ** p < 0.01. {w()}",
            lambda: f"{self.name()}*, i.e. {n}*{m}.5 in all, {self.name()}*, {w()}", lambda: f"{w()} ca. ${n} per {w()} and ${m} more.", lambda: f"{w()} {{low, mid, high}} {w()} |r| = 0.{n}.",
            lambda: f"{w()} {rng.choice(self.vocabulary)}_{rng.choice(self.vocabulary)} to {m} {w()}", lambda: f"issue #{n} {w()}", lambda: f"{w()}\n* marks p < 0.05", lambda: f"{w()}\n{n}. {self.name()} {w()}", lambda: f"{w()}\n> {n} {w()}",
            lambda: f"{w()}\n- {w()}", lambda: f"{w()} - {w()}", lambda: f"x = {n}; y == {m} {w()}", lambda: f"{w()} a * b {w()} c *", lambda: f"{w()}|{w()} | {w()}", lambda: f"{w()} (see [{n}]({m})) {w()}", lambda: f"‘{w()}’ {w()} '{w()}'",
            lambda: f"{self.name()}+*{m} {w()} *{w()}", lambda: f"{w()}.\n{n}. {self.name()}", lambda: f"{w()} A & B {w()}", lambda: f"{w()} _{w(1, 1)} {w()}", lambda: f"{w()} {n}*", lambda: f"{w()}. {self.name()}* {w()}",
        ])()

    def marked(self) -> list[Piece]:
        rng, w = self.rng, self.words
        around = lambda a, inner, b: [(a, True), (inner, False), (b, True)]
        tag = rng.choice(["p", "b", "i", "em", "div", "span", "h2", "sub", "sup", "td"])
        mark = rng.choice(["**", "**", "__", "*", "_", "*", "`", "~~", "'''", "''"])
        bullet = rng.choice(["- ", "* ", "+ ", "• ", "1. "])
        lead = rng.choice(["", "\n", f"{w()}:\n", f"{w()}.\n", ".\n\n"])
        items = [x for k in range(rng.randint(2, 4)) for x in ((f"{k + 1}. " if bullet == "1. " else bullet, True), (w(2, 5) + rng.choice(["", ".", ""]) + "\n", False))]
        cells = lambda bar, ends: (ends + bar.join(w(1, 2) for _ in range(3)) + ends[::-1], True)
        ends, bar = rng.choice([("| ", " | "), ("", " | ")])
        table = [(lead or "\n", False), cells(bar, ends), ("\n", False), (ends + bar.join(["---"] * 3) + ends[::-1], True), ("\n", False), cells(bar, ends), ("\n", False), cells(bar, ends), ("\n", False)]
        links = [x for _ in range(rng.randint(3, 6)) for x in (("<li>", True), (f'<a href="/{w(1, 1)}">', True), (w(1, 2), True), ("</a>", True), ("</li>", True))]
        return rng.choice([
            lambda: around(f"<{tag}>", w(), f"</{tag}>"), lambda: [("<br/>", True)], lambda: [(rng.choice(["&nbsp;", "&amp;", "&#8239;", "&lt;"]), True)], lambda: around(mark, w(1, 3), mark), lambda: around(mark, w(1, 3), mark), lambda: around("*", w(1, 2), "*"), lambda: around("*", w(1, 4), "*"), lambda: around("_", w(1, 4), "_"),
            lambda: [("\n# ", True), (w(1, 4) + "\n", False)], lambda: [(f"[{w(1, 2)}](https://{w(1, 1)}.example/{w(1, 1)})", True)], lambda: [(f"\n{w(1, 4).capitalize()}\n", False), (rng.choice(["=", "-"]) * rng.randint(3, 20), True), ("\n", False)],
            lambda: [("\n> ", True), (w(3, 8) + ".\n", False)], lambda: [(lead or "\n", False), *items], lambda: table, lambda: [(f"[[{w(1, 2)}|{w(1, 1)}]]", True)], lambda: [("\n== " + w(1, 3) + " ==\n", True)], lambda: [(f"{{{{cite|{w(1, 1)}}}}}", True)],
            lambda: [("\\emph", True), (f"{{{w()}}}", False)], lambda: [("\\begin", True), ("{itemize}\n", False), ("\\item", True), (f" {w()}\n", False), ("\\item", True), (f" {w()}\n", False), ("\\end", True), ("{itemize}", False)],
            lambda: [(f"$\\alpha_{{{rng.randint(1, 9)}}} \\pm {rng.randint(1, 9)}$", True)], lambda: [("X", False), ("_{\\mathrm{ref}}", True)], lambda: [("\n```", True), ("\nx = 1\n", False), ("```", True), ("\n", False)],
            lambda: [("<script>", True), (f"var {w(1, 1)} = {rng.randint(1, 9)}; {w()}", True), ("</script>", True)], lambda: [("<style>", True), (f".{w(1, 1)} {{color: red}} {w()}", True), ("</style>", True)],
            lambda: [("<nav>", True), ("<ul>", True), *links, ("</ul>", True), ("</nav>", True)], lambda: [("<nav>", True), (w(2, 5), True), ("</nav>", True)], lambda: [("<ul>", True), *links, ("</ul>", True)],
            lambda: [("<ul>", True), *[x for _ in range(3) for x in (("<li>", True), (w(2, 7), False), ("</li>", True))], ("</ul>", True)], lambda: [('<a href="/x">', True), (w(1, 3), False), ("</a>", True)],
        ])()


def text(rng: random.Random) -> list[Piece]:
    w = Writer(rng)
    out: list[Piece] = []
    for _ in range(rng.randint(1, 5)):
        out += [(w.plain() + " ", False)] if rng.random() < 0.6 else [*w.marked(), (" ", False)] if rng.random() < 0.6 else [(f"{w.words(3, 9)}. ", False)]
    if rng.random() < 0.2:  # cut off at its end
        whole = "".join(p for p, _ in out)
        keep = rng.randint(max(1, len(whole) - 25), len(whole))
        cut, n = [], 0
        for piece, label in out:
            cut.append((piece[: max(0, keep - n)], label))
            n += len(piece)
        out = [x for x in cut if x[0]]
    return out


def labelled(n: int, seed: int) -> list[list[Piece]]:
    rng = random.Random(seed)
    return [text(rng) for _ in range(n)]


def truth(pieces: list[Piece], parts: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each segment lies for the larger part in markup or boilerplate."""
    flags = [label for piece, label in pieces for _ in piece]
    return [2 * sum(flags[a:b]) > b - a for _, a, b in parts]


def fit(texts: list[list[Piece]]) -> Costs:
    from factloom.llm import markup

    of_constructs: set[str] = set()
    counts: dict[str, list[float]] = defaultdict(lambda: [SMOOTHING, SMOOTHING])
    for pieces in texts:
        whole = "".join(p for p, _ in pieces)
        parts = markup.segments(whole)
        marked = truth(pieces, parts)
        codes, members, _ = markup.graph(whole, parts)
        for i, code in enumerate(codes):
            inside = members[i - len(parts)] if i >= len(parts) else [i]
            if i >= len(parts):
                of_constructs.add(code)
            is_marked = 2 * sum(marked[j] for j in inside) > len(inside)
            counts[code][is_marked] += 1
    cost = lambda x, total, times: min(MOST, round(-SCALE * times * math.log(x / total)))
    times = lambda code: 2 if code in of_constructs else 1
    return {code: (cost(plain, plain + marked, times(code)), cost(marked, plain + marked, times(code))) for code, (plain, marked) in sorted(counts.items())}


@functools.lru_cache(maxsize=1)
def fitted() -> Costs:
    """The costs of the standing sample: the same everywhere and every time."""
    return fit(labelled(TEXTS, SEED))
