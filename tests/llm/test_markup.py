import pytest
from pyspark.sql import functions as F

from factloom.llm import markup, markup_fit

MARKED = [
    "<p>One two.</p>", "one<br/>two", "a &nbsp;b", "x&#8239;&lt;3", "a **bold** word", "a __bold__ word", "in __词__上", "a `code` b", "~~old~~ new", "# Title\n\ntext", "see [it](https://a.example/b)",
    "![alt](f.png)", "> quoted line", "First.\n- one\n- two", "a:\n* one\n* two", "| a | b |\n|---|---|\n| 1 | 2 |", "[[Page (model)|Page]]", "'''bold''' text", "''it'' text", "== Title ==\ntext",
    "x{{cite|a1}} y", "{| class=\"w\"\n|-\n| a || 2\n|}", "a\\emph{b} c", "{\\it b} c", "\\section{A}\nb", "\\begin{itemize}\n\\item a\n\\end{itemize}", "n ($\\alpha_{2} \\pm 4$) b", "$$ x^{2} \\leq y $$", "X_{\\mathrm{ref}} y", "done.<ref>no. 5</ref>", "```\nx = 1\n```", "a cut off <span cl", "a cut N&nbs", "see [it](https://a.exam", "a cut [[Pag", "the name **Foo", "an *emphasised phrase* here", "A title\n=======\n\ntext", "Another\n---\ntext", "see:\n\nA | B\n--- | ---\n1 | 2\n",
]
PLAIN = [
    "With p < 0.01 and n > 6, it holds", "Here, <7 steps or ~24% of the R&D budget suffice", "as in A et al. [6], it is.[12]", "percent, * marks p < 0.05. Runs", "A-mini*, i.e. 2*65.7 in all, B*, i.e. 3*4", "costs ca. $6 per run and $7 more",
    "Arms {low, mid, high} show |r| = 4.5 here", "setting learning_rate to 5 and max_len", "issue #523 and #1 here", "in percent,\n* marks p < 0.05", "Am\n18. März kam", "and n\n> 6, the rest", "a - b\nc - d", "", "plain", "x = 5; y == z", "the R&", "the R&D", "a & b", "a [6](",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.has_markup(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_not(text):
    assert not markup.has_markup(text) and markup.clean(text) == text


def test_structure_is_kept():
    c = markup.clean
    assert c("<h2>Title</h2><p>A &amp; B</p><ul><li>one</li><li>two</li></ul>") == "## Title\n\nA & B\n\n- one\n- two"
    assert c("\\section{A}\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}") == "# A\n- one\n- two"
    assert c("== Head ==\n'''x''' [[P (m)|P]]{{cite|k}}") == "## Head\nx P"
    assert c("a [it](http://b) `x` ($\\pm 4$)") == "a it `x` ($\\pm 4$)"
    assert c("```\nx = <b>\n```") == "```\nx = <b>\n```"
    assert c("\\emph{a \\textbf{b}} c \\cite{k}d") == "a b c d"
    assert c("a\n\\begin{equation}\ny_{8} = \\frac{1}{9} y_i\n\\end{equation}\nb") == "a\n$$\ny_{8} = \\frac{1}{9} y_i\n$$\nb"
    assert c("a:\n\n| x | n |\n|---|---|\n| y | 4 |") == "a:\n\n| x | n |\n| y | 4 |"
    assert c("{| class=\"w\"\n|-\n| a || 2\n|}\nb") == "a | 2\nb"
    assert c("in {\\it Foo} and {a, b} \\emph{x}") == "in Foo and {a, b} x"
    assert c(None) is None


def test_headings_tables_and_items_of_other_forms():
    c = markup.clean
    assert c("A title\n=====\n\ntext\n\nNext\n----\nmore") == "# A title\n\ntext\n\n## Next\nmore"
    assert c("a:\n\nA | B\n--- | ---\n1 | 2\n\nb") == "a:\n\nA | B\n1 | 2\n\nb"
    assert c("\\begin{itemize}\n\\item a\\item b\n\\end{itemize}") == "- a\n- b"
    assert c("an *emphasised phrase* and A*, i.e. 2*65.7, it is") == "an emphasised phrase and A*, i.e. 2*65.7, it is"


def test_boilerplate_goes_with_its_block():
    c = markup.clean
    assert c("<p>One two.</p><script>var x = 1;</script><style>.a {b: c}</style><p>Three.</p>") == "One two.\n\nThree."
    menu = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>News</a></li></ul></nav>"
    assert c(f"{menu}<p>The text.</p>") == "The text." and c(menu.replace("nav", "div") + "<p>The text.</p>") == "The text."
    assert c("<ul><li>one thing</li><li><a href='/x'>another</a> thing</li><li>third</li></ul>") == "- one thing\n- another thing\n- third"
    assert c("Text first. <script>var x = 1; cut off") == "Text first."


def test_the_cut_beats_single_segments():
    """On texts that weren't used to fit, segments labelled together are right more often than each by its own costs."""
    table, n = markup_fit.fitted(), 0
    right = {True: 0, False: 0}
    for pieces in markup_fit.labelled(400, 77):
        text = "".join(p for p, _ in pieces)
        parts = markup.segments(text)
        true = markup_fit.truth(pieces, parts)
        n += sum(k != "words" for k, *_ in parts)
        for cut in right:
            right[cut] += sum(x[3] == t for x, t in zip(markup.labelled(text, table, cut), true, strict=True) if x[0] != "words")
    assert right[True] > 0.975 * n and right[True] > right[False] + 0.02 * n


def test_long_texts_take_time_in_proportion():
    import time

    for unit in ("* a\n", "**b ", "<b>x ", "a_b *c ", "| a | b |\n", "1. x\n", "<p>w</p>"):
        took = []
        for n in (1_000, 4_000):
            began = time.perf_counter()
            markup.has_markup(unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5, unit


def test_formulas_stay_as_they_are():
    c = markup.clean
    long = "$" + " + ".join(f"\\alpha_{{{i}}} x^{{{i}}}" for i in range(40)) + "$"
    plain = "$" + " + ".join(f"a_{i % 10} b" for i in range(40)) + "$"
    for formula in ("\\(\\frac{a}{b}\\)", "\\[ x_{1} \\\\[2pt] \\text{if \\(y\\)} \\]", "\\[\n\\sum_{i} x_i\n\\]", "$\\alpha +\n\\beta_{2}$", "$2 \\alpha\n+ b$", long, plain):
        assert c(f"a <b>x</b> {formula} y \\emph{{z}}") == f"a x {formula} y z"
    assert c("costs $6\nand \\emph{x} for $7 \\(") == "costs $6\nand x for $7"
    assert c("costs $6 and \\emph{x}\n\nfor US$ b") == "costs $6 and x\n\nfor US$ b"


def test_minimum_cut_against_all_labellings():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 7)
        unary = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda side: sum(u[1] if s else u[0] for u, s in zip(unary, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        assert cost(markup.min_cut(unary, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_values_of_a_table(gold):
    df = gold({"caption": "<b>x</b>", "context": "plain"}, {"context": "a **b** c", "caption": None}, {}, {"caption": "", "context": "p < 3"}, {"caption": "<b>x</b>"}, {"context": "[6] " * 30_000 + "<i>z</i>"})
    df = df.select("*", *[F.lit("q").alias(c) for c in ("k", "x", "field", "text", "clean_text")])
    got = {(r.row_id, r.field, (r.clean_text or "")[-5:]) for r in markup.residue(df, cleaned=True).collect()}
    assert got == {(1, "caption", "x"), (2, "context", "a b c"), (5, "caption", "x"), (6, "context", "[6] z")}
    assert markup.residue(df.limit(0)).count() == 0
