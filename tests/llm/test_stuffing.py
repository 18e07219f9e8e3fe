import random

from pyspark.sql import functions as F

from factloom.llm import stuffing, stuffing_fit


def pages():
    rng = random.Random(1)
    names = [f"N{chr(97 + i)}ba" for i in range(26)]
    common = "the of a in and to with for".split()
    made = lambda n: "".join(rng.choice("bcdfglmnprst" if k % 2 == 0 else "aeiou") for k in range(n))
    words = [made(rng.randint(4, 8)) for _ in range(400)]
    prose = lambda n: " ".join(f"{made(7).capitalize()} {' '.join(rng.choice(common if k % 3 == 0 else words) for k in range(11))} {made(7).capitalize()}." for _ in range(n))
    spam = [
        ", ".join(f"{rng.choice(['buy', 'cheap', 'best', 'free'])} Kumbavec encoder" for _ in range(60)),
        "\n".join(f"https://{rng.choice('abc')}.example/x/{rng.randint(1, 999)}" for _ in range(20)),
        " ".join(f"#{rng.choice(names)}{rng.choice(['buy', 'free'])}" for _ in range(60)),
        "\n".join(f'<a href="http://a.test/{i}">{rng.choice(names[:4])}</a>' for i in range(20)),
        "\n".join(f"{rng.choice(names[:5])} set {rng.randint(1, 900)},00 SKU-{rng.randint(1, 9999)} {rng.choice(['buy', 'cheap'])}" for _ in range(30)),
        "Tags: " + " | ".join(f"{rng.choice(names[:5])} {rng.choice(['price', 'online'])}" for _ in range(50)),
    ]
    fine = [
        prose(12),
        "References\n" + "\n".join(f"[{i}] A. {rng.choice(names)} and B. {rng.choice(names)}{i}. {prose(1)} Annals, 20{i:02}. https://doi.example/10.9/{i}" for i in range(12)),
        prose(2) + "\n" + "\n".join(f"{n}-{i}\t{rng.random():.2f}\t{rng.random():.2f}" for i, n in enumerate(names)),
        prose(6) + "\nKeywords: encoder; decoder; encoder; reward model; parser; decoder; encoder",
        "Abbreviations\n" + "\n".join(f"{n.upper()}: a {rng.choice(words)} {rng.choice(words)} of {n}{i}." for i, n in enumerate(names)),
    ]
    return spam, fine, prose(1)


def test_spam_and_lookalikes():
    spam, fine, sentence = pages()
    for text in spam:
        for page in (text, f"{sentence}\n{text}", f"{text}\n{sentence}"):
            assert sum(stuffing.shares(page)[0][1:]) > 0.5, page[:80]
    for text in fine:
        assert sum(stuffing.shares(text)[0][1:]) <= 0.5, text[:80]


def test_piles_of_many_even_keywords():
    rng = random.Random(5)
    names = ["".join(rng.choice("bcdfglmnprst" if k % 2 == 0 else "aeiou") for k in range(7)) for _ in range(300)]
    for n in (90, 120, 300):
        for times in (4, 40):
            pile = [rng.choice(names[:n]) for _ in range(n * times)]
            assert stuffing.shares(" ".join(pile))[0][0] < 0.5, (n, times)
            assert stuffing.shares(" ".join(f"buy {w}" if i % 3 == 0 else w for i, w in enumerate(pile)))[0][0] < 0.5, (n, times)
    zipf = [1 / (i + 1) for i in range(300)]
    prose = " ".join(" ".join(rng.choices(names, zipf, k=12)).capitalize() + "." for _ in range(120))
    assert stuffing.shares(prose)[0][0] > 0.5


def test_odd_values(documents):
    spam, fine, _ = pages()
    df = documents(spam[0], None, "", " \n ", fine[0], spam[0], "one", spam[0] * 200).select("*", *[F.lit("q").alias(c) for c in ("k", "t", "prose", "stuffed")])
    got = {r.doc_id: r.stuffed for r in stuffing.judged(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False, 8: True}
    assert stuffing.judged(df.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    import itertools
    import math

    m = stuffing_fit.fitted()
    n = len(stuffing_fit.STATES)
    for observed in ([(0, 0, 0, 0, 1), (0, 0, 3, 2, 0), (2, 0, 0, 0, 0), (0, 0, 3, 0, 0)], [(0, 2, 1, 0, 0), (0, 0, 0, 2, 0), (0, 0, 3, 0, 0), (0, 0, 3, 0, 1)]):

        def score(path, observed=observed):
            total = m.start[path[0]]
            for t, s in enumerate(path):
                total += sum(f[b] for f, b in zip(m.emit[s], observed[t], strict=True))
                if t:
                    total += m.stay[s] if s == path[t - 1] else m.leave[path[t - 1]] + m.arrive[s]
            return total

        best = max(itertools.product(range(n), repeat=4), key=score)
        assert math.isclose(score(tuple(stuffing.states_of(observed))), score(best))


def test_the_chain_beats_single_lines():
    """On pages that weren't used to fit, labels of lines taken together are right more often than those of each line alone."""
    import dataclasses
    import math

    m, n = stuffing_fit.fitted(), len(stuffing_fit.STATES)
    alone = dataclasses.replace(m, start=(math.log(1 / n),) * n, stay=(math.log(1 / n),) * n, leave=(math.log(1 - 1 / n),) * n, arrive=(math.log(1 / (n - 1)),) * n)
    right, lines = {True: 0, False: 0}, 0
    for page in stuffing_fit.labelled(200, 99):
        seen, states = stuffing_fit.observed(page)
        lines += len(states)
        for together in right:
            got = stuffing.labels(seen, m if together else alone)
            right[together] += sum(a == stuffing_fit.LABEL_OF[s] for a, s in zip(got, states, strict=True))
    assert right[True] > 0.95 * lines and right[True] > right[False] + 0.03 * lines


def test_links_of_any_host():
    for host in ("store.de", "some-shop.co.uk", "news.io", "x1.example", "b-c.fr/a/9", "www.anything.zz", "https://q"):
        assert stuffing.known(host)[2], host
        assert stuffing.shares("\n".join(f"{host}" for _ in range(20)))[0][1] > 0.5, host
    for word in ("e.g.", "et.al", "main.py", "U.S.", "3.5", "end.The", "i.e.", "a@mail.de"):
        assert not stuffing.known(word)[2], word


def test_length_changes_no_rule():
    words = [f"{c}{v}word" for c in "bcdfgh" for v in "aeiou"]
    for n in (4, 6, 20, 80):
        assert stuffing.shares(", ".join(words * n))[0][2] > 0.9, n
