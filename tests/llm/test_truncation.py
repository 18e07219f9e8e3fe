import random

from pyspark.sql import functions as F

from factloom.llm import truncation as t

WHOLE = "The early decoder of the new model reaches a higher score on the large test set than all of the others do. A second sentence follows here."


def found(df):
    return {(r.row_id, r.field, r.why) for r in t.detect(df).collect()}


def test_prefix_of_a_longer_copy(gold):
    rows = [{"context": WHOLE, "source": "a"}, {"context": WHOLE[:60], "source": "a"}, {"context": WHOLE[: WHOLE.index(" A second")], "source": "b"}, {"context": WHOLE[: WHOLE.index(". A second")], "source": "b"}]
    assert found(gold(*rows)) == {(2, "context", "prefix")}  # whole sentences, with or without the final mark, aren't cut


def test_limits_are_learnt(gold):
    texts = [f"Entry {chr(65 + i) * 6} was measured again and again until the {i} readings of all the sensors did agree" for i in range(6)]
    rows = [{"caption": x + " with one another.", "source": "s"} for x in texts] + [{"caption": x[:60], "source": "s"} for x in texts]
    rows.append({"caption": "Nothing like it stands anywhere else in this table, and it is just so", "source": "s"})
    rows[-1]["caption"] = rows[-1]["caption"][:60]
    got = found(gold(*rows))
    assert {x for x in got if x[2] == "prefix"} == {(i, "caption", "prefix") for i in range(7, 13)} and (13, "caption", "limit") in got


def test_many_limits_of_one_source(gold):
    rng = random.Random(3)
    made = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(120))
    limits = range(60, 640, 41)  # 15 of them, each with a fifteenth of the cut values
    copies = [(made(), n) for n in limits for _ in range(4)]
    values = [x[: n - 1] + "e" + x[n:] + "." for x, n in copies] + [x[: n - 1] + "e" for x, n in copies] + [made()[: n - 1] + "e" for n in limits]
    rows = [{"caption": x, "source": "s"} for x in values]
    got = found(gold(*rows))
    assert {(i, "caption", "limit") for i in range(121, 136)} <= got and {(i, "caption", "prefix") for i in range(61, 121)} <= got


def test_prefix_that_looks_finished(gold):
    texts = [x + " and it was then shown to hold." for x in ("In the later and smaller study Sembaski et al. report a mixed ablation of the model", "The pool entries of the annotators were re-read ... and then kept", "The score of the new model rose by far (deeper range 70.2-78.8), etc., as in the rest", "Values are the mean over all of the runs (0.56)")]
    at = [texts[0].index(" report"), texts[1].index(".. and"), texts[2].index("8), etc"), texts[3].index("56)")]
    rows = [{"context": x} for x in texts] + [{"context": x[:k]} for x, k in zip(texts, at, strict=True)]
    assert [t.finished(x) for x in ("Sembaski et al.", "re-read .", "(70.2-78.", "(0.", "of 0.56.", "the [6].")] == [1, 1, 1, 1, 2, 2]
    assert found(gold(*rows)) == {(i, "context", "prefix") for i in range(5, 9)}


def test_broken_ends_and_odd_values(gold):
    rows = [{"context": "It ends in a broken charact�"}, {"context": "It was left off..."}, {"context": ""}, {"context": "  "}, {}, {"context": "Fine."}, {"context": "Fine."}, {"context": "x" * 200_000 + "."}]
    assert found(gold(*rows)) == {(1, "context", "broken"), (2, "context", "broken")}


def test_rates_and_empty(gold, spark):
    df = gold({"context": WHOLE, "source": "a"}, {"context": WHOLE[:60], "source": "a"}, {"context": "Good.", "source": None})
    got = {(r.source, r.field): (r.n_values, r.n_cut) for r in t.rates(t.detect(df), df).collect()}
    assert got == {("a", "context"): (2, 1), ("", "context"): (1, 0)}
    assert t.detect(df.limit(0)).count() == 0


def test_extra_columns(gold):
    df = gold({"context": WHOLE}, {"context": WHOLE[:60]})
    odd = df.select("*", *[F.lit("z").alias(c) for c in ("text", "field", "x", "prefix", "why", "tail", "step", "gram", "two")])
    assert found(odd) == {(2, "context", "prefix")}


def test_finished():
    assert [t.finished(x) for x in ("Done.", "See Fig.", "by J.", "at 74.", "asked: “Is it", "done.” [3]", "no mark", "好。", "X-S.")] == [2, 0, 0, 1, 0, 2, 0, 2, 2]


def test_steps_that_many_texts_share(gold, spark):
    """All texts share the short steps, and a third of them a template: values that stop there find their copies, and each step meets one row."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    template = "Comparison of the mean scores of all of the models that were"
    whole = [(f"{template} {word()} " if i % 3 == 0 else "") + " ".join(word() for _ in range(12)) + "." for i in range(6000)]
    cuts = [x[: rng.choice((3, 5, 7, 8, 12, 16, 20, 31, 32, 45, 66))] + rng.choice(("", "", "Q")) for x in whole[:1500]]
    rows = [{"caption": x} for x in whole + cuts]
    df = gold(*rows)
    texts = df.selectExpr("row_id", "'' as source", "'caption' as field", "caption as text")
    values = texts.mapInArrow(t._values, t.VALUE_SCHEMA).cache()
    ladder = texts.select("field", "text").mapInArrow(t._ladder, "prefix bigint, check bigint, shown string")
    asked = values.groupBy("prefix", "check").count()
    assert asked.count() == asked.select("prefix", "check").distinct().count()  # one row a step, however many texts share it
    got = {r.row_id for r in values.join(t.longer_copies(values.select(*t.VALUE, "tail"), ladder), t.VALUE).select("row_id").collect()}
    longer = {}
    for x in {t.squeezed(x["caption"]) for x in rows}:
        for k in range(1, len(x)):
            longer.setdefault(x[:k], []).append(x)
    brute = {i for i, x in enumerate(rows, 1) if any(not t.between(t.tail_of(v), y[len(v) :][:16]) for v in [t.squeezed(x["caption"])] for y in longer.get(v, []))}
    assert got == brute and len(got) > 700


def test_open_quotations_and_long_closing_markup():
    assert t.tail_of("He said “" + "word " * 60).startswith("“word") and len(t.tail_of("x" * 500)) == t.TAIL
    assert t.without_closing("It ends here." + "</b></i>" * 100) == "It ends here."
