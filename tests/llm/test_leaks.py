import random

from pyspark.sql import functions as F

from factloom.llm import leaks

VOCABULARY = [f"word{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def brute(records, docs):
    """Pairs that share 30 consecutive words of a context or claim, or a whole shorter claim."""
    out = set()
    for key, claim, context in records:
        for t, whole in ((context, False), (claim, True)):
            w = (t or "").lower().split()
            need = min(30, len(w)) if whole else 30
            spans = {" ".join(w[i : i + need]) for i in range(len(w) - need + 1)} if 0 < need <= len(w) else set()
            out |= {(key, d) for d, x in docs for s in spans if f" {s} " in f" {' '.join((x or '').lower().split())} "}
    return out


def test_against_brute_force(gold, spark):
    rng = random.Random(1)
    records, docs = [], []
    for i in range(60):
        records.append((f"c{i}", text(rng, rng.choice([3, 8, 16, 20, 35])), text(rng, rng.choice([10, 29, 30, 60, 120]))))
    for d in range(80):
        body = text(rng, 60)
        if d % 2:
            key, claim, context = rng.choice(records)
            w = rng.choice([claim, context]).split()
            n = rng.choice([12, 29, 30, 31, len(w)])
            at = rng.randint(0, max(0, len(w) - n))
            body = f"{text(rng, rng.randint(0, 9))} {' '.join(w[at : at + n]).upper()} {text(rng, rng.randint(0, 9))}"
        docs.append((d, body))
    g = gold(*[{"claim_id": k, "claim": a, "context": b} for k, a, b in records])
    got = {(r.claim_id, r.doc_id) for r in leaks.leaked(g, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(records, docs) and len(got) > 15


def test_what_does_not_count(gold, documents):
    words = [f"unit{i}" for i in range(32)]
    g = gold({"claim_id": "a", "context": " ".join(words)}, {"claim_id": "b", "context": " ".join(words)}, {"claim_id": None, "context": " ".join(words)}, {"claim_id": "n"}, {"claim_id": "e", "context": "", "claim": " - "})
    marked = "<p>" + ",\n".join(w.title() for w in words[:30]) + " -- .</p>"
    docs = documents(marked, " ".join(words[:29]), None, "", " ".join(words[:15] + ["other"] + words[15:]))
    assert {(r.claim_id, r.doc_id) for r in leaks.leaked(g, docs).collect()} == {("a", 1), ("b", 1)}
    assert leaks.leaked(g.limit(0), docs).count() == 0 and leaks.leaked(g, docs.limit(0)).count() == 0


def test_markup_within_the_record(gold, documents):
    words = [f"unit{i}" for i in range(36)]
    marked = [*words]
    marked[5], marked[10], marked[15], marked[20], marked[25] = "[[Unit (model)|unit5]]", "unit10<ref>no. 4</ref>", "[unit15](https://a.example/b)", "\\emph{unit20}~\\cite{k1}", "unit25{{cite|k}}"
    g = gold({"claim_id": "a", "context": " ".join(marked)})
    assert leaks.leaked(g, documents(" ".join(words))).count() == 1


def test_passages_within_notes(gold, documents):
    words = [f"unit{i}" for i in range(36)]
    passage, chars = " ".join(words), "".join(chr(0x4E00 + 7 * i) for i in range(70))
    g = gold({"claim_id": "a", "context": passage}, {"claim_id": "z", "context": chars})
    held = [f"b {{{{quote|{passage}}}}} d", f"b {{{{quote |text={passage}|by=x}}}} d", f"b<ref name='k'>{passage}</ref> d", f"b <!--{passage}--> d", f"b ![{passage}](f.png) d", f'b <img src="f.png" alt="{passage}"/> d', f"b &lt;!-- {passage} --&gt; d"]
    around = " ".join(words[:15]) + "<ref>no. 4</ref> <!-- x y --> {{cite|k}} " + " ".join(words[15:])
    got = {(r.claim_id, r.doc_id) for r in leaks.leaked(g, documents(*held, around, f"前{{{{引|{chars}}}}}后", f"b <!--{' '.join(words[:29])}--> d")).collect()}
    assert got == {("a", i) for i in range(1, 9)} | {("z", 9)}


def test_scripts_without_spaces(gold, documents):
    rng = random.Random(2)
    chars = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(90))
    g = gold({"claim_id": "z", "context": chars}, {"claim_id": "s", "claim": chars[:25]})
    docs = documents("前" + "，".join([chars[5:40], chars[40:66]]) + "后", chars[:59], "x" + chars[:26])
    assert {(r.claim_id, r.doc_id) for r in leaks.leaked(g, docs).collect()} == {("z", 1), ("s", 2), ("s", 3)}


def test_extra_columns_and_report(gold, documents):
    words = " ".join(f"unit{i}" for i in range(40))
    g = gold({"claim_id": "a", "context": words, "split": "test", "paper_id": "p"}).select("*", *[F.lit(1).alias(c) for c in ("key", "text", "whole", "need", "hash", "x", "doc_id")])
    docs = documents(words, words).select("*", F.lit(2).alias("hash"), F.lit(3).alias("candidates"), F.lit("q").alias("claim_id"))
    got = leaks.leaked(g, docs)
    assert {(r.claim_id, r.doc_id) for r in got.collect()} == {("a", 1), ("a", 2)}
    r = leaks.report(got, g.drop("doc_id")).first()
    assert (r.split, r.paper_id, r.records, r.documents) == ("test", "p", 1, 2)


def test_winnowing_guarantee():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 50, 40).astype(np.uint64)
        at = set(leaks.winnow(h, 6).tolist())
        assert all(at & set(range(i, i + 6)) for i in range(35))


def test_a_set_phrase_of_a_third_of_both_sides(gold, documents, spark):
    """A phrase too short to be a leak stands in many records and documents; they don't meet for it, and the leaks among them are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    phrase = some(14)
    contexts = [f"{some(20)} {phrase if i % 3 == 0 else ''} {some(25)}" for i in range(300)]
    pages = [f"{some(40)} {phrase if i % 3 == 0 else ''} {some(40)}" for i in range(300)]
    leaks_at = {i: (i * 7) % 300 for i in range(0, 300, 11)}
    for doc, rec in leaks_at.items():
        pages[doc] += " " + " ".join(contexts[rec].split()[6:40])
    df = gold(*[{"claim_id": str(i), "context": c, "split": "test"} for i, c in enumerate(contexts)])
    docs = documents(*pages)
    got = {(r.claim_id, r.doc_id) for r in leaks.leaked(df, docs).collect()}
    assert got == {(str(rec), doc + 1) for doc, rec in leaks_at.items()}
    streams = [leaks.words(t) for t in pages]
    owner, hashes, at, before, after = leaks.fingerprints(streams, "w")
    ro, rh, ra, rb, rf = leaks.fingerprints([leaks.words(t) for t in contexts], "w")
    plain = {(o, r) for o, h in zip(owner, hashes, strict=True) for r, g in zip(ro, rh, strict=True) if h == g} if len(hashes) * len(rh) < 5e7 else set()
    keyed: dict = {}
    for r, h, b, f in zip(ro, rh, rb, rf, strict=True):
        for key in ((h, "b", b), (h, "a", f)):
            if key[2]:
                keyed.setdefault(key, set()).add(r)
    met = {(o, r) for o, h, b, f in zip(owner, hashes, before, after, strict=True) for key in ((h, "b", b), (h, "a", f)) if key[2] for r in keyed.get(key, ())}
    assert len(met) < 3 * len(leaks_at) + 100 and (not plain or len(plain) > 50 * len(met) or len(plain) > 9_000)
