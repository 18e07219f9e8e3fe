import random

from pyspark.sql import functions as F

from factloom.llm import overlap

CLAIM = "According to Fig. 7b, the decoder in the Gelbamark group outperforms Gelbarank-R by 36.3 points after 11 weeks."
CAPTION = "Table 9: Comparison of the robust loss curve on Zonbapanel-QA, averaged over 31 folds."


def pairs(df):
    return {(r.train_row, r.eval_row) for r in overlap.cross_split(df).collect()}


def row(split, claim=CLAIM, caption=CAPTION):
    return {"split": split, "claim": claim, "caption": caption}


def test_same_and_almost(gold):
    df = gold(
        row("train"), row("test"), row("dev", CLAIM.upper(), CAPTION.lower()), row("test", CLAIM.replace("outperforms", "is better than"), CAPTION.replace("Comparison", "Compairson").replace("the ", "", 1)),
        row("test", CLAIM.replace("36.3", "36.4")), row("test", CLAIM.replace("Gelbarank-R", "Hombanet-R")), row("dev", caption=None), row("train"), row(None), row("other"), {"split": "test"}, {"split": "train"},
    )
    assert pairs(df) == {(a, b) for a in (1, 8) for b in (2, 3, 4)}


def test_null_caption_is_like_an_empty_one(gold):
    assert pairs(gold(row("train", caption=None), row("test", caption=""), row("test", caption="other text here"))) == {(1, 2)}
    assert pairs(gold(row("train")).limit(0)) == set()


def test_hot_record_and_extra_columns(gold):
    df = gold(*[row("train") for _ in range(30)], *[row("test") for _ in range(20)])
    assert len(pairs(df.select("*", *[F.lit(1).alias(c) for c in ("class_id", "digest", "side", "a", "b", "size")]))) == 600


def test_alike():
    assert overlap.alike("Removing the baseline from X-1 limits it", "Remvoing the baseline X-1 limits it")
    assert not overlap.alike("We saw Nolbabert win here", "We saw Hirbaprop win here")
    assert not overlap.alike("It is 5 of 6", "It is 5 of 7") and overlap.alike(None, "") and not overlap.alike("a b c d e f", None)


def test_nouns_with_capitals_are_no_names():
    german = "Ohne die kleinere Verlustkurve fällt Sorbagate-2 auf 0,74 zurück, mehr als Disbaprop je Wurzelmasse bei 576 Läufen"
    for a, b in (("Verlustkurve", "Verlustkuve"), ("Wurzelmasse", "Wurzellmasse"), ("Läufen", "Laufen"), ("kleinere Verlustkurve", "geringere Einbuße"), ("bei 576 Läufen", "in 576 Durchgängen")):
        assert overlap.alike(german, german.replace(a, b)), b
    for a, b in (("Disbaprop", "Rutbarank"), ("Sorbagate-2", "Sorbagat-2"), ("Disbaprop", "Distaprof"), ("576", "577")):
        assert not overlap.alike(german, german.replace(a, b)), b
    title = "Comparison of the Robust Loss Curve on Zonbapanel, Averaged over All Folds"
    assert overlap.alike(title, title.replace("Robust", "Robst")) and not overlap.alike(title, title.replace("Zonbapanel", "Hirbaprop"))
    assert not overlap.alike("We saw that Rumbacore wins here", "We saw that Rumbacor wins here")


def test_chunks_cover_the_text():
    text = "abc def ghi jkl mno pqr stu vwx yz " * 7
    assert "".join(overlap.chunks(text)) == text and "".join(overlap.chunks("ab")) == "ab" and overlap.chunks("") == []
    moved = overlap.chunks("some words before " + text)
    assert len(set(moved) & set(overlap.chunks(text))) >= len(set(overlap.chunks(text))) - 3


def test_report(gold):
    df = gold(row("train"), {**row("test"), "source": "s"}, {**row("test"), "source": "s"})
    r = overlap.report(overlap.cross_split(df), df).first()
    assert (r.split, r.source, r.rows, r.pairs) == ("test", "s", 2, 2)


def sides(df):
    for condition in ("split = 'train'", "split <> 'train'"):
        yield df.where(condition).selectExpr("cast(cast(row_id as string) as binary) as class_id", "claim", "caption").mapInArrow(overlap._digests, overlap.DIGESTS)


def test_a_phrase_of_a_third_of_both_sides(gold, spark):
    """Records without numbers share a phrase: they aren't looked up by it, and the near ones among them are found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    phrase = some(6)
    made = lambda i: {"claim": f"{some(16)} {phrase if i % 3 == 0 else ''} {some(10)}", "caption": some(8)}
    rows = [made(i) | {"split": "train" if i % 2 else "dev"} for i in range(600)]
    near = {}
    for i in range(0, 600, 30):
        w = rows[i]["claim"].split()
        w[3] = w[3][1] + w[3][0] + w[3][2:]
        rows.append({"claim": " ".join(w), "caption": rows[i]["caption"], "split": "train" if rows[i]["split"] == "dev" else "test"})
        near[len(rows)] = i + 1
    df = gold(*rows)
    got = {tuple(sorted((r.train_row, r.eval_row))) for r in overlap.cross_split(df).collect()}
    assert got == {tuple(sorted(x)) for x in near.items()}
    train, held = overlap.keyed(*sides(df))
    met = train.join(held.withColumnRenamed("class_id", "other"), "digest").select("class_id", "other").distinct().count()
    assert met < 3 * len(near)  # a third of both sides would be 10,000


def test_rarest_digests_miss_no_pair(gold, spark):
    """Against all pairs: every pair with enough overlap shares a digest by which both are looked up."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(4, 7))) for _ in range(12)]
    rows = [{"claim": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 9))), "caption": "", "split": rng.choice(["train", "dev"])} for _ in range(120)]
    train, held = {}, {}
    for keys, found in zip(overlap.keyed(*sides(gold(*rows))), (train, held), strict=True):
        for k in keys.collect():
            found.setdefault(int(bytes(k.class_id)), set()).add(k.digest)
    of = [overlap.pieces(r["claim"], r["caption"]) for r in rows]
    for i, a in enumerate(rows, 1):
        for j, b in enumerate(rows, 1):
            if a["split"] == "train" and b["split"] == "dev" and overlap.overlap(of[i - 1], of[j - 1]) >= overlap.OVERLAP:
                assert train.get(i, set()) & held.get(j, set()), (a, b)
