import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(bpe.default_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return bpe.ByteBpe(ranks), tiktoken.Encoding("own", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids(both):
    own, other = both
    rng = random.Random(1)
    texts = ["", " ", "a", "Hello  world\n\n\tx", "don't we'll", "日本語のテキスト。", "<|endoftext|>", "é" * 300, "a" * 5000, "ab" * 3000, "".join(rng.choice("abcdeé中 ") for _ in range(4000))]
    assert [own.encode(t) for t in texts] == [other.encode_ordinary(t) for t in texts]

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=80))
    def check(t):
        assert own.encode(t) == other.encode_ordinary(t)

    check()


def test_rank_queue():
    rng = random.Random(2)
    q, kept = bpe.RankQueue(), {}
    for _ in range(3000):
        if rng.random() < 0.6 or not kept:
            r = rng.randint(0, 50_256)
            q.push(r, r)
            kept[r] = kept.get(r, 0) + 1
        else:
            least = q.least()
            assert least == min(kept) and len(q.take(least)) == kept.pop(least)


def test_documents(documents):
    df = documents("One two", None, "", "One two").select("*", *[F.lit("q").alias(c) for c in ("k", "t", "ids")])
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    assert got == {1: [3198, 734], 2: [], 3: [], 4: [3198, 734]}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_hilbert_curve_moves_one_step_at_a_time():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert_index(cells, bits=3))]
    assert sorted(packing.hilbert_index(cells, bits=3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_filling():
    f = packing.Filling(10, most=2)
    assert [f.put(x) for x in (5, 5, 3, 2, 5, 9, 9, 8, 1)] == [0, 0, 1, 1, 1, 2, 3, 4, 2]
    rng = random.Random(3)
    sizes = [rng.randint(0, 100) for _ in range(2000)]
    f, used = packing.Filling(100), {}
    for s in sizes:
        c = f.put(s)
        used[c] = used.get(c, 0) + s
    assert max(used.values()) <= 100 and len(used) <= sum(sizes) / 100 * 1.06 + 1 and len(f.rooms) <= packing.OPEN


def test_packing(documents, spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 60))) for _ in range(200)] + [None, "", "word " * 700, "word " * 700]
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 128), (2, "byte_bpe_50k", 512), (3, "x", None), (4, "x", 0)], "pack_id bigint, tokenizer string, capacity_tokens bigint")
    df = documents(*texts).select("*", F.lit(1).alias("n_tokens"), F.lit(2).alias("curve"))
    packed = packing.pack(df, specs)
    sizes = {r.doc_id: len(r.ids) for r in bpe.encode_documents(df).collect()}
    rows = packed.collect()
    for pack_id, capacity in ((1, 128), (2, 512)):
        mine = [r for r in rows if r.pack_id == pack_id]
        used, pieces = {}, {}
        for r in mine:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append(r)
        assert max(used.values()) <= capacity and set(pieces) == set(sizes)
        for doc, ps in pieces.items():
            assert sum(p.n_tokens for p in ps) == sizes[doc] and len(ps) == max(1, -(-sizes[doc] // capacity))
            assert [p.start_token for p in sorted(ps, key=lambda p: p.piece)] == [capacity * i for i in range(len(ps))]
        assert sum(sizes.values()) / (len(used) * capacity) > 0.85
    assert {r.pack_id for r in rows} == {1, 2}
    assert packing.pack(df.limit(0), specs).count() == 0
    assert packing.summary(packed, specs).where("fill is not null").count() == 2


def test_specifications(documents, spark):
    schema = "pack_id bigint, tokenizer string, capacity_tokens bigint"
    df = documents("One two three", "one two", None).union(spark.createDataFrame([(None, "four five"), (None, "four five")], "doc_id bigint, text string"))
    rows = packing.pack(df, spark.createDataFrame([(1, "word_bpe_49k", 64), (2, None, 64), (2, "piece_bpe_32k", 32), (2, None, 64), (None, "x", 5)], schema)).collect()
    got = {}
    for r in rows:
        got.setdefault((r.pack_id, r.container), []).append((r.doc_id, r.n_tokens))
    assert {k[0]: sum(len(v) for c, v in got.items() if c[0] == k[0]) for k in got} == {1: 5, 2: 10}  # null ids are kept, equal specifications count once
    assert len({c for p, c in got if p == 2}) == 2
    with pytest.raises(ValueError, match="tokenizer"):
        packing.pack(df, spark.createDataFrame([(1, "x", 5)], schema))


def test_mates_are_alike(documents, spark):
    rng = random.Random(8)
    topics = [[f"{chr(97 + t)}{chr(97 + i)}word" for i in range(20)] for t in range(12)]
    texts = [" ".join(rng.choice(topics[i % 12]) for _ in range(rng.randint(20, 60))) for i in range(1500)]
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 1024)], "pack_id bigint, tokenizer string, capacity_tokens bigint")
    df = documents(*texts)
    packed = packing.pack(df, specs).cache()
    r = packing.likeness(packed, df).first()
    assert r.likeness > 1.5 * r.by_chance and packing.summary(packed, specs).first().fill > 0.96
