import itertools
import random

import pytest

from factloom.llm import splits


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(str(rng.randint(0, 60)), str(rng.randint(0, 60))) for _ in range(45)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    got = {r.node: r.component for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)


def rows_of(*specs):
    return [{"paper_id": p, "paper_path": path, "claim_id_pair": c} for p, path, c in specs]


def test_names_and_chains(gold):
    df = gold(*rows_of(
        (None, "papers/train/ml_1.a.json", "1"), ("ARXIV: B2 ", None, " 1 "), ("b2", None, "2"), (None, "papers/test/peerj_sibils_c3.json", "2"),
        ("d4", None, "no pair"), ("e5", None, "No pair"), ("f6", None, ""), ("g7", None, None), (None, None, "3"), ("", None, "3"), ("2222.00001v2", None, "9"), (None, "papers/dev/nlp_2222.00001.json", "9"),
    ))
    got = {(r.paper_a, r.paper_b) for r in splits.chained_papers(df).collect()}
    assert got == set(itertools.combinations(["1.a", "b2", "c3"], 2))
    assert splits.chained_papers(df.limit(0)).count() == 0


def test_assignment(gold, spark):
    rng = random.Random(5)
    rows = [{"paper_id": "hot" if i % 3 == 0 else f"p{rng.randint(0, 150)}", "claim_id_pair": str(rng.randint(0, 400)) if i % 5 == 0 else None} for i in range(1500)] + [{}, {"claim_id_pair": "0"}]
    df = gold(*rows)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)], "split string, target_share double")
    got = splits.assign(df, targets).collect()
    assert len(got) == len(rows) and {r.split for r in got} <= {"train", "validation", "test"}
    of = {r.row_id: r.split for r in got}
    for key in ("paper_id", "claim_id_pair"):
        seen = {}
        for i, r in enumerate(rows, 1):
            if r.get(key):
                assert seen.setdefault(r[key], of[i]) == of[i]
    assert of == {r.row_id: r.split for r in splits.assign(df.repartition(3), targets).collect()}
    assert splits.assign(df.limit(0), targets).count() == 0
