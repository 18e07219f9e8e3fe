import pytest

from factloom.operators import compare, scoring


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_published_confusion_reconstructs(spark):
    """747 rows with the published counts give the published scores."""
    counts = {("Refuted", "Refuted"): 302, ("Refuted", "Supported"): 50, ("Supported", "Refuted"): 96, ("Supported", "Supported"): 299}
    rows = [("run", g, p) for (g, p), n in counts.items() for _ in range(n)]
    joined = frame(spark, rows, "run string, label string, pred_label string")
    r = scoring.individual(joined, ["run"]).first()
    assert [round(100 * x, 2) for x in (r.precision, r.recall, r.macro_f1, r.accuracy)] == [80.78, 80.75, 80.45, 80.46]
    c = scoring.confusion(joined, ["run"]).first()
    assert (c.rr, c.rs, c.sr, c.ss) == (302, 50, 96, 299)


@pytest.fixture
def small(spark):
    gold = frame(
        spark,
        [("1", "Supported", "0001", "no"), ("2", "Refuted", "0001", "yes"), ("5", "Supported", "0003", "No"), ("6", "Refuted", "0003", "other sources"), ("42", "Supported", "no pair", "no")],
        "claim_id string, label string, claim_id_pair string, use_context string",
    )
    pred = frame(spark, [("r", "1", "Refuted"), ("r", "2", "Supported"), ("r", "5", "Supported"), ("r", "6", "Refuted"), ("r", "42", "Refuted")], "run_name string, claim_id string, pred_label string")
    return gold, pred


def test_example_scores(small):
    gold, pred = small
    r = scoring.individual(scoring.answered(gold, pred, "claim_id"), ["run_name"]).first()
    assert [round(100 * x, 2) for x in (r.precision, r.recall, r.macro_f1, r.accuracy)] == [41.67, 41.67, 40.0, 40.0]
    p = scoring.pair_accuracy(gold, pred, ["run_name"]).first()
    assert (p.n_pairs, p.n_right, p.pair_accuracy) == (2, 1, 0.5)


def test_missing_and_lower_case(small):
    gold, pred = small
    from pyspark.sql import functions as F

    fewer = pred.where("claim_id <> '5'").withColumn("pred_label", F.lower("pred_label"))
    assert scoring.individual(scoring.answered(gold, fewer, "claim_id"), ["run_name"]).first().n == 4  # skipped
    assert scoring.individual(scoring.answered(gold, fewer, "claim_id"), ["run_name"]).first().accuracy == 0  # case-sensitive
    assert scoring.pair_accuracy(gold, fewer, ["run_name"]).first().n_right == 0  # missing is wrong
    assert [r.claim_id for r in scoring.unanswered(gold, fewer, "claim_id").collect()] == ["5"]
    whole = pred.withColumn("pred_label", F.lower("pred_label"))
    assert scoring.pair_accuracy(gold, whole, ["run_name"]).first().n_right == 1  # case doesn't count here


def test_pairs_without_id_are_one(spark):
    gold = frame(spark, [("1", "Supported", None), ("2", "Refuted", None)], "claim_id string, label string, claim_id_pair string")
    pred = frame(spark, [("r", "1", "Supported"), ("r", "2", "Refuted")], "run_name string, claim_id string, pred_label string")
    assert scoring.pair_accuracy(gold, pred, ["run_name"]).first().n_pairs == 1


def test_contexts_and_leaderboard(small):
    gold, pred = small
    assert {r.claim_id for r in scoring.in_context(gold, "yes").collect()} == {"2", "6"}
    got = {r.context: (r.n, r.n_pairs) for r in compare.leaderboard(gold, pred).collect()}
    assert got == {"no": (3, 2), "context": (2, 2), "all": (5, 2)}


def test_out_of_label_prediction(spark):
    j = frame(spark, [("r", "Supported", "Unclear"), ("r", "Refuted", "Refuted"), ("r", None, None)], "run string, label string, pred_label string")
    r, c = scoring.individual(j, ["run"]).first(), scoring.confusion(j, ["run"]).first()
    assert r.n == 3 and r.recall == 0.5 and (c.rr, c.rs, c.sr, c.ss) == (1, 0, 0, 0)


def test_outcomes(spark):
    rows = frame(spark, [("table", True, False), ("table", False, True), ("figure", True, True)], "evi_type string, first_right boolean, second_right boolean")
    got = {r.evi_type: (r.n, r.regressed, r.improved, r.net) for r in compare.outcomes(rows, "evi_type").collect()}
    assert got == {"table": (2, 1, 1, 0), "figure": (1, 0, 0, 0), None: (3, 1, 1, 0)}
