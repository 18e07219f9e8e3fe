"""Runs side by side: leaderboard, paired outcomes, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import scoring


def leaderboard(gold: DataFrame, pred: DataFrame, by: str = "run_name", key: str = "claim_id") -> DataFrame:
    """Individual and pair scores of each run over the rows without context, with context, and all."""
    parts = []
    for which in ("no", "yes", "all"):
        rows = scoring.in_context(gold, which)
        one = scoring.individual(scoring.answered(rows, pred, key), [by])
        two = scoring.pair_accuracy(rows, pred, [by], key)
        parts.append(one.join(two, by, "left").withColumn("context", F.lit({"no": "no", "yes": "context", "all": "all"}[which])))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def both_runs(gold: DataFrame, pred: DataFrame, first: str, second: str, key: str = "claim_id") -> DataFrame:
    """Gold rows that both runs answered, with a flag each for being right."""
    a = pred.where(F.col("run_name") == first).select(key, F.col("pred_label").alias("first_label"))
    b = pred.where(F.col("run_name") == second).select(key, F.col("pred_label").alias("second_label"))
    rows = gold.join(a, key).join(b, key)
    right = lambda c: F.coalesce(F.col("label") == F.col(c), F.lit(False))
    return rows.withColumn("first_right", right("first_label")).withColumn("second_right", right("second_label"))


def outcomes(rows: DataFrame, by: str) -> DataFrame:
    """Both right, both wrong, regressed, improved, and the net gain; one line a group and one for all of them (null)."""
    a, b = F.col("first_right"), F.col("second_right")
    counts = [
        F.count("*").alias("n"),
        F.count_if(a & b).alias("both_right"),
        F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(a & ~b).alias("regressed"),
        F.count_if(~a & b).alias("improved"),
    ]
    return rows.rollup(by).agg(*counts).withColumn("net", F.col("improved") - F.col("regressed"))


def against_majority(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy of both runs in each group, their difference, and what always giving the commonest label would reach."""
    per_label = rows.groupBy(by, "label").agg(F.count("*").alias("k"), F.count_if("first_right").alias("r1"), F.count_if("second_right").alias("r2"))
    out = per_label.groupBy(by).agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2"))
    n = F.col("n")
    return out.select(by, "n", (F.col("r1") / n).alias("first_accuracy"), (F.col("r2") / n).alias("second_accuracy"), ((F.col("r2") - F.col("r1")) / n).alias("delta"), (F.col("most") / n).alias("majority"))


def distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def ranked(scores: DataFrame, score: str = "accuracy") -> DataFrame:
    """Best first; runs without a score last."""
    return scores.orderBy(F.col(score).desc_nulls_last(), *[c for c in scores.columns if c != score])
