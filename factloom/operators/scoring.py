"""Scores of label predictions against gold rows.

Every score is one aggregation with map-side combining over one join; nothing is collected. `by` names the
columns that tell runs apart (a file, a model), so all runs are scored in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("Supported", "Refuted")
NO_PAIR = "no pair"


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def last_predictions(pred: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One prediction a key: the last one in order, as when a lookup table is filled row by row. Ties go to the greater label."""
    last = F.max_by("pred_label", F.struct(*[F.col(c) for c in order], F.coalesce("pred_label", F.lit(""))))
    return pred.groupBy(*keys).agg(last.alias("pred_label"))


def answered(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold rows with their prediction; rows without one are skipped."""
    return gold.join(pred, key, "inner")


def unanswered(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Gold rows that no prediction is for."""
    return gold.join(pred.select(key).distinct(), key, "left_anti")


def individual(joined: DataFrame, by: list[str]) -> DataFrame:
    """Macro precision, recall and F1 over the two labels, and accuracy.

    Case-sensitive. A prediction outside the labels is wrong: it lowers recall and accuracy. Empty denominators count as 0.
    """
    g, p = F.col("label"), F.col("pred_label")
    counts = [F.count("*").alias("n"), F.count_if(g.eqNullSafe(p)).alias("hits")]
    for x in LABELS:
        counts += [F.count_if((g == x) & (p == x)).alias(f"tp_{x}"), F.count_if(p == x).alias(f"pred_{x}"), F.count_if(g == x).alias(f"gold_{x}")]
    out = joined.groupBy(*by).agg(*counts)
    for x in LABELS:
        out = out.withColumn(f"p_{x}", share(F.col(f"tp_{x}"), F.col(f"pred_{x}"))).withColumn(f"r_{x}", share(F.col(f"tp_{x}"), F.col(f"gold_{x}")))
        out = out.withColumn(f"f_{x}", share(2 * F.col(f"p_{x}") * F.col(f"r_{x}"), F.col(f"p_{x}") + F.col(f"r_{x}")))
    mean = lambda k: sum((F.col(f"{k}_{x}") for x in LABELS[1:]), F.col(f"{k}_{LABELS[0]}")) / len(LABELS)
    return out.select(*by, "n", mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("macro_f1"), share(F.col("hits"), F.col("n")).alias("accuracy"))


def confusion(joined: DataFrame, by: list[str]) -> DataFrame:
    """Counts of gold and predicted label; rows with a label or prediction outside the labels are left out."""
    g, p = F.col("label"), F.col("pred_label")
    cells = [F.count_if((g == a) & (p == b)).alias(f"{a[0].lower()}{b[0].lower()}") for a in LABELS[::-1] for b in LABELS[::-1]]
    return joined.groupBy(*by).agg(*cells)


def in_context(gold: DataFrame, which: str) -> DataFrame:
    """all rows; no: rows that need no context; yes: all others (`other sources` too). Nulls belong to neither."""
    if which == "all":
        return gold
    needs_none = F.lower("use_context") == "no"
    return gold.where(needs_none if which == "no" else ~needs_none)


def pairs(gold: DataFrame) -> DataFrame:
    """Gold rows that belong to a pair; rows without a pair id form one pair together."""
    return gold.withColumn("claim_id_pair", F.coalesce("claim_id_pair", F.lit(""))).where(F.col("claim_id_pair") != NO_PAIR)


def pair_accuracy(gold: DataFrame, pred: DataFrame, by: list[str], key: str = "claim_id") -> DataFrame:
    """Share of pairs all of whose rows are right, whatever the letter case; a missing prediction is wrong.

    Sizes of pairs are counted once; a run's right answers are counted per pair and compared with the size, so runs and
    gold rows are never crossed. A run that answered nothing of these pairs doesn't come out.
    """
    members = pairs(gold)
    sizes = members.groupBy("claim_id_pair").agg(F.count("*").alias("size"))
    total = sizes.agg(F.count("*").alias("n_pairs"))
    right = F.count_if(F.lower("label") == F.lower("pred_label"))
    of_run = members.join(pred, key).groupBy(*by, "claim_id_pair").agg(right.alias("right"))
    scored = of_run.join(sizes, "claim_id_pair").groupBy(*by).agg(F.count_if(F.col("right") == F.col("size")).alias("n_right"))
    scored = scored.withColumn("n_pairs", total.scalar())
    return scored.select(*by, "n_pairs", "n_right", share(F.col("n_right"), F.col("n_pairs")).alias("pair_accuracy"))


def evidence_accuracy(joined: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of evidence selection over the answered rows; no rows give no line."""
    right = F.count_if(F.col("label") == F.col("pred_label"))
    return joined.groupBy(*by).agg(F.count("*").alias("n"), share(right, F.count("*")).alias("accuracy"))


def file_accuracy(joined: DataFrame, by: list[str]) -> DataFrame:
    """As evidence_accuracy, whatever the letter case, with empty predictions counted; all rows are in the denominator."""
    right = F.count_if(F.lower("label") == F.lower("pred_label"))
    empty = F.count_if(F.coalesce("pred_label", F.lit("")) == "")
    return joined.groupBy(*by).agg(F.count("*").alias("total"), right.alias("correct"), empty.alias("empty"), share(right, F.count("*")).alias("accuracy"))
