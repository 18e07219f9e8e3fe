"""Training records: pairs, evidence sides, group-wise holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx


def task1_records(perturbed: DataFrame, prefix: str = "") -> DataFrame:
    """Two records of each perturbed claim, Supported (`_s`) and Refuted (`_r`); only the first where nothing was perturbed.

    perturbed: pmcid, idx, claim, context, caption, perturbed_caption, evidence, perturbed_evidence, operation, evi_type, domain.
    """
    pair = F.concat(F.lit(prefix), F.col("pmcid"), F.lit("_"), F.col("idx").cast("string"))
    side = lambda suffix, label, path, caption, op: F.struct(
        F.concat(F.col("claim_id_pair"), F.lit(suffix)).alias("claim_id"), F.lit(label).alias("label"), path.alias("evi_path"), caption.alias("caption"), op.alias("operation")
    )
    both = F.array(
        side("_s", "Supported", F.col("evidence"), F.col("caption"), F.lit("Supported_claim_only")),
        F.when(F.col("perturbed_evidence").isNotNull(), side("_r", "Refuted", F.col("perturbed_evidence"), F.coalesce("perturbed_caption", "caption"), F.col("operation"))),
    )
    rows = perturbed.withColumn("claim_id_pair", pair).withColumn("_r", F.explode(F.array_compact(both)))
    return rows.select("_r.claim_id", "claim", "evi_type", "context", "domain", "claim_id_pair", "_r.caption", "_r.label", "_r.operation", "_r.evi_path")


def with_perturbations(claims: DataFrame, perturbed: DataFrame, keys: tuple[str, str] = ("pmcid", "sentence")) -> DataFrame:
    """Every claim with its perturbation, joined on document and sentence; one without keeps nulls and gives a Supported record only.

    perturbed: the keys, operation, perturbed_evidence, perturbed_caption; of several for one sentence the last by evidence counts.
    """
    kept = ("operation", "perturbed_evidence", "perturbed_caption")
    last = perturbed.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct("perturbed_evidence", "operation")).alias("_x")).select(*keys, "_x.*")
    return claims.join(last, list(keys), "left")


def evidence_sides(perturbed: DataFrame, prefix: str = "") -> DataFrame:
    """Task 2 records: which of the two places the true evidence takes is a coin that depends only on the record's id. Caption edits are left out."""
    rows = perturbed.where(~F.col("operation").eqNullSafe("Caption adjustments") & F.col("perturbed_evidence").isNotNull())
    key = F.concat(F.lit(prefix), F.col("pmcid"), F.lit("_"), F.col("idx").cast("string"))
    first = tx.first_even_byte(F.col("sample_id"))
    return rows.withColumn("sample_id", key).select(
        "sample_id", "claim", "caption", "context", "evi_type", "domain",
        F.when(first, F.col("evidence")).otherwise(F.col("perturbed_evidence")).alias("evidence_id_1"),
        F.when(first, F.col("perturbed_evidence")).otherwise(F.col("evidence")).alias("evidence_id_2"),
        F.when(first, "evidence_id_1").otherwise("evidence_id_2").alias("label"),
    )


def holdout(rows: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """rows with `held_out`: the n groups that come first by a seeded hash are held out, whole."""
    groups = rows.select(group).distinct()
    taken = groups.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(group, F.lit(""))), 256), group).limit(n).withColumn("held_out", F.lit(True))
    return rows.join(taken, group, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
