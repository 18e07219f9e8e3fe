"""The queries of this subpackage: each applies an operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, leaks, markup, overlap, packing, raking, sentences, splits, stuffing, truncation
from factloom.llm.common import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.detect(table(spark, d, "task1_gold")).select("row_id", "field")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "task1_gold")
    return truncation.rates(truncation.detect(records), records)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.chained_papers(table(spark, d, "task1_gold"))


def p2_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "task1_gold"), table(spark, d, "split_targets"))


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task1_gold").where(F.lower(F.trim("split")).isin("dev", "test"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_held_out(spark, d), table(spark, d, "documents"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(p3_found(spark, d), _held_out(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.cross_split(table(spark, d, "task1_gold"))
    return found.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "task1_gold")
    return overlap.report(overlap.cross_split(records), records)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = raking.draw(table(spark, d, "task1_gold"), table(spark, d, "sample_targets"))
    return report.where("short").select("attribute", "category")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return raking.draw(table(spark, d, "task1_gold"), table(spark, d, "sample_targets"))[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return raking.draw(table(spark, d, "task1_gold"), table(spark, d, "sample_targets"))[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "task1_gold").where(F.lower("use_context") == "yes"))


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "task1_gold"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(table(spark, d, "task1_gold"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(table(spark, d, "task1_gold"), cleaned=True)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    packed = materialize(p9_pack(spark, d))
    return packing.summary(packed, table(spark, d, "pack_specs")).join(packing.likeness(packed, table(spark, d, "documents")), "pack_id", "left")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "documents")).where("stuffed").select("doc_id")


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.judged(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1 : x[0].index("_")]), x[0])))
