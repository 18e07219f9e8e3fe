"""Profiles of data sets: value counts, lengths, groups, gaps, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as tx


def value_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, share) of several fields in one pass; a missing value counts as N/A."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("N/A")).alias("value")) for f in fields]))
    counted = rows.select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    # every row gives each field one value, so a field's total is its sum
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    return counted.join(totals, "field").select("field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def most_common(rows: DataFrame, field: str, ordinal: str) -> DataFrame:
    """Values by count, the commonest first; ties in order of first appearance."""
    return rows.groupBy(field).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def length_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Words of the non-empty texts of each field: count, least, most, mean, and the median (interpolated between the middle two)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.word_count(F.col(f)).alias("words")) for f in fields]))
    words = rows.select(each.alias("x")).select("x.field", "x.words").where("words > 0")
    return words.groupBy("field").agg(F.count("*").alias("n"), F.min("words").alias("least"), F.max("words").alias("most"), F.avg("words").alias("mean"), F.median("words").alias("median"))


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    """Number of groups, and least, most and mean rows of a group."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def gaps(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Missing (null or empty) and duplicate values of each field; all missing ones count as one value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields]))
    per_value = rows.select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    missing = F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0))
    return per_value.groupBy("field").agg(F.sum("n").alias("n"), missing.alias("missing"), (F.sum("n") - F.count("*")).alias("duplicates"))


def field_inventory(rows: DataFrame, json_column: str) -> DataFrame:
    """Names of all fields of the JSON objects in a column, with how many objects have them."""
    keys = rows.select(F.explode(F.json_object_keys(json_column)).alias("field"))
    return keys.groupBy("field").agg(F.count("*").alias("n")).orderBy("field")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides, in both, and on one side only."""
    seen = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(key, F.lit(0), F.lit(1)))
    sides = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return sides.agg(
        F.count_if(F.col("in_a") == 1).alias("n_a"),
        F.count_if(F.col("in_b") == 1).alias("n_b"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("n_both"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("only_a"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("only_b"),
    )


def panel_stats(figures: DataFrame) -> DataFrame:
    """Single, composite and unparsed figures, with their shares."""
    n = F.col("num_panels")
    kind = F.when(n.isNull(), "unparsed").when(n > 1, "composite").otherwise("single")
    counted = figures.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.select("kind", "n", (F.col("n") / total.scalar()).alias("share"))


def chart_types(figures: DataFrame) -> DataFrame:
    """Figures of each type and number of panels; a null type is unknown."""
    return figures.groupBy(F.coalesce("type", F.lit("unknown")).alias("type"), "num_panels").agg(F.count("*").alias("n"))


def stage_counts(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): how many rows pass each stage and all stages before it, in one pass."""
    passed, counts = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(F.count("*").alias("scanned"), *counts).unpivot([], ["scanned", *stages], "stage", "n")


def union_counts(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct keys of each source and of all together (source null); empty keys don't count."""
    named = [df.select(F.lit(name).alias("source"), F.col(key).cast(T.StringType()).alias("key")) for name, df in sources.items()]
    rows = reduce(DataFrame.union, named).where("key is not null and key <> ''").distinct()
    return rows.rollup("source").agg(F.count_distinct("key").alias("n"))


def footprint(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, 90th percentile and maximum of each group and of all (null). The percentile is the value at place floor(0.9 n), counted from 0.

    Ranks come from window counts over the sorted values, so no group is gathered into one array.
    """
    both = rows.where(F.col(value).isNotNull()).select(F.explode(F.array(F.col(by), F.lit(None).cast("string"))).alias(by), F.col(value).alias("v"))
    per_value = both.groupBy(by, "v").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = per_value.groupBy(by).agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.max("v").alias("most"))
    placed = per_value.withColumn("upto", F.sum("k").over(order))
    joined = placed.join(sums.withColumnRenamed(by, "g"), F.col(by).eqNullSafe(F.col("g"))).where(F.col("upto") > F.floor(F.col("n") * 9 / 10))
    return joined.groupBy(by, "n", "mean", "most").agg(F.min("v").alias("p90"))
