"""Assembly of predictions: fallbacks, routed merges, shards, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: the first by ordinal."""
    top = Window.partitionBy(key).orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last by the order columns, as when a lookup table is filled row by row."""
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*")


def with_fallback(base: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Every row of base, its prediction replaced where better has one; never drops or invents ids."""
    other = better.select(key, F.col("pred_label").alias("_better"))
    joined = base.join(other, key, "left")
    return joined.select(key, F.coalesce("_better", "pred_label").alias("pred_label"), F.when(F.col("_better").isNotNull(), "advisor").otherwise("baseline").alias("origin"))


def routed(rows: DataFrame, by: str, routes: dict[str, DataFrame], fallback: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Each row's prediction from the source of its kind, else from the fallback; a row that the fallback lacks is an error if strict."""
    out = rows.select(key, by)
    picked: Column | None = None
    for n, (kind, source) in enumerate(sorted(routes.items())):
        out = out.join(source.select(key, F.col("pred_label").alias(f"_p{n}")), key, "left")
        hit = (F.col(by) == kind) & F.col(f"_p{n}").isNotNull()
        picked = F.when(hit, F.struct(F.col(f"_p{n}").alias("label"), F.lit(kind).alias("route"))) if picked is None else picked.when(hit, F.struct(F.col(f"_p{n}").alias("label"), F.lit(kind).alias("route")))
    out = out.join(fallback.select(key, F.col("pred_label").alias("_f"), F.lit(True).alias("_there")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no fallback for "), F.col(key))) if strict else F.lit(None)
    last = F.when(F.col("_there"), F.col("_f")).otherwise(missing.cast("string"))
    rest = F.struct(last.alias("label"), F.lit("fallback").alias("route"))
    chosen = rest if picked is None else picked.otherwise(rest)
    return out.withColumn("_c", chosen).select(key, by, F.col("_c.label").alias("pred_label"), F.col("_c.route").alias("route"))


def concat(parts: list[DataFrame], ordinal: str = "shard") -> DataFrame:
    """All rows of all parts, duplicates kept, with the part's number; columns that a part lacks are null."""
    numbered = [p.withColumn(ordinal, F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def existing(spark, paths: list[str], read) -> list[DataFrame]:
    """What `read` gives of the paths that exist; the others are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    return [read(p) for p in there]


def or_missing(c: Column, keep_empty: bool) -> Column:
    """N/A for null; for the empty string too, unless it is kept."""
    return F.coalesce(c if keep_empty else F.nullif(c, F.lit("")), F.lit("N/A"))


def advisor_block(text: Column, title: str = "Advisor reading") -> Column:
    """The advisor's text under its title, or nothing where there is no text."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n\n{title}:\n"), text)).otherwise("")


def prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with every {name} replaced. Values are put in as they are: braces in them mean nothing."""
    pieces: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        pieces += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def routed_prompt(kind: Column, templates: dict[str, str], generic: str, values: dict[str, Column]) -> Column:
    """The prompt of the row's kind of evidence; the generic one for a kind without its own, and for null."""
    out = prompt(generic, values)
    for name, text in templates.items():
        out = F.when(kind.eqNullSafe(F.lit(name)), prompt(text, values)).otherwise(out)
    return out


def with_readings(rows: DataFrame, cache: DataFrame, paths: list[str]) -> DataFrame:
    """The cached text of each path column (`<path>_text`), null where there is none."""
    out = rows
    for p in paths:
        side = cache.select(F.col("image_path").alias(p), F.col("text").alias(f"{p}_text"))
        out = out.join(side, p, "left")
    return out
