"""Claim sentences of structured documents, joined with the table or figure they speak of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx


def contents(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a content element, with its section's title and both positions."""
    sections = docs.select("pmcid", *keep, F.posexplode("body_sections").alias("section_pos", "section"))
    return sections.select("pmcid", *keep, "section_pos", F.col("section.title").alias("section_title"), F.posexplode("section.contents").alias("content_pos", "content")).select("pmcid", *keep, "section_pos", "section_title", "content_pos", "content.*")


def doc_summary(docs: DataFrame) -> DataFrame:
    """Sections, paragraphs, tables and figures of each document."""
    tags = F.flatten(F.transform("body_sections", lambda s: s["contents"]))
    n = lambda *names: F.size(F.filter(tags, lambda c: c["tag"].isin(*names)))
    return docs.select("pmcid", F.size("body_sections").alias("n_sections"), n("p", "list-item").alias("n_paragraphs"), n("table").alias("n_tables"), n("fig").alias("n_figures"))


def labelled(elements: DataFrame, kind: str) -> DataFrame:
    """The tables or figures of each document by label number; of several with one number, the last. Labels without a number are left out."""
    tag = {"table": "table", "figure": "fig"}[kind]
    rows = elements.where(F.col("tag") == tag).withColumn("number", tx.label_number(tx.strip(F.coalesce("label", F.lit(""))), kind)).where("number is not null")
    last = F.max_by(F.struct("xref_id", "label", "caption", "graphics", "table_columns", "table_values"), F.struct("section_pos", "content_pos"))
    return rows.groupBy("pmcid", "number").agg(last.alias("x")).select("pmcid", "number", "x.*")


def sentences(paragraphs: DataFrame, text: str = "text", kind: str = "table") -> DataFrame:
    """Claim-worthy sentences that mention exactly one numbered table or figure of their own document.

    Paragraphs without a mention are dropped before they are cut into sentences: the optimizer can't push that below the cut.
    """
    likely = paragraphs.where(F.col(text).rlike(tx.MENTION[kind]))
    each = likely.withColumn("sentence", F.explode(tx.split_sentences(F.col(text))))
    own = each.where(tx.is_own_mention(F.col("sentence"), kind))
    one = own.withColumn("_numbers", tx.mentioned_numbers(F.col("sentence"), kind)).where("size(_numbers) = 1")
    return one.where(tx.is_claim_worthy(F.col("sentence"), kind)).withColumn("number", F.col("_numbers")[0]).drop("_numbers")


def claims(docs: DataFrame, kind: str = "table") -> DataFrame:
    """Claim sentences with the table or figure that their number names in the same document."""
    counter = {"table": "tables_in_body", "figure": "figures_in_body"}[kind]
    parts = contents(docs.where(F.coalesce(counter, F.lit(1)) > 0))
    said = sentences(parts.where(F.col("tag").isin("p", "list-item")), "text", kind)
    said = said.select("pmcid", "section_title", "sentence", F.col("text").alias("context"), "number")
    return said.join(labelled(parts, kind), ["pmcid", "number"])


def with_files(figure_claims: DataFrame, downloaded: DataFrame) -> DataFrame:
    """Figure claims whose file is there: joined on document and reference id."""
    return figure_claims.join(downloaded.select("pmcid", "xref_id", "local_path"), ["pmcid", "xref_id"])
