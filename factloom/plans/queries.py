"""The engine's operators over the test tables: each query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import text as tx
from factloom.operators import compare, corpus, figures, infer, merge, mining, perturb, profile, scoring, training, work
from factloom.sources import readers


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns])


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task1_gold").where("split in ('dev', 'test')")


def predictions1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.last_predictions(table(spark, d, "task1_pred"), ["run_name", "claim_id"], "predicted_at")


def predictions2(spark: SparkSession, d: str) -> DataFrame:
    return scoring.last_predictions(table(spark, d, "task2_pred"), ["run_name", "sample_id"])


def gold2(spark: SparkSession, d: str) -> DataFrame:
    """Task 2 gold with one row a sample; a few come twice."""
    g = table(spark, d, "task2_gold")
    return merge.last_wins(g.select("sample_id", "label", "evi_type"), ["sample_id"], "label", "evi_type")


def answered1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.answered(held_out(spark, d).select("claim_id", "label", "evi_type"), predictions1(spark, d), "claim_id")


# Scores


def score_individual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.individual(answered1(spark, d), ["run_name"]))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(answered1(spark, d), ["run_name"])


def unanswered_claims(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unanswered(held_out(spark, d).select("row_id", "claim_id"), predictions1(spark, d), "claim_id").select("row_id", "claim_id")


def pair_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.pair_accuracy(held_out(spark, d).select("claim_id", "label", "claim_id_pair"), predictions1(spark, d), ["run_name"]))


def pair_accuracy_by_context(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = held_out(spark, d).select("claim_id", "label", "claim_id_pair", "use_context"), predictions1(spark, d)
    no, yes = (scoring.pair_accuracy(scoring.in_context(gold, w), pred, ["run_name"]).withColumn("context", F.lit(w)) for w in ("no", "yes"))
    return rounded(no.union(yes))


def task2_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.evidence_accuracy(scoring.answered(gold2(spark, d), predictions2(spark, d), "sample_id"), ["run_name"]))


def per_file_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.file_accuracy(scoring.answered(gold2(spark, d), predictions2(spark, d), "sample_id"), ["run_name"]))


def run_ranking(spark: SparkSession, d: str) -> DataFrame:
    return compare.ranked(rounded(scoring.file_accuracy(scoring.answered(gold2(spark, d), predictions2(spark, d), "sample_id"), ["run_name"]))).select("run_name", "accuracy")


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.leaderboard(held_out(spark, d).select("claim_id", "label", "claim_id_pair", "use_context"), predictions1(spark, d)))


def _both(spark: SparkSession, d: str) -> DataFrame:
    return compare.both_runs(held_out(spark, d).select("claim_id", "label", "evi_type"), predictions1(spark, d), "solo_reader", "two_step_reader")


def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return compare.outcomes(_both(spark, d), "evi_type")


def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.against_majority(_both(spark, d), "evi_type"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return compare.distribution(table(spark, d, "task1_gold"), ["split", "label"])


# Profiles


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.value_counts(table(spark, d, "task1_gold"), ["domain", "evi_type", "use_context", "license_name"]))


def most_common_operation(spark: SparkSession, d: str) -> DataFrame:
    return profile.most_common(table(spark, d, "task1_gold"), "operation", "row_id")


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.length_stats(table(spark, d, "task1_gold"), ["claim", "caption", "context"]))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.group_sizes(table(spark, d, "task1_gold"), "paper_id"))


def missing_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.gaps(table(spark, d, "task1_gold"), ["claim_id", "paper_id", "claim_id_pair", "evi_path"])


def field_inventory(spark: SparkSession, d: str) -> DataFrame:
    return profile.field_inventory(table(spark, d, "events"), "props")


def dataset_overlap(spark: SparkSession, d: str) -> DataFrame:
    return profile.overlap(table(spark, d, "task1_gold"), table(spark, d, "task1_pred"), "claim_id")


def panel_stats(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "advisor_cache").where("evi_type = 'figure'")
    return rounded(profile.panel_stats(readings.select((F.size(F.split("text", r" \| ")) - 3).alias("num_panels"), "text").withColumn("num_panels", F.when(F.coalesce("text", F.lit("")) != "", F.col("num_panels")))))


def chart_types(spark: SparkSession, d: str) -> DataFrame:
    parts = F.when(F.coalesce("text", F.lit("")) != "", F.size(F.split("text", r" \| ")).cast("bigint"))
    return profile.chart_types(table(spark, d, "advisor_cache").select(F.col("evi_type").alias("type"), parts.alias("num_panels")))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim")
    return profile.stage_counts(table(spark, d, "task1_gold").select("claim"), {"mentions": c.rlike(tx.MENTION["table"]), "own": tx.is_own_mention(c), "worthy": tx.is_claim_worthy(c)})


def id_union_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.union_counts({"gold": table(spark, d, "task1_gold"), "predictions": table(spark, d, "task1_pred")}, "claim_id")


def footprint_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task1_gold").select("evi_path", F.when(F.col("evi_path").startswith("figures/"), "figure").otherwise("table").alias("evi_type"), (F.length("claim") / 100).alias("mpx"))
    once = rows.groupBy("evi_path", "evi_type").agg(F.max("mpx").alias("mpx"))
    return rounded(profile.footprint(once, "evi_type", "mpx"))


# Answers and prompts


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers in several layouts, built from the predictions."""
    label, n = F.coalesce("pred_label", F.lit("")), F.length("claim_id") % 4
    even = F.pmod(F.substring("claim_id", -1, 1).cast("int"), F.lit(4))
    text = F.when(even == 0, F.concat(F.lit("<think>maybe refuted</think> Final answer: "), label)).when(even == 1, F.concat(F.lit("It looks supported at first.\nFINAL ANSWER:\n\n "), F.upper(label), F.lit("."))).when(even == 2, F.concat(F.lit("Some say supported, I say "), label)).otherwise(F.concat(F.lit("\""), label, F.lit("\"")))
    return table(spark, d, "task1_pred").select("run_name", "claim_id", "predicted_at", text.alias("answer"), n.alias("_n")).drop("_n")


def parse_task1(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("run_name", "claim_id", "predicted_at", tx.task1_label(F.col("answer")).alias("label"))


def parse_task2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "task2_pred")
    number = F.regexp_extract(F.coalesce("pred_label", F.lit("")), r"([12])$", 1)
    odd = F.pmod(F.substring("sample_id", -1, 1).cast("int"), F.lit(3))
    text = F.when(odd == 0, F.concat(F.lit("evidence_id_2 is weak. Final answer: "), F.coalesce("pred_label", F.lit("none")))).when(odd == 1, F.concat(F.lit("So the final answer is: Answer: $"), number)).otherwise(F.concat(F.lit("I pick answer "), number, F.lit(" here")))
    return p.select("run_name", "sample_id", tx.task2_label(text).alias("label"))


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("run_name", "claim_id", "predicted_at", tx.strip_thinking(F.col("answer")).alias("answer"))


def default_labels(spark: SparkSession, d: str) -> DataFrame:
    parsed = tx.task1_label(F.col("answer"))
    return _answers(spark, d).select("run_name", "claim_id", "predicted_at", tx.with_default(parsed, "task1").alias("label"), parsed.isNull().alias("is_fallback"))


def skip_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "advisor_cache").select("image_path", F.when(F.length("text") % 5 == 0, "skip").when(F.length("text") % 5 == 1, F.concat(F.lit("'"), F.col("text"), F.lit("'"))).otherwise(F.col("text")).alias("answer"))
    return infer.normalized_claims(rows).select("image_path", "claim")


def merge_baseline_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = predictions2(spark, d)
    return merge.with_fallback(p.where("run_name = 'solo_reader'"), p.where("run_name = 'chart_helper'"), "sample_id")


def merge_routed(spark: SparkSession, d: str) -> DataFrame:
    p = predictions2(spark, d)
    of = lambda run: p.where(F.col("run_name") == run)
    return merge.routed(gold2(spark, d), "evi_type", {"figure": of("chart_helper"), "table": of("grid_helper")}, of("solo_reader"), "sample_id", strict=False)


def merge_shards(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "task1_pred").select("run_name", "claim_id", "pred_label", "predicted_at")
    return merge.concat([p.where("run_name = 'two_step_reader'"), p.where("run_name = 'solo_reader'"), p.where("run_name = 'solo_reader'").drop("predicted_at")])


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_wins(table(spark, d, "advisor_cache").select("image_path", "text"), ["image_path"], "text")


PROMPT1 = "Claim: {claim}\nCaption: {caption}\nContext: {context}{advisor}"
PROMPT2 = {"figure": "Which figure backs the claim?\nClaim: {claim}{first}{second}"}
GENERIC2 = "Which evidence backs the claim?\nClaim: {claim}{first}{second}"


def advisor_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.with_readings(table(spark, d, "task1_gold").select("row_id", "claim", "caption", "context", "evi_path"), _readings(spark, d), ["evi_path"])
    values = {"claim": F.coalesce("claim", F.lit("")), "caption": merge.or_missing(F.col("caption"), True), "context": merge.or_missing(F.col("context"), False), "advisor": merge.advisor_block(F.col("evi_path_text"))}
    return rows.select("row_id", merge.prompt(PROMPT1, values).alias("prompt"))


def advisor_prompt_pair(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "task2_gold").select("sample_id", "claim", "evi_type", "evidence_id_1", "evidence_id_2").distinct()
    rows = merge.with_readings(g, _readings(spark, d), ["evidence_id_1", "evidence_id_2"])
    values = {"claim": F.coalesce("claim", F.lit("")), "first": merge.advisor_block(F.col("evidence_id_1_text"), "Evidence 1"), "second": merge.advisor_block(F.col("evidence_id_2_text"), "Evidence 2")}
    return rows.select("sample_id", merge.routed_prompt(F.col("evi_type"), PROMPT2, GENERIC2, values).alias("prompt"))


# Work selection


def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "task1_pred").where("run_name = 'solo_reader'")
    return work.remaining(held_out(spark, d).select("row_id", "claim_id"), done, ["claim_id"]).select("row_id", "claim_id")


def stride_shard(spark: SparkSession, d: str) -> DataFrame:
    return work.strided(table(spark, d, "task1_gold").select("row_id", "claim_id"), "row_id", 1, 4)


def shard_then_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "task1_pred").where("run_name = 'solo_reader'")
    return work.Selection(held_out(spark, d).select("row_id", "claim_id", "evi_type"), "row_id").where("lower(trim(evi_type)) = 'figure'").shard(0, 3).resume(done, ["claim_id"]).rows.select("row_id", "claim_id")


def ids_file(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "task1_pred").where("pred_label is null")
    return work.Selection(table(spark, d, "task1_gold").select("row_id", "claim_id"), "row_id").only_ids(ids, "claim_id").rows.select("row_id", "claim_id")


def discover_images(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "task1_gold").select(F.col("evi_path").alias("path"), F.lit(1).alias("source"))
    two = table(spark, d, "task2_gold").select(F.explode(F.array("evidence_id_1", "evidence_id_2")).alias("path"), F.lit(2).alias("source"))
    return merge.first_wins(one.union(two).where("path is not null"), "path", "source").select("path", "source", tx.evidence_type(F.col("path")).alias("evi_type"))


def with_readings_only(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "advisor_cache").where("text <> ''").select(F.concat(F.lit("./"), F.col("image_path")).alias("path"))
    return readers.with_files(table(spark, d, "task1_gold").select("row_id", "evi_path"), "evi_path", listing)


def figure_paths(spark: SparkSession, d: str) -> DataFrame:
    return readers.evidence_paths(table(spark, d, "task1_gold"), table(spark, d, "task2_gold"), figures_only=True)


# Mining


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def claim_mentions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim")
    return table(spark, d, "task1_gold").where(c.rlike(tx.MENTION["table"]) | c.rlike(tx.MENTION["figure"])).select("row_id", tx.is_own_mention(c, "table").alias("own_table"), tx.is_own_mention(c, "figure").alias("own_figure"), F.array_join(tx.mentioned_numbers(c, "table"), ",").alias("tables"), F.array_join(tx.mentioned_numbers(c, "figure"), ",").alias("figures"))


def claim_worthy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task1_gold").select("row_id", tx.is_claim_worthy(F.col("claim"), "table").alias("worthy"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Structured documents built from the gold rows: the claim as a paragraph, its table twice (the later one counts)."""
    number = F.regexp_extract("claim", r"(?i)\bTables?\s+(\d+)", 1)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CONTENT}
    content = lambda **x: F.struct(*[x.get(k, v).alias(k) for k, v in blank.items()])
    label = F.concat(F.lit("Table "), number)
    first = F.struct(F.lit("Results").alias("title"), F.array(content(tag=F.lit("p"), text=F.col("claim")), content(tag=F.lit("table"), label=label, xref_id=F.lit("t1"), caption=F.col("caption"))).alias("contents"))
    second = F.struct(F.lit("Appendix").alias("title"), F.array(content(tag=F.lit("table"), label=label, xref_id=F.lit("t2"), caption=F.upper("caption")), content(tag=F.lit("fig"), label=F.lit("Figure 1"), xref_id=F.lit("f1"))).alias("contents"))
    return table(spark, d, "task1_gold").select(F.col("row_id").cast("string").alias("pmcid"), F.lit(1).alias("tables_in_body"), F.array(first, second).alias("body_sections"))


def mined_claims(spark: SparkSession, d: str) -> DataFrame:
    return mining.claims(_documents(spark, d), "table").select("pmcid", "number", "sentence", "xref_id", "caption")


def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    return mining.doc_summary(_documents(spark, d))


# Corpus


def exclusion_list(spark: SparkSession, d: str) -> DataFrame:
    paper = tx.paper_of(F.when(F.col("paper_id") != "", F.col("paper_id")), F.col("paper_path"))
    rows = [table(spark, d, t).where("lower(trim(domain)) = 'peerj'").select(paper.alias("id")) for t in ("task1_gold", "task2_gold")]
    lookup = table(spark, d, "documents").where("paper_id is not null").select(F.col("paper_id").alias("id"), F.lit(True).alias("in_corpus")).distinct()
    return corpus.resolve(rows[0].union(rows[1]).where("id is not null").distinct(), lookup, "id", "in_corpus").select("id").orderBy("id")


def bucket_quota(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("section"), F.when(F.col("doc_id") % 11 != 0, F.when(F.col("doc_id") % 7 == 0, 0).otherwise(2)).alias("tables_in_body"))
    both = docs.withColumn("bucket", F.when(F.col("section") == "results", "a").otherwise("b")).select("doc_id", "bucket", "tables_in_body").union(docs.where("section in ('results', 'methods')").select("doc_id", F.lit("b"), "tables_in_body"))
    return corpus.quotas(both, [("a", 30), ("b", 50)], "doc_id", "bucket", "doc_id", excluded=docs.where("section = 'abstract'")).select("doc_id", "bucket")


def search_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("licence"))
    return corpus.search(docs, ["openshelf_bulk", "tovl_mirror"], "replay buffer", ["text"], 25, "doc_id").select("doc_id", "licence")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("row_id") % 3 == 0, 2).otherwise(1)
    ending = F.when(F.col("row_id") % 5 == 0, ".tif").when(F.col("row_id") % 2 == 0, ".gif").otherwise(".png")
    key = F.concat("claim_id", F.lit("."), version.cast("string"), F.lit("/"), F.regexp_replace(tx.base_name(F.col("evi_path")), F.lit(r"\.png$"), ending))
    return table(spark, d, "task1_gold").where("evi_path is not null").select("row_id", F.col("claim_id").alias("pmcid"), key.alias("key"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest_version(_listing(spark, d)).select("row_id", "pmcid", "version", "key")


def best_file(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "task1_gold").where("evi_path is not null").select(F.col("claim_id").alias("pmcid"), tx.base_name(F.col("evi_path")).alias("graphic")).distinct()
    return corpus.best_file(wanted, _listing(spark, d), ["pmcid"], "row_id").select("pmcid", "graphic", "key")


# Numbers and tables


def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    raws = tx.raw_numbers(F.col("claim"))
    return table(spark, d, "task1_gold").select("row_id", F.array_join(raws, " ").alias("raws"), F.size(F.filter(raws, lambda r: F.coalesce(tx.is_specific(r, tx.to_number(r)), F.lit(False)))).cast("bigint").alias("n_specific"))


def claim_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "task1_gold").select("row_id", F.explode(tx.claim_targets(F.col("claim"))).alias("target")))


def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "advisor_cache").select("image_path", F.explode(F.split("text", r" \| ")).alias("cell"))
    c = F.col("cell")
    return cells.groupBy("image_path").agg(F.count_if(tx.has_citation(c)).alias("citations"), F.count_if(tx.is_p_value(c)).alias("p_values"), F.count_if(tx.looks_numeric(c)).alias("numeric"), F.count("*").alias("cells"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """A small table of each order: one row a line, all cells strings. An order has few lines."""
    row = F.struct("l_linenumber", F.array(F.concat("l_returnflag", F.lit(" line "), F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("bigint").cast("string"), F.format_string("%.2f", "l_extendedprice")).alias("cells"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"]).alias("table_values"), F.max("l_quantity").cast("bigint").alias("most"))
    return rows.withColumn("claim", F.concat(F.lit("Table 3 shows that the largest quantity of all lines is "), F.col("most").cast("string"), F.lit(" units")))


def grounded_cell(spark: SparkSession, d: str) -> DataFrame:
    cell = perturb.grounded(perturb.numeric_cells(F.col("table_values"), 1), tx.claim_targets(F.col("claim")))
    return _tables(spark, d).select("l_orderkey", cell.alias("c")).where("c is not null").select("l_orderkey", "c.i", "c.j", "c.raw")


def cell_edit(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d).withColumn("e", perturb.cell_edit(F.col("table_values"), F.col("claim"), 3.0)).where("e.at is not null")
    after = perturb.set_number(F.col("table_values"), F.col("e.at"), F.col("e.new"))
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), ";")
    return t.select("l_orderkey", F.col("e.new").alias("new"), F.col("e.grounded").alias("grounded"), flat(after).alias("after"))


def column_scale(spark: SparkSession, d: str) -> DataFrame:
    price = F.get(F.get("table_values", F.lit(0)), F.lit(2))
    claim = F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.lit("As Table 2 shows, the price was "), price, F.lit(" at first"))).otherwise("")
    t = _tables(spark, d).withColumn("s", perturb.column_scale(F.col("table_values"), claim, F.lit(10.0))).where("s is not null")
    return t.select("l_orderkey", F.col("s.column").alias("column_no"), "s.grounded", F.array_join(F.transform(F.col("s.scaled"), lambda r: F.array_join(r, ",")), ";").alias("after"))


def row_swap(spark: SparkSession, d: str) -> DataFrame:
    claim = F.concat("claim", F.when(F.col("l_orderkey") % 3 == 0, ", most of them in R line 2").otherwise(""))
    t = _tables(spark, d).withColumn("s", perturb.row_swap(F.col("table_values"), claim, F.col("l_orderkey"))).where("s is not null")
    return t.select("l_orderkey", "s.i", "s.j", "s.grounded", F.array_join(F.transform(perturb.swap_rows(F.col("table_values"), F.col("s.i"), F.col("s.j")), lambda r: F.array_join(r, ",")), ";").alias("after"))


def caption_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task1_gold").select("row_id", perturb.caption_number(F.col("caption"), F.col("claim")).alias("n")).where("n is not null").select("row_id", "n.k", "n.raw", "n.grounded")


def perturbed_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d).withColumn("table_caption", F.concat(F.lit("Table 3. Quantities of order, total "), F.col("most").cast("string"), F.lit(".5 units")))
    out = perturb.perturb(rows, ["l_orderkey"])
    return out.select("l_orderkey", "operation", "grounded", F.array_join(F.transform("perturbed_table_values", lambda r: F.array_join(r, ",")), ";").alias("after"), "perturbed_caption")


# Training records


def _perturbed(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "task1_gold")
    refuted = F.when(F.col("operation") != "Supported_claim_only", F.concat(F.lit("perturbed/"), F.col("evi_path")))
    return g.select(F.col("claim_id").alias("pmcid"), F.col("row_id").alias("idx"), "claim", "context", "caption", F.when(F.col("operation") == "Caption adjustments", F.upper("caption")).alias("perturbed_caption"), F.col("evi_path").alias("evidence"), refuted.alias("perturbed_evidence"), "operation", "evi_type", "domain")


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return training.task1_records(_perturbed(spark, d)).select("claim_id", "label", "claim_id_pair", "caption", "operation", "evi_path")


def evidence_side(spark: SparkSession, d: str) -> DataFrame:
    return training.evidence_sides(_perturbed(spark, d), "fig_").select("sample_id", "evidence_id_1", "evidence_id_2", "label")


def training_union(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "task1_gold").select("claim", "label", F.lit("task1").alias("kind"), "operation")
    two = table(spark, d, "task2_gold").select("claim", "label", F.lit("task2").alias("kind"))
    return merge.concat([one, two], "part").groupBy("kind", "part", "label").agg(F.count("*").alias("n"), F.count("operation").alias("n_operation"))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "task1_gold").where("claim_id_pair is not null").select("row_id", "claim_id_pair")
    return training.holdout(rows, "claim_id_pair", 100).where("held_out").select("row_id", "claim_id_pair")


# Figures


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of each order, one a line: width and height from quantity and discount, confidence from the tax."""
    w, h = F.col("l_quantity") * 10, F.round(F.col("l_discount") * 1000) + 50
    box = F.struct(F.col("l_linenumber").alias("n"), F.concat("l_returnflag", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber").cast("string")).otherwise("")).alias("text"), (F.lit(0.3) + F.col("l_tax")).alias("conf"), (F.col("l_linenumber") * 8.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_linenumber") * 8.0 + w).alias("x1"), h.alias("y1"), w.alias("w"), h.alias("h"), F.lit(0.0).alias("cx"), (F.col("l_linenumber") * 40.0).alias("cy"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def swappable_pairs(spark: SparkSession, d: str) -> DataFrame:
    panels = F.transform("boxes", lambda b: F.struct(*[b[k].cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")]))
    return _boxes(spark, d).select("l_orderkey", F.explode(figures.swappable_pairs(panels)).alias("p")).select("l_orderkey", "p.i", "p.j")


def category_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("l_orderkey", F.explode(figures.category_pairs(figures.confident(F.col("boxes")))).alias("p")).select("l_orderkey", "p.i", "p.j")


def size_caps(spark: SparkSession, d: str) -> DataFrame:
    h, w = F.col("l_quantity") * 100, F.col("l_extendedprice") / 10 + 1
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", figures.cap_side(h, w).alias("by_side"), figures.cap_pixels(h, w).alias("by_pixels"), figures.cap_box(h, w).alias("by_box"))
    return rounded(out)


def table_layout(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).select("l_orderkey", F.array_join(figures.table_layout(F.col("table_values")), ",").alias("widths"))


# Decisions


def decide_pair(spark: SparkSession, d: str) -> DataFrame:
    p = predictions1(spark, d)
    of = lambda run, name: p.where(F.col("run_name") == run).select("claim_id", F.col("pred_label").alias(name))
    rows = of("solo_reader", "one").join(of("two_step_reader", "two"), "claim_id")
    last = F.ascii(F.right("claim_id", F.lit(1)))
    joint = F.when(last % 3 == 0, "evidence_id_2").when(last % 3 == 1, "evidence_id_1")  # null for the rest: no joint answer could be read
    decided = infer.decide_pair(F.col("one"), F.col("two"), joint)
    return rows.select("claim_id", decided.alias("x"), infer.needs_joint(F.col("one"), F.col("two")).alias("joint_call")).select("claim_id", "x.label", "x.mode", "joint_call")


def decision_modes(spark: SparkSession, d: str) -> DataFrame:
    return infer.mode_counts(decide_pair(spark, d).select("label", "mode", F.when(F.ascii(F.right("claim_id", F.lit(1))) % 2 == 0, "evidence_id_1").otherwise("evidence_id_2").alias("gold_label")))


def formatted_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = scoring.evidence_accuracy(scoring.answered(gold2(spark, d), predictions2(spark, d), "sample_id"), ["run_name"])
    return scores.select("run_name", tx.percent(F.floor(F.col("accuracy") * 1000) / 1000, 1).alias("accuracy"))


def figure_classes(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 5 == 0, "no json here").otherwise(F.concat(F.lit("Here: {\"num_panels\": "), F.get_json_object("props", "$.k"), F.lit(", \"type\": \""), F.col("event_type"), F.lit("\", \"confidence\": 0.5} done")))
    return table(spark, d, "events").select("event_id", infer.figure_class(reply).alias("x")).select("event_id", "x.*")


def echo_inference(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "task1_gold").where("claim is not null").select("row_id", F.concat(F.lit("Read this.\n"), F.regexp_replace("claim", r"\s+", " ")).alias("prompt"))
    return infer.infer(requests, infer.Echo, "echo", ["prompt"]).select("row_id", "answer", "error")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("evi_path")
    return table(spark, d, "task1_gold").where("evi_path is not null").select("row_id", tx.stem(p).alias("stem"), tx.extension(p).alias("extension"), tx.canonical_path(F.concat(F.lit("./"), F.regexp_replace(p, "/", "//"))).alias("path"), tx.url_quote(F.concat(F.lit("a b/"), F.coalesce("operation", F.lit("")))).alias("encoded"))


def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Predictions worked through as a stream, twice; the second run has nothing to do."""
    import uuid

    from factloom.session import shared_dir
    from factloom.streaming import resume

    base = f"{shared_dir(spark)}/factloom-stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "task1_pred").schema
    label = lambda batch: batch.withColumn("label", F.initcap("pred_label"))
    for _ in range(2):
        resume.run_available(spark, f"{d}/task1_pred.parquet*", schema, label, f"{base}/out", f"{base}/state", format="parquet")
    return resume.results(spark, f"{base}/out").select("run_name", "claim_id", "predicted_at", "label")
