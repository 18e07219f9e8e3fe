"""Files, services, figures and resumable work over the test tables: what is written is read back, whole.

Folders are made below the one that executors share, and go when the session ends.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import text as tx
from factloom.operators import figures, infer, merge, mining, training, work
from factloom.plans.queries import _documents, _perturbed, held_out, predictions1, table
from factloom.session import shared_dir
from factloom.sources import connectors, readers, sinks


def _scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factloom-files-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# Files


def json_array_file(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "gold.json")
    sinks.json_array(table(spark, d, "task1_gold").select(*schemas.TASK1_GOLD.names), path)
    return readers.json_array(spark, path, schemas.TASK1_GOLD).select("claim_id", "paper_id", "claim", "label", "caption", "context", "claim_id_pair")


def json_lines_file(spark: SparkSession, d: str) -> DataFrame:
    path, p = _scratch(spark, "pred.jsonl"), table(spark, d, "task1_pred").select("run_name", "claim_id", "pred_label")
    sinks.json_lines(p.where("run_name = 'solo_reader'"), path)
    sinks.json_lines(p.where("run_name <> 'solo_reader'"), path, append=True)
    missing = readers.json_lines(spark, f"{path}-missing", p.schema, missing_ok=True)
    return readers.json_lines(spark, path, p.schema).union(missing)


def advisor_cache_file(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "cache.jsonl")
    none = readers.advisor_cache(spark, path)  # no file yet
    rows = table(spark, d, "advisor_cache").where("image_path is not null").orderBy("image_path", "text").coalesce(1)  # one file: its last row of a path wins
    sinks.json_lines(rows, path)
    return readers.advisor_cache(spark, path).unionByName(none).select("image_path", "text")


def id_list_file(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "ids.txt")
    sinks.id_list(table(spark, d, "task1_gold").select(F.concat(F.lit(" "), "claim_id_pair").alias("pair")), "pair", path)
    return readers.id_list(spark, path, "pair")


def documents_folder(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "documents")
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.DOCUMENT}
    docs = _documents(spark, d)
    sinks.json_array(docs.select(*[F.col(n) if n in docs.columns else c for n, c in blank.items()]), path)
    wanted = table(spark, d, "task1_gold").where("split = 'dev'").select(F.col("row_id").cast("string").alias("pmcid")).union(spark.createDataFrame([("none",)], "pmcid string"))
    return mining.contents(readers.documents_of(spark, path, wanted)).select("pmcid", "section_title", "content_pos", "tag", "label", "caption")


def prediction_folder(spark: SparkSession, d: str) -> DataFrame:
    """A file of label counts for each run; the run is told from the file's name."""
    path = _scratch(spark, "runs")
    counted = table(spark, d, "task1_pred").groupBy("run_name", F.col("pred_label").alias("label")).agg(F.count("*").alias("n"))
    rows = counted.groupBy("run_name").agg(F.to_json(F.collect_list(F.struct("label", "n")), {"ignoreNullFields": "false"}).alias("data"))  # a few labels a run
    sinks.files(rows.select(F.concat("run_name", F.lit(".json")).alias("name"), F.encode("data", "UTF-8").alias("data")), _local(path))
    return readers.prediction_files(spark, f"{path}/*.json", T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType())]))


def json_map_files(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "classes")
    one = table(spark, d, "advisor_cache").where("image_path is not null").groupBy("image_path").agg(F.max("evi_type").alias("type"), F.max(F.length("text")).alias("num_panels"))
    entry = F.struct("image_path", F.struct(F.col("num_panels").cast("int").alias("num_panels"), "type", F.lit(0.5).alias("confidence")))
    files = one.withColumn("name", F.concat(F.md5("image_path").substr(1, 2), F.lit(".json"))).groupBy("name").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("data"))  # such files hold a folder's images
    sinks.files(files.select("name", F.encode("data", "UTF-8").alias("data")), _local(path))
    return readers.json_map(spark, path, schemas.FIGURE_CLASS, "image_path")


def report_file(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "report")
    counts = table(spark, d, "task1_gold").groupBy("split", "evi_type").agg(F.count("*").alias("n"), F.count("caption").alias("captions"))
    sinks.report(sinks.as_metrics(counts, ["split", "evi_type"]), path)
    return spark.read.option("header", True).schema("split string, evi_type string, metric string, value double").csv(path)


def document_cache(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "cache")
    sinks.partitioned(table(spark, d, "documents").select("doc_id", "source", "n_chars"), path, "doc_id", 8)
    return spark.read.parquet(path).select("doc_id", "source", "n_chars")


def bucket_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings as an object store gives them: pages of keys and sizes in XML."""
    one = F.concat(F.lit("<Contents><Key>"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("</Key><Size>"), F.col("n_chars").cast("string"), F.lit("</Size></Contents>"))
    pages = table(spark, d, "documents").where("n_chars is not null").groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.concat(F.lit("<ListBucketResult>"), F.array_join(F.collect_list(one), ""), F.lit("</ListBucketResult>")).alias("xml"))
    return readers.bucket_listing(spark, pages)


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """An image of each nation, written as PNG and read again: name, size, and its first pixel (blue, green, red)."""
    path = _scratch(spark, "images")

    def drawn(frames):
        for f in frames:
            data = [figures.png(bytes([k, 100, 200]) * ((20 + k) * (10 + 2 * k)), 20 + k, 10 + 2 * k, 3) for k in f["n_nationkey"]]
            yield pd.DataFrame({"name": [f"{k}.png" for k in f["n_nationkey"]], "data": data})

    sinks.files(table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey")).mapInPandas(drawn, "name string, data binary"), _local(path))
    sizes = readers.image_sizes(spark, path)
    pixel = readers.images(spark, path).select("image_id", F.hex(F.substring("data", 1, 3)).alias("pixel"))
    return sizes.join(pixel, "image_id")


# Services


def _numbered(ids: list) -> list[tuple[int, dict]]:
    return [(i, {"pmcid": f"PMC{i * 7}"}) for i in ids if i % 3]


def _lines(ids: list) -> list[tuple[int, bytes]]:
    return [(i, f"content of {i}".encode() * (i % 4)) for i in ids if i % 5]


def _hits(query: str, start: int, size: int) -> list[dict]:
    """Ranked hits of a query: as many as ten times its letters."""
    return [{"pmcid": f"{query}-{i}", "title": f"Result {i}"} for i in range(start, min(start + size, 10 * len(query)))]


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    return connectors.resolve(table(spark, d, "documents").select("doc_id"), "doc_id", "pmcid", _numbered)


def fetched_documents(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of a fetch: what isn't found is kept too, so a second run asks for nothing."""
    path, ids = _scratch(spark, "ledger"), table(spark, d, "documents").select("doc_id")
    for _ in range(2):
        done = work.process(ids, path, ["doc_id"], lambda rows: connectors.fetch(rows, "doc_id", _numbered, batch=50))
    return done.select("doc_id", "found", F.get_json_object("body", "$.pmcid").alias("pmcid"))


def fetched_objects(spark: SparkSession, d: str) -> DataFrame:
    got = connectors.fetch_binary(table(spark, d, "documents").select("doc_id"), "doc_id", _lines)
    return got.select("doc_id", "found", F.length("data").cast("bigint").alias("size"), F.md5("data").alias("digest"))


def searched_pages(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select(F.lower("n_name").alias("query"), F.lit(45).alias("n"))
    return connectors.search_pages(asked, _hits, page=20)


# Work that goes on where it stopped


def first_work(spark: SparkSession, d: str) -> DataFrame:
    """Ids, shard, limit, then resume: in that order."""
    ids = table(spark, d, "task1_pred").where("run_name = 'two_step_reader'")
    done = table(spark, d, "task1_pred").where("run_name = 'solo_reader'")
    picked = work.Selection(held_out(spark, d).select("row_id", "claim_id"), "row_id").only_ids(ids, "claim_id").shard(1, 2).limit(150)
    return picked.resume(done, ["claim_id"]).rows


def shard_resume(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "task1_pred")
    main, shard = p.where("pred_label = 'Supported'"), p.where("run_name = 'two_step_reader' and pred_label = 'Refuted'")
    return work.shard_remaining(held_out(spark, d).select("row_id", "claim_id"), main, shard, ["claim_id"])


def present_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shard files are put together; one that was never written is passed over."""
    base, p = _scratch(spark, "shards"), table(spark, d, "task2_pred")
    p.where("run_name = 'solo_reader'").write.parquet(f"{base}/0")
    p.where("run_name = 'chart_helper'").write.parquet(f"{base}/2")
    return merge.concat(merge.existing(spark, [f"{base}/{i}" for i in range(3)], spark.read.schema(p.schema).parquet)).select("sample_id", "run_name", "pred_label", "shard")


def debug_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each decision beside what led to it, written apart from the predictions."""
    path, p = _scratch(spark, "debug.jsonl"), predictions1(spark, d)
    of = lambda run, name: p.where(F.col("run_name") == run).select("claim_id", F.col("pred_label").alias(name))
    rows = of("solo_reader", "one").join(of("two_step_reader", "two"), "claim_id")
    sinks.json_lines(infer.debug_rows(rows, "claim_id", F.col("one"), F.col("two"), F.lit(None).cast("string")), path)
    return readers.json_lines(spark, path, T.StructType.fromDDL("claim_id string, mode string, one string, two string, joint string, label string, calls int"))


# Figures and training records


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A grey image of each order: two blocks of ink with a gap between, widths and gap by the order's key; two words read in it."""

    def drawn(frames):
        for f in frames:
            out = []
            for k in f["o_orderkey"]:
                w1, gap, w2 = 20 + k % 7, 3 + k % 9, 20 + k % 13
                row = bytes([50]) * w1 + bytes([255]) * gap + bytes([90]) * w2
                box = lambda text, x, conf: {"text": text, "conf": conf, "x0": float(x), "y0": 0.0, "x1": float(x + 8), "y1": 6.0, "w": 8.0, "h": 6.0, "cx": float(x + 4), "cy": 3.0}
                out.append((str(k), 30, len(row), 1, row * 30, [box("low", 0, 0.9), box("high" if k % 2 else "7", 12, 0.9), box("blurred", 30, 0.2)]))
            yield pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "data", "boxes"])

    boxes = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.OCR_BOX)
    return table(spark, d, "orders").select("o_orderkey").mapInPandas(drawn, f"image_id string, height int, width int, channels int, data binary, boxes array<struct<{boxes}>>")


def detected_panels(spark: SparkSession, d: str) -> DataFrame:
    return figures.with_panels(_pages(spark, d)).select("image_id", F.posexplode("panels").alias("n", "p")).select("image_id", "n", "p.*")


def swapped_figures(spark: SparkSession, d: str) -> DataFrame:
    done = figures.swap_figures(_pages(spark, d))
    return done.select("image_id", "operation", F.col("box_a.x0").alias("a0"), F.col("box_a.x1").alias("a1"), F.col("box_b.x0").alias("b0"), F.col("box_b.x1").alias("b1"), F.hex(F.substring("data", 1, 1)).alias("first"))


def figure_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that speak of a figure, with that figure and its file where one was downloaded."""
    number = F.regexp_extract("claim", r"(?i)\b(?:Figures?|Figs?\.?)\s+(\d+)", 1)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CONTENT}
    content = lambda **x: F.struct(*[x.get(k, v).alias(k) for k, v in blank.items()])
    fig = content(tag=F.lit("fig"), label=F.concat(F.lit("Fig. "), number), xref_id=F.concat(F.lit("f"), number), caption=F.col("caption"))
    section = F.struct(F.lit("Results").alias("title"), F.array(content(tag=F.lit("p"), text=F.col("claim")), fig).alias("contents"))
    g = table(spark, d, "task1_gold")
    docs = g.select(F.col("row_id").cast("string").alias("pmcid"), F.lit(1).alias("figures_in_body"), F.array(section).alias("body_sections"))
    files = g.where("row_id % 2 = 0").select(F.col("row_id").cast("string").alias("pmcid"), F.concat(F.lit("f"), number).alias("xref_id"), F.concat(F.lit("figures/"), "row_id").alias("local_path"))
    return mining.with_files(mining.claims(docs, "figure"), files).select("pmcid", "number", "sentence", "xref_id", "local_path")


def joined_training(spark: SparkSession, d: str) -> DataFrame:
    """Normalised claims with their perturbations by document and sentence; those without one give a Supported record only."""
    p = _perturbed(spark, d).withColumn("sentence", F.coalesce("claim", F.lit("")))
    made = p.where("idx % 3 <> 0").select("pmcid", "sentence", "operation", "perturbed_evidence", "perturbed_caption")
    claims = p.drop("operation", "perturbed_evidence", "perturbed_caption")
    return training.task1_records(training.with_perturbations(claims, made), "t_").select("claim_id", "label", "claim_id_pair", "operation", "evi_path")
