"""Scans. Schemas are given, never inferred; a missing key and a JSON null both read as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import text as tx


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that hold one JSON array (or object) each, however it is laid out."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """One record a line; only line feeds part lines, blank ones are skipped."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def advisor_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache with one row a path, the last one winning; empty if there is no file yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.ADVISOR_CACHE)
    rows = json_lines(spark, path, schemas.ADVISOR_CACHE).withColumn("_n", F.monotonically_increasing_id())
    last = rows.withColumn("image_path", tx.canonical_path(F.col("image_path"))).groupBy("image_path").agg(F.max_by(F.struct("advisor", "evi_type", "text"), "_n").alias("x"))
    return last.select("image_path", "x.*")


def id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """Distinct ids, one a line."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias(name)).where(F.col(name) != "").distinct()


def documents_of(spark: SparkSession, folder: str, candidates: DataFrame) -> DataFrame:
    """The candidates' documents from a folder of one JSON file each; candidates without a file are left out."""
    return json_array(spark, folder, schemas.DOCUMENT).join(candidates.select("pmcid").distinct(), "pmcid", "left_semi")


def prediction_files(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Predictions of all files of a pattern, with the file's name as `model`."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.withColumn("model", tx.stem(F.col("_metadata.file_name")))


def json_map(spark: SparkSession, path: str, value: T.DataType, key: str = "key") -> DataFrame:
    """Entries of files that hold one JSON object each whose values are records: (key, *fields)."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias(key, "x"))
    return entries.select(key, "x.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, channels, data) of images, pixels in BGR order; files that aren't images are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        tx.base_name(F.col("image.origin")).alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width) only: the pixels are pruned from the plan."""
    return images(spark, path).select("image_id", "height", "width")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def with_files(rows: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Rows whose path, compared without `.` steps and doubled slashes, is in a listing of paths (column `path`)."""
    there = listing.select(tx.canonical_path(F.col("path")).alias("_path")).distinct()
    return rows.withColumn("_path", tx.canonical_path(F.col(column))).join(there, "_path", "left_semi").drop("_path")


def evidence_paths(task1: DataFrame, task2: DataFrame, figures_only: bool = False) -> DataFrame:
    """Distinct evidence paths of both tasks (task 2 names two a row), in order."""
    one = task1.select(F.col("evi_path").alias("path"))
    two = task2.select(F.explode(F.array("evidence_id_1", "evidence_id_2")).alias("path"))
    both = one.union(two).where("path is not null and path <> ''").distinct()
    return (both.where(F.col("path").startswith("figures/")) if figures_only else both).orderBy("path")


def bucket_listing(spark: SparkSession, xml: DataFrame, column: str = "xml") -> DataFrame:
    """(key, size) of object-store listings in XML, one document a row."""
    kind = "struct<Contents:array<struct<Key:string,Size:bigint>>>"
    entries = xml.select(F.explode(F.from_xml(column, kind)["Contents"]).alias("x"))
    return entries.select(F.col("x.Key").alias("key"), F.col("x.Size").alias("size"))


def template(path: str) -> str:
    """A prompt template from a text file: read, never executed."""
    with open(path, encoding="utf-8") as f:
        return f.read()
