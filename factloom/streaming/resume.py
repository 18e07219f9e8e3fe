"""Runs that can be broken off and taken up again, on Structured Streaming.

A folder of input files is a stream; its checkpoint knows which files are done. `availableNow` works through what
is there and stops, so a rerun sees only new files and does nothing if there are none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def run_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int = 100,
    format: str = "json",
) -> int:
    """Work through all new files of a folder and append the results to a parquet table; returns the rows that came in.

    Each batch is written under its number, replacing what a broken-off attempt at the same batch left: every input file
    counts exactly once, however often the run is killed.
    """
    rows_in = 0
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(source)

    def write(batch: DataFrame, number: int) -> None:
        nonlocal rows_in
        rows_in += batch.count()  # the query's own progress reports are kept for the last batches only
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows_in


def results(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(target)
