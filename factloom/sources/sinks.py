"""Sinks. Results are written by the executors; only the single-file export goes through the driver, row by row."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame, path: str) -> None:
    """A folder of JSON arrays, one a partition, written by the executors row by row; nulls are kept."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            out = [x for x in ([last] if last is not None else []) + rows]
            first, last = last is None, out.pop() if out else last
            if out or first and last is not None:
                yield pa.RecordBatch.from_arrays([pa.array((["["] if first else []) + [f"{x}," for x in out], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if last is None else [last, "]"], pa.string())], names=["value"])

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def json_array_file(df: DataFrame, path: str) -> int:
    """One pretty JSON array in one file, for small exports that a tool reads as a whole. Rows are streamed, never held together."""
    n = 0
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as out:
        out.write("[")
        for row in df.toLocalIterator():
            out.write(",\n" if n else "\n")
            out.write("\n".join("  " + line for line in json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=False, default=str).split("\n")))
            n += 1
        out.write("\n]\n" if n else "]\n")
    os.replace(part, path)
    return n


def id_list(df: DataFrame, key: str, path: str) -> None:
    df.select(F.col(key).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """CSV with a header; spreadsheets open it. White space around values is kept."""
    df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def partitioned(df: DataFrame, path: str, by: str, buckets: int = 64) -> None:
    """Parquet in folders by a hash of the key: a document cache without one file a document."""
    df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def files(df: DataFrame, folder: str, name: str = "name", data: str = "data") -> None:
    """One file a row, written by the executors into a folder that they share. A rerun overwrites with the same content."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, os.path.basename(row[name]))
            with open(f"{target}.{os.getpid()}", "wb") as out:
                out.write(row[data])
            os.replace(out.name, target)

    df.select(name, data).where(F.col(data).isNotNull()).foreachPartition(write)


def as_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys..., metric, value) of a wide report: what a printed report has, as rows."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "metric", "value")
