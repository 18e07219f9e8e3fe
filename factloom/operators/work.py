"""What is left to do: selections in a stated order, and ledgers of finished work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Selection:
    """Steps applied in the order they are called; `ordinal` is the input order.

    Selection(rows, "n").only_ids(ids, "id").shard(0, 4).limit(100).resume(done, ["id"]).rows
    """

    def __init__(self, rows: DataFrame, ordinal: str) -> None:
        self.rows, self.ordinal = rows, ordinal

    def _next(self, rows: DataFrame) -> Selection:
        return Selection(rows, self.ordinal)

    def where(self, condition: Column | str) -> Selection:
        return self._next(self.rows.where(condition))

    def only_ids(self, ids: DataFrame, key: str) -> Selection:
        return self._next(self.rows.join(ids.select(key).distinct(), key, "left_semi"))

    def shard(self, i: int, n: int) -> Selection:
        """Every n-th of the rows that are left, from the i-th."""
        return self._next(strided(self.rows, self.ordinal, i, n))

    def limit(self, n: int) -> Selection:
        """The first n rows in input order."""
        return self._next(self.rows.orderBy(self.ordinal).limit(n))

    def resume(self, done: DataFrame, keys: list[str]) -> Selection:
        return self._next(remaining(self.rows, done, keys))


def positions(rows: DataFrame, order: list[str], name: str = "position", chunks: int = 64) -> DataFrame:
    """Rows with their place (from 0) in a total order, without one task seeing all rows.

    The rows are range-partitioned and numbered within their range; the ranges' sizes, one number a partition, are added up.
    """
    ranged = rows.repartitionByRange(chunks, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")  # `chunks` rows


def strided(rows: DataFrame, ordinal: str, i: int, n: int) -> DataFrame:
    return positions(rows, [ordinal], "_place").where(F.col("_place") % n == i).drop("_place")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the ledger doesn't have. Rows that were skipped are in no ledger and come again; rows recorded as not found don't."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def shard_remaining(rows: DataFrame, main: DataFrame, shard: DataFrame, keys: list[str]) -> DataFrame:
    """What a shard's process has left: rows that neither the main results nor the shard's own file have. Only the latter grows."""
    return remaining(rows, main.select(*keys).union(shard.select(*keys)), keys)


def process(rows: DataFrame, ledger_path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do the work that the ledger (a parquet table) lacks, append it, and return the whole ledger. A second run does nothing."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(ledger_path)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = remaining(rows, spark.read.parquet(ledger_path), keys)
    work(rows).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)
