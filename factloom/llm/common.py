"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once into the shared folder and read it back. Survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = shared_dir(spark)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def hash_uniform(*cols, seed: int = 0):
    """A number in [0, 1) that depends only on the columns' values and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)) / F.lit(float(1 << 53))
