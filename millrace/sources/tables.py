"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repeated keys up to which they are broadcast: a key takes some 30 bytes there, so 30 MB.
REPEATED = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of key, where repeated deliveries are equal in all columns.

    The keys that repeat are found first, from the key's column alone. Up to REPEATED of them are broadcast: only their
    rows are shuffled, all others pass where they are. Beyond that, every row is shuffled once. Rows with a null key are
    left out, as nothing can be told of them.
    """
    own = df.filter(F.col(key).isNotNull())
    again = own.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key).limit(REPEATED + 1).toArrow()
    if not again.num_rows:
        return own
    if again.num_rows > REPEATED:
        return own.dropDuplicates([key])
    keys = F.broadcast(df.sparkSession.createDataFrame(again))
    return own.join(keys, key, "left_anti").unionByName(own.join(keys, key, "left_semi").dropDuplicates([key]))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer partitions than there are cores, over all cores by key, before much work on each row; any other as it is.

    To be called on a scan, whose partitions are known without running anything. Rows of one key lie together
    afterwards, so what is grouped by that key and more needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
