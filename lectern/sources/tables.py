"""Reading plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables with fewer input splits are small: two gigabytes at the default split size.
SMALL_SPLITS = 16


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Spread a small table that arrives in fewer pieces than there are cores.

    Text jobs cost far more CPU than reading, so one small file should not keep
    all other cores idle.  A table of `SMALL_SPLITS` input splits or more is
    left as it is, however many cores there are: beyond that, ask for smaller
    splits on reading (`spark.sql.files.maxPartitionBytes`), which shuffles
    nothing.  The hash of a key decides the piece, so a retried task sees the
    same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else df
