"""Starting, draining and reading back streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import scratch_path


#: So many files are read at once, which bounds what one key can bring in a micro-batch.
FILES_PER_BATCH = 64


def open_stream(spark: SparkSession, folder: str, files: str = "*.parquet",
                files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The Parquet files of a folder that match `files`, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{files}").schema).option("pathGlobFilter", files)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, mode: str, out: str | None = None, checkpoint: str | None = None,
          empty_batches: bool = True) -> DataFrame:
    """Run a stream over all data that is there and return what it wrote, with the batch number.

    Every micro-batch overwrites its own folder, so a batch that is run again
    after a failure leaves no duplicates.  Jobs that wait for the watermark
    need the empty batches after the last data; jobs whose state has a time to
    live would get them without end.  Jobs may sort inside a micro-batch
    (`jobs._in_order`), which Spark's check of streaming plans would refuse.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower(),
                "spark.sql.streaming.unsupportedOperationCheck": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)  # read once, when the query starts
        handle = (
            stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    handle.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", False).parquet(out)


def latest_per_key(written: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: the row of the last batch per key (one small row per key and batch)."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return written.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r", "batch_id")
