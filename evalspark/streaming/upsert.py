"""Run statistics that arrive as files, folded into a latest-wins store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crossrun import latest


def follow(spark: SparkSession, inbox: str, schema: str, log: str, checkpoint: str):
    """Start a query that appends each micro-batch of Parquet files to the log, marked with its number; it ends when all files are read."""

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites its own folder.
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{log}/batch_number={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """The latest row of each run; a late row replaces an earlier one."""
    return latest(spark.read.parquet(log).drop("batch_number"), "batch", "ord").drop("batch", "ord")
