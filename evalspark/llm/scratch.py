"""Written intermediate tables, used where a plan's lineage has to be cut.

A job that needs the same rows several times, or that iterates, writes them as
Parquet into the shared folder named by ``spark.checkpoint.dir`` and reads them
back, so that the loss of an executor costs a re-read and never a wrong result.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without the setting, a temporary one."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="evalspark-")
    spark.conf.set(SETTING, folder)
    return folder


class Scratch:
    """A folder of written tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a reader of what was written, with the same schema."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later result reads."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner delete the shuffle files of jobs that have ended."""
        self.spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small, so that long texts cannot fill a Python worker.

    The subpackage's functions travel to executors by value: nothing is installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
