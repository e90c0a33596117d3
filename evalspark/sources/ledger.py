"""Digests of files that are read once: a shared table keyed by path, length and time of change.

A scan asks the file system for length and time only. Files that the table has
with both are answered from it; the others are opened, read in chunks inside the
workers and added to the table in one commit, which other scans may do meanwhile.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpointed
from .shared import open_store
from .snapshots import SnapshotStore

KEY = ["path", "length", "changed"]
#: Bytes read at once.
CHUNK = 1 << 20


def _fact(path: str) -> tuple[int, int]:
    """Length and time of change in nanoseconds; both -1 where there is no such file."""
    from pyarrow import fs

    try:
        store, place = open_store(path)
        info = store.get_file_info(place)
    except (OSError, ValueError):
        return -1, -1
    return (info.size, info.mtime_ns) if info.type == fs.FileType.File else (-1, -1)


def _facts(batches):
    for batch in batches:
        found = [_fact(p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=KEY)


def _digest(path: str) -> str | None:
    """SHA-256 of a file, of which one chunk is held at a time; None if it has gone."""
    try:
        store, place = open_store(path)
        with store.open_input_stream(place) as file:
            whole = hashlib.sha256()
            while chunk := file.read(CHUNK):
                whole.update(chunk)
            return whole.hexdigest()
    except OSError:
        return None


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(p) for p in batch.column("path").to_pylist()], pa.string())], names=[*KEY, "sha256"])


class DigestLedger:
    """Digests under ``folder``, which any number of scans may share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, SnapshotStore(spark, folder, keys=KEY)

    def scan(self, paths: DataFrame) -> DataFrame:
        """``path, length, changed, sha256`` of each of ``paths(path)``; a missing file has -1, -1 and null.

        Only files that are new, or of another length or time, are opened. A
        repeated path is answered once, a null one not at all.
        """
        facts = checkpointed(paths.select(F.col("path").cast("string").alias("path")).where("path is not null").distinct().mapInArrow(_facts, "path string, length long, changed long"))
        known = self.store.current()
        fresh = facts.where("length >= 0")
        fresh = checkpointed(fresh if known is None else fresh.join(known, KEY, "left_anti"))
        if not fresh.isEmpty():
            # Round robin: how long a file takes has nothing to do with its name.
            spread = fresh.repartition(self.spark.sparkContext.defaultParallelism)
            self.store.append(spread.mapInArrow(_digests, "path string, length long, changed long, sha256 string").where("sha256 is not null"))
            known = self.store.current()
        if known is None:
            return facts.withColumn("sha256", F.lit(None).cast("string"))
        return facts.join(known, KEY, "left")
