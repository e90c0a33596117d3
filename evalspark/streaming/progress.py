"""Progress of running evaluations as keyed state: frames of many runs, folded into one current row a run.

Frames say that a run has started, that images have landed, how many are done,
that scoring has begun, and that the run is complete or has failed. They may come
late, twice and in any order: each kind of fact is folded by its own rule, in
which order plays no part. What counts is a frame's number in its run, ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.snapshots import SnapshotStore

FRAME = "run_id string, seq long, ts timestamp, type string, total long, completed long, image_id string, message string"
CURRENT = "run_id string, seq long, status string, total long, completed long, n_images long, message string, last_ms long"
#: So many images of a run are told apart in memory before the state is asked.
REMEMBERED = 100_000
# What a run's status is after its latest frame of a kind.
STATUS = {"start": "running", "image": "running", "progress": "running", "scoring": "scoring", "done": "scoring", "complete": "complete", "error": "error"}
ENDED = ("complete", "error")
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunProgress(StatefulProcessor):
    """The state of a run: its latest frame, the latest total, the most images done, and the images that have landed.

    Images are kept one by one, so that a repeated frame does not count again. A
    run that has not ended and sends nothing for ``silence_ms`` of event time is
    reported as silent; one that has ended is forgotten after that time.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "seq long, status string, message string, total_seq long, total long, completed long, n_images long, last_ms long, timer_ms long")
        self.images = handle.getMapState("images", "image_id string", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.run.get()
        seq, status, message, total_seq, total, completed, n_images, last_ms, timer_ms = held or (-1, None, None, -1, None, None, 0, 0, None)
        # Each call of the state goes to the JVM, so what is new in this batch is told apart here first.
        known, fresh = n_images > 0, set()
        for f in rows:
            if f.type not in STATUS or f.seq is None:
                continue
            if f.seq > seq:
                seq, status = f.seq, STATUS[f.type]
                message = f.message if status == "error" else None
            if f.total is not None and f.seq > total_seq:
                total_seq, total = f.seq, f.total
            if f.completed is not None:
                completed = max(completed or 0, f.completed)
            if f.type == "image" and f.image_id is not None and f.image_id not in fresh:
                if not known or not self.images.containsKey((f.image_id,)):
                    self.images.updateValue((f.image_id,), (f.seq,))
                    n_images += 1
                fresh.add(f.image_id)
                if len(fresh) >= REMEMBERED:
                    known, fresh = True, set()
            last_ms = max(last_ms, f.ms or 0)
        if status is None:
            return
        if timer_ms != last_ms + self.silence_ms:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            timer_ms = last_ms + self.silence_ms
            self.handle.registerTimer(timer_ms)
        held = (seq, status, message, total_seq, total, completed, n_images, last_ms, timer_ms)
        self.run.update(held)
        yield self._row(key, status, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.run.get()
        if held is None:
            return
        if held[1] in ENDED:
            self.run.clear()
            self.images.clear()
        else:
            yield self._row(key, "silent", held)

    def _row(self, key, status: str, held: tuple) -> Row:
        seq, _, message, _, total, completed, n_images, last_ms, _ = held
        return Row(run_id=key[0], seq=seq, status=status, total=total, completed=completed, n_images=n_images, message=message, last_ms=last_ms)

    def close(self) -> None:
        pass


def progress(frames: DataFrame, lateness: str = "1 hour", silence_ms: int = 600_000) -> DataFrame:
    """A stream of ``frames`` (columns of FRAME) -> a row of CURRENT, with the time ``last`` for its milliseconds, whenever a run has changed or fallen silent.

    Frames that come more than ``lateness`` of event time behind the latest are
    left out, frames of unknown kind or without a number too.
    """
    runs = frames.where("run_id is not null").withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts")).groupBy("run_id")
    rows = runs.transformWithState(statefulProcessor=RunProgress(silence_ms), outputStructType=CURRENT, outputMode="Update", timeMode="EventTime")
    return rows.withColumn("last", F.timestamp_millis("last_ms")).drop("last_ms")


def follow_progress(spark: SparkSession, inbox: str, store: SnapshotStore, checkpoint: str, name: str = "progress", lateness: str = "1 hour", silence_ms: int = 600_000, batch_bytes: int = 1 << 30):
    """Start a query that keeps the current row of each run in ``store``; it ends when all Parquet files of the inbox are read.

    A batch takes files of ``batch_bytes``, as each batch costs a round over all of the state; one that is done again after a failure counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        store.append(batch, source=(name, number))

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state with timers needs it
    try:
        stream = spark.readStream.schema(FRAME).option("maxBytesPerTrigger", batch_bytes).parquet(inbox)
        return progress(stream, lateness, silence_ms).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
