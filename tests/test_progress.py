"""Frames of runs, late, repeated and out of order, folded into one row a run."""

import random
from datetime import datetime, timedelta

from evalspark.sources.snapshots import SnapshotStore
from evalspark.streaming.progress import FRAME, follow_progress

T0 = datetime(2025, 1, 1, 12)


def frame(run, seq, kind, minute=None, total=None, completed=None, image=None, message=None):
    return (run, seq, T0 + timedelta(minutes=seq if minute is None else minute), kind, total, completed, image, message)


def run_of(run, ending):
    frames = [frame(run, 0, "start", total=4)]
    for i in range(4):
        frames += [frame(run, 2 * i + 1, "image", image=f"{run}-{i}"), frame(run, 2 * i + 2, "progress", completed=i + 1, total=4)]
    return [*frames, frame(run, 9, "scoring"), *ending]


def test_frames_in_any_order(spark, tmp_path):
    frames = run_of("good", [frame("good", 10, "complete")]) + run_of("bad", [frame("bad", 10, "error", message="no memory")]) + run_of("open", []) + [frame("open", 5, "unknown"), (None, 1, T0, "start", 9, None, None, None), frame("odd", None, "start", minute=1)]
    random.Random(1).shuffle(frames)
    frames += frames[:12]  # sent again
    store = SnapshotStore(spark, f"{tmp_path}/store")
    for i in range(3):
        spark.createDataFrame(frames[i::3], FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    follow_progress(spark, f"{tmp_path}/inbox", store, f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.run_id: (r.status, r.seq, r.total, r.completed, r.n_images, r.message) for r in store.current().collect()}
    assert got == {"good": ("complete", 10, 4, 4, 4, None), "bad": ("error", 10, 4, 4, 4, "no memory"), "open": ("scoring", 9, 4, 4, 4, None)}
    # Later: one run goes on, another run's frames let event time pass, and the third has been silent too long.
    late = [frame("open", 3, "image", image="open-1"), frame("open", 10, "complete", minute=95), frame("next", 0, "start", total=1, minute=20), frame("clock", 0, "start", total=1, minute=100)]
    spark.createDataFrame(late, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    spark.createDataFrame([frame("clock", 1, "progress", completed=0, minute=200)], FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    follow_progress(spark, f"{tmp_path}/inbox", store, f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.run_id: (r.status, r.seq, r.n_images) for r in store.current().collect()}
    assert got["open"] == ("complete", 10, 4) and got["next"] == ("silent", 0, 0) and got["clock"][0] in ("running", "silent") and got["good"] == ("complete", 10, 4)


def test_settings_are_restored(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.createDataFrame([frame("r", 0, "start", total=1)], FRAME).write.parquet(f"{tmp_path}/inbox")
    query = follow_progress(spark, f"{tmp_path}/inbox", SnapshotStore(spark, f"{tmp_path}/store"), f"{tmp_path}/checkpoint")
    assert spark.conf.get(key, None) == before
    query.awaitTermination()
    assert query.exception() is None


def test_many_files_are_few_batches(spark, tmp_path):
    """A batch costs a round over all of the state, so it is not one a file; a frame without a time still counts."""
    frames = [*run_of("a", []), *run_of("b", []), ("a", 20, None, "image", None, None, "a-9", None)]
    for i in range(4):
        spark.createDataFrame(frames[i::4], FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    store = SnapshotStore(spark, f"{tmp_path}/store")
    follow_progress(spark, f"{tmp_path}/inbox", store, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.version() <= 2  # one batch, and one without data, in which event time passes
    assert {(r.run_id, r.seq, r.n_images, r.completed) for r in store.current().collect()} == {("a", 20, 5, 4), ("b", 9, 4, 4)}
