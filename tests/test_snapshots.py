"""The shared store: nothing is lost between writers, nothing half-written is read, nothing counts twice."""

import threading

import pytest
from pyspark.sql import functions as F

from evalspark.sources.snapshots import Conflict, SnapshotStore

REPORT = "run_id string, images array<struct<image_id:string,rating:int>>"


def together(*jobs):
    failed, barrier = [], threading.Barrier(len(jobs))

    def run(job):
        barrier.wait()
        try:
            job()
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed


def test_eight_reviewers_of_one_run_lose_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.append(spark.createDataFrame([("r", [(f"i{k}", None) for k in range(8)]), ("other", [])], REPORT))

    def rate(k):
        rated = lambda i: F.when(i["image_id"] == f"i{k}", F.struct(i["image_id"].alias("image_id"), F.lit(5).alias("rating"))).otherwise(i)
        SnapshotStore(spark, str(tmp_path)).update(["r"], lambda rows: rows.withColumn("images", F.transform("images", rated)))

    together(*[lambda k=k: rate(k) for k in range(8)])
    held = {r.run_id: r.images for r in store.current().collect()}
    assert [(i.image_id, i.rating) for i in held["r"]] == [(f"i{k}", 5) for k in range(8)] and held["other"] == []
    assert store.version() == 9


def test_eight_appenders_and_a_merge(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), merged_after=3)
    table = lambda k: spark.createDataFrame([(f"r{k}", k), ("shared", k)], "run_id string, n int")
    together(*[lambda k=k: SnapshotStore(spark, str(tmp_path), merged_after=3).append(table(k)) for k in range(8)])
    held = {r.run_id: r.n for r in store.current().collect()}
    assert {k: v for k, v in held.items() if k != "shared"} == {f"r{k}": k for k in range(8)} and held["shared"] in range(8)
    assert len(store.snapshot().parts) <= 8
    store.merge()
    assert {r.run_id: r.n for r in store.current().collect()} == held
    # The order of commits outlives the merge.
    store.append(spark.createDataFrame([("shared", 99)], "run_id string, n int"))
    assert {r.run_id: r.n for r in store.current().collect()} == held | {"shared": 99}


def test_unfinished_writes_are_invisible(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.current() is None and store.version() == 0
    rows = spark.createDataFrame([("a", 1)], "run_id string, n int")
    store.append(rows)
    # Rows of a writer that ended before its commit, and a draft that was never given its name.
    spark.createDataFrame([("a", 2), ("b", 2)], "run_id string, n int").write.parquet(f"{tmp_path}/data/{'0' * 32}")
    (tmp_path / "log" / ".abc.draft").write_text('{"parts": [')
    assert [tuple(r) for r in store.current().collect()] == [("a", 1)] and store.version() == 1
    assert store.append(rows) == 2


def test_a_writer_that_comes_second_takes_the_next_number(spark, tmp_path, monkeypatch):
    store, other = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    schema = "run_id string, n int"
    store.append(spark.createDataFrame([("a", 1), ("b", 1)], schema))
    calls = []

    def change(rows):
        calls.append(1)
        if len(calls) == 1:  # meanwhile: a run that this update reads, and one that it does not
            other.update(["b"], lambda r: r.withColumn("n", F.lit(7)))
            other.update(["a"], lambda r: r.withColumn("n", F.col("n") + 10))
        return rows.withColumn("n", F.col("n") + 1)

    assert store.update(["a"], change) == 4
    assert len(calls) == 2 and {r.run_id: r.n for r in store.current().collect()} == {"a": 12, "b": 7}
    assert {r.run_id: r.n for r in store.current(2).collect()} == {"a": 1, "b": 7}  # an earlier snapshot stays readable
    calls.clear()

    def apart(rows):
        calls.append(1)
        if len(calls) == 1:
            other.update(["b"], lambda r: r.withColumn("n", F.lit(8)))
        return rows.withColumn("n", F.col("n") + 1)

    store.update(["a"], apart)  # another run's commit does not make it be done again
    assert len(calls) == 1 and {r.run_id: r.n for r in store.current().collect()} == {"a": 13, "b": 8}
    monkeypatch.setattr(SnapshotStore, "_moved", lambda *_: False)
    with pytest.raises(Conflict):
        SnapshotStore(spark, str(tmp_path), attempts=2).append(spark.createDataFrame([("c", 1)], schema))


def test_columns_may_come_and_widen(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.append(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int"))
    store.append(spark.createDataFrame([("b", 2.5, "x y", 1), ("b", 3.5, "z", 2), ("c", 1.0, None, 0)], "run_id string, n double, `odd name` string, ord long"))
    assert {r.run_id: (r.n, r["odd name"]) for r in store.current().collect()} == {"a": (1.0, None), "b": (3.5, "z"), "c": (1.0, None)}


def test_a_source_counts_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([("a", n)], "run_id string, n int")
    assert [store.append(rows(1), ("stream", 0)), store.append(rows(2), ("stream", 1)), store.append(rows(1), ("stream", 0)), store.append(rows(3), ("other", 0))] == [1, 2, 2, 3]
    assert [r.n for r in store.current().collect()] == [3] and store.snapshot().sources == {"stream": 1, "other": 0}
