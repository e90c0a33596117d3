"""The data source of run folders against the file reader."""

import pytest

from evalspark.sources import files
from evalspark.sources.runs import register


@pytest.fixture
def root(spark, tmp_path):
    for run in ("a", "b", "_c", "d.e", "0"):
        (tmp_path / run / "deep").mkdir(parents=True)
        (tmp_path / run / "manifest.json").write_text('{"run_id": "%s"}' % run)
        (tmp_path / run / "deep" / "x.PNG").write_bytes(b"\x89PNG")
        (tmp_path / run / "_note.txt").write_text("note")
        (tmp_path / run / ".empty").write_bytes(b"")
    (tmp_path / "top.json").write_text("[]")
    (tmp_path / "none").mkdir()
    register(spark)
    yield tmp_path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(frame):
    return sorted((r.rel, r.name, r.stem, r.ending, r.length, r.modified.replace(microsecond=0), bytes(r.content)) for r in frame.collect())


def test_all_files_as_the_file_reader_has_them(spark, root):
    held = spark.read.format("run_folders").option("shares", 3).load(str(root))
    assert rows(held) == rows(files.files(spark, str(root), hidden=True)) and held.count() == 21
    assert {r.run_id for r in held.collect()} == {"a", "b", "_c", "d.e", "0", None}
    bare = spark.read.format("run_folders").option("content", "false").load(str(root)).collect()
    assert len(bare) == 21 and all(r.content is None for r in bare)


def test_filters_reach_the_source(spark, root):
    held = spark.read.format("run_folders").load(str(root))
    one = held.where("run_id = 'd.e' and name = 'manifest.json'")
    # The share of the named run alone is read; without a filter all shares are.
    assert held.rdd.getNumPartitions() == 64
    assert [bytes(r.content) for r in one.collect()] == [b'{"run_id": "d.e"}'] and one.rdd.getNumPartitions() == 1
    some = held.where("run_id in ('a', '_c', 'gone', 'a/deep', '..')")
    assert sorted({r.run_id for r in some.collect()}) == ["_c", "a"] and some.count() == 8
    (root / "b" / "manifest.json").chmod(0)  # the filter keeps the other runs' files closed
    assert held.where("run_id = 'a'").count() == 4
    assert held.where("run_id is null").count() == 1 and held.where("run_id > 'a' and length = 0").count() == 2
