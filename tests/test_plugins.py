"""A user's own grouping and variety functions, and the ledger of file digests."""

import hashlib
import os

import pytest

from evalspark.operators.plugins import Deduper, DiversityScorer, group_images, score_diversity
from evalspark.operators.scoring import Registry
from evalspark.sources import ledger
from evalspark.sources.ledger import DigestLedger


def images(spark):
    rows = [("a", i, "xyx"[i % 3], i % 2) for i in range(9)] + [("b", 0, "x", 0), ("c", 1, None, 1), ("c", 0, None, 1)]
    return spark.createDataFrame(rows, "run_id string, ordinal int, look string, half int").repartition(3)


def looks():
    return lambda rows: rows["look"].fillna("-").factorize()[0].tolist()  # travels by value


def test_a_function_labels_the_images_of_a_run(spark):
    deduper = Deduper("looks", looks(), version="1")
    got = {(r.run_id, r.ordinal): r.duplicate_group for r in group_images(images(spark), deduper).collect()}
    assert [got["a", i] for i in range(9)] == [0, 1, 0] * 3 and got["b", 0] == 0 and got["c", 0] == got["c", 1] == 0 and len(got) == 12
    listed = Registry().add(deduper).listing(spark).first()
    assert (listed.metric, listed.available) == ("duplicate_group", True)


def test_without_a_deduper_each_image_is_a_group(spark):
    def gone():
        raise ImportError

    for none in (None, Deduper("gone", looks(), probe=gone)):
        assert all(r.duplicate_group == r.ordinal for r in group_images(images(spark), none).collect())
    assert all(r.diversity is None for r in score_diversity(images(spark), DiversityScorer("gone", len, probe=gone)).collect())


def test_labels_are_counted_and_large_runs_refused_or_split(spark):
    with pytest.raises(Exception, match="labels for"):
        group_images(images(spark), Deduper("short", lambda rows: [0])).collect()
    with pytest.raises(Exception, match="more than 5 images"):
        group_images(images(spark), Deduper("looks", looks()), most=5).collect()
    got = {(r.run_id, r.ordinal): r.duplicate_group for r in group_images(images(spark), Deduper("looks", looks()), split="half", most=5).collect()}
    first = {}
    for r in sorted(images(spark).collect()):
        assert got[r.run_id, r.ordinal] == first.setdefault((r.run_id, r.half, r.look), r.ordinal)


def test_variety_lies_within_bounds(spark):
    share = DiversityScorer("looks", lambda rows: rows["look"].nunique() / len(rows) if rows["look"].notna().any() else None)
    assert {r.run_id: r.diversity for r in score_diversity(images(spark), share).collect()} == {"a": pytest.approx(2 / 9), "b": 1.0, "c": None}
    for bad in (1.5, float("nan")):
        with pytest.raises(Exception, match="not within"):
            score_diversity(images(spark), DiversityScorer("wide", lambda rows, bad=bad: bad)).collect()


def test_a_file_is_read_in_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK", 7)
    (tmp_path / "f").write_bytes(b"0123456789" * 9)
    assert ledger._digest(str(tmp_path / "f")) == hashlib.sha256(b"0123456789" * 9).hexdigest() and ledger._digest(str(tmp_path / "none")) is None


def test_a_file_is_read_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}").write_bytes(bytes([i]) * i * 10)
    paths = spark.createDataFrame([(str(folder / f"f{i}"),) for i in (0, 1, 2, 3, 4, 4)] + [(str(folder / "missing"),), (str(folder),), (None,)], "path string")
    held = DigestLedger(spark, f"{tmp_path}/ledger")

    def scan():
        return {os.path.basename(r.path): (r.length, r.sha256) for r in held.scan(paths).collect()}

    want = {f"f{i}": (10 * i, hashlib.sha256(bytes([i]) * i * 10).hexdigest()) for i in range(5)} | {"missing": (-1, None), "files": (-1, None)}
    assert scan() == want and held.store.version() == 1
    # Other bytes under the same length and time: nobody opens the file, so nobody notices.
    times = os.stat(folder / "f3")
    (folder / "f3").write_bytes(b"x" * 30)
    os.utime(folder / "f3", ns=(times.st_atime_ns, times.st_mtime_ns))
    assert scan() == want and held.store.version() == 1
    os.utime(folder / "f3", ns=(times.st_atime_ns, times.st_mtime_ns + 1000))
    (folder / "f4").write_bytes(b"longer than before, by far and away: yes")
    os.utime(folder / "f4", ns=(5, 10**9))
    assert scan() == want | {"f3": (30, hashlib.sha256(b"x" * 30).hexdigest()), "f4": (40, hashlib.sha256(b"longer than before, by far and away: yes").hexdigest())} and held.store.version() == 2


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)  # a hole: no disk is used
    whole, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        whole.update(zeros)
    whole.update(bytes(size & ((1 << 20) - 1)))
    row = DigestLedger(spark, f"{tmp_path}/ledger").scan(spark.createDataFrame([(str(tmp_path / "large"),)], "path string")).first()
    assert (row.length, row.sha256) == (size, whole.hexdigest())
