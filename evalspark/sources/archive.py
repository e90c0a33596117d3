"""The archive of a run: manifest, report, rejects as metadata, and the passing images in a zip."""

from __future__ import annotations

import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_file_name
from ..operators.review import reject_records
from .shared import NewFile, replace_file


_DONE = pa.schema([("run_id", pa.string()), *[(c, pa.int64()) for c in ("n_passed", "n_rejected", "n_pending", "n_zipped")], ("missing", pa.list_(pa.string()))])
#: Lengths, offsets and counts from which the wide form of the format is needed.
WIDE, WIDE_COUNT = 0xFFFFFFFF, 0xFFFF
#: The format's first day; entries carry no time, so that equal runs give equal archives.
DAY = 0x21


class _Zip:
    """Writes deflated entries one after another, and the directory last; of an entry only its directory record is kept."""

    def __init__(self, out):
        self.out, self.at, self.n, self.directory = out, 0, 0, bytearray()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, crc: int, size: int, packed: bytes) -> None:
        raw, offset = name.encode("utf-8"), self.at
        facts = (0x800, 8, 0, DAY, crc, len(packed), size)  # names are UTF-8
        self._write(struct.pack("<4s5H3L2H", b"PK\3\4", 20, *facts, len(raw), 0) + raw)
        self._write(packed)
        wide = struct.pack("<2HQ", 1, 8, offset) if offset >= WIDE else b""
        self.directory += struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if wide else 20, *facts, len(raw), len(wide), 0, 0, 0, 0, min(offset, WIDE)) + raw + wide
        self.n += 1

    def close(self) -> None:
        begin, size = self.at, len(self.directory)
        self._write(bytes(self.directory))
        if self.n >= WIDE_COUNT or begin >= WIDE or size >= WIDE:
            end = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, self.n, self.n, size, begin))
            self._write(struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        count = min(self.n, WIDE_COUNT)
        self._write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, min(size, WIDE), min(begin, WIDE), 0))


class _List:
    """A JSON array, written item by item."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def add(self, item) -> None:
        self.out.write((", " if self.n else "[").encode() + json.dumps(item).encode())
        self.n += 1

    def close(self) -> None:
        self.out.write(b"]" if self.n else b"[]")


class _Run:
    """One run's archive while its images come by; all its files are streams that get their names at the end."""

    def __init__(self, run_id: str, manifest: str | None, folder: str):
        self.run_id, self.folder = run_id, f"{folder}/{run_id}"
        replace_file(f"{self.folder}/manifest.json", (manifest or "{}").encode())
        self.files = {n: NewFile(f"{self.folder}/{n}") for n in ("eval_report.json", "reject_archive.json")}
        self.report, self.rejects = (_List(f.out) for f in self.files.values())
        self.zip: _Zip | None = None
        self.passed = self.pending = 0
        self.missing: list[str] = []

    def add(self, image_id: str, passed: bool | None, reject: str | None, name: str | None, crc: int | None, size: int | None, packed: bytes | None) -> None:
        self.report.add({"image_id": image_id, "passed": passed})
        if reject is not None:
            self.rejects.add(json.loads(reject))
        self.passed += passed is True
        self.pending += passed is None
        if passed is not None and crc is None:
            self.missing.append(image_id)
        if passed and self.zip is None:
            self.files["passing_images.zip"] = NewFile(f"{self.folder}/passing_images.zip")
            self.zip = _Zip(self.files["passing_images.zip"].out)
        if passed and crc is not None:
            self.zip.add(name, crc, size, packed)

    def close(self) -> tuple:
        for part in (self.report, self.rejects, self.zip):
            if part is not None:
                part.close()
        for file in self.files.values():
            file.close()
        return self.run_id, self.passed, self.rejects.n, self.pending, self.zip.n if self.zip else 0, self.missing


def _deflated(batches):
    """``run_id, image_id, passed, reject, manifest, name, content`` with the content's checksum, length and deflated bytes in its place; only passing images are deflated."""
    for batch in batches:
        packed = []
        for passed, content in zip(batch.column("passed").to_pylist(), batch.column("content"), strict=True):
            if content.is_valid:
                data = content.as_py()
                deflate = zlib.compressobj(wbits=-zlib.MAX_WBITS)
                packed.append((zlib.crc32(data), len(data), deflate.compress(data) + deflate.flush() if passed else b""))
            else:
                packed.append((None, None, None))
        columns = [pa.array([p[i] for p in packed], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        kept = batch.drop_columns(["content"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "crc", "size", "packed"])


def write_archives(images: DataFrame, files: DataFrame, manifests: DataFrame, folder: str) -> DataFrame:
    """Write one folder per run and return ``run_id, n_passed, n_rejected, n_pending, n_zipped, missing``.

    ``images(run_id, image_id, passed, ...)``, ``files(image_id, content[, ending])``,
    ``manifests(run_id, ...)``. Images are deflated where they lie; then a run's
    entries come by in order of their ids, and its files are written as they do:
    one entry is held at a time, and of earlier ones their place in the zip. A
    file has its name only when it is whole. A passing image without a file
    counts as passed but is not zipped; ``missing`` names the decided images without
    one. A run without passing images gets no zip. Names in the zip are ids with
    the file's own ending ('png' where none is given). The rejects hold neither ids
    nor paths. ``folder`` is a path or URI that executors share.
    """
    named = images.where(is_file_name(F.col("run_id")))
    reject = F.when(~F.col("passed"), F.to_json(F.struct(*reject_records(named).columns)))
    ending = F.col("ending") if "ending" in files.columns else F.lit("png")
    held = files.select("image_id", "content", ending.alias("ending"))
    rows = named.select("run_id", "image_id", "passed", reject.alias("reject")).join(held, "image_id", "left").join(manifests.select("run_id", F.to_json(F.struct("*")).alias("manifest")), "run_id", "left")
    entry = F.concat(F.col("image_id").cast("string"), F.when(F.coalesce("ending", F.lit("")) != "", F.concat(F.lit("."), "ending")).otherwise(""))
    rows = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("image_id").cast("string").alias("image_id"), "passed", "reject", "manifest", entry.alias("name"), "content")
    packed = rows.mapInArrow(_deflated, "run_id string, image_id string, passed boolean, reject string, manifest string, name string, crc long, size long, packed binary")
    ordered = packed.repartition("run_id").sortWithinPartitions("run_id", "image_id")

    def write(batches):
        run = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if run is None or run.run_id != r["run_id"]:
                    if run is not None:
                        done.append(run.close())
                    run = _Run(r["run_id"], r["manifest"], folder)
                run.add(r["image_id"], r["passed"], r["reject"], r["name"], r["crc"], r["size"], r["packed"])
            yield pa.RecordBatch.from_pylist([dict(zip(_DONE.names, d, strict=True)) for d in done], schema=_DONE)
        if run is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_DONE.names, run.close(), strict=True))], schema=_DONE)

    return ordered.mapInArrow(write, "run_id string, n_passed long, n_rejected long, n_pending long, n_zipped long, missing array<string>")


def loose_images(images: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``path`` of the decided images below ``root``, which may go once they are archived; pending ones and files elsewhere stay."""
    decided = images.where("passed is not null").select("image_id")
    return files.join(decided, "image_id", "left_semi").where(F.col("path").startswith(root.rstrip("/") + "/")).where(~F.array_contains(F.split("path", "/"), "..")).select("path")
