"""A store of Parquet parts that many writers may share: each commit is the next snapshot.

A snapshot is a small file in ``log/``, numbered from 1, that lists the parts it
consists of. Rows are written first, under a name of their own in ``data/``;
nobody reads them before a snapshot names them. The commit then creates the file
of the next number, which succeeds for one writer only: a writer that comes
second reads what the other has committed and tries the number after it. Plain
appends need nothing else. An update was made from what it had read, so if a
snapshot between touches the same runs, it is made again from the new one.

Rows keep no trace of the commit; a part's number comes from the snapshot that
added it, and the latest row of a key is that of the highest part, then ``ord``.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Writers of one process take turns at the file; those of others are met by the file system.
_TURN = threading.Lock()


class Conflict(RuntimeError):
    """Other writers were faster in every attempt."""


@dataclass(frozen=True)
class Part:
    """A folder of rows: which snapshot added it, the runs it holds (all may be meant where unknown), and its schema."""

    name: str
    batch: int
    columns: str
    runs: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    parts: tuple[Part, ...] = ()
    #: The highest number each named source has appended under, so that none counts twice.
    sources: dict[str, int] = field(default_factory=dict)


class SnapshotStore:
    """A latest-wins table under ``folder``, keyed by ``keys``; ``merged_after`` parts are made one by the writer who finds more."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ("run_id",), attempts: int = 100, merged_after: int = 64):
        self.spark, self.keys, self.attempts, self.merged_after = spark, tuple(keys), attempts, merged_after
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(folder).getFileSystem(conf)
        self.root = self._system.makeQualified(self._path(folder)).toString().rstrip("/")
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._keep_others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # -- reading -----------------------------------------------------------------

    def version(self) -> int:
        """The number of the last snapshot; 0 where there is none."""
        log = self._path(f"{self.root}/log")
        if not self._system.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._system.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A snapshot, by default the last; an error for a number that was never committed."""
        version = self.version() if version is None else version
        if not version:
            return Snapshot()
        stream = self._system.open(self._path(self._named(version)))
        try:
            body = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()
        parts = tuple(Part(p["name"], p["batch"], p["columns"], None if p["runs"] is None else tuple(p["runs"])) for p in body["parts"])
        return Snapshot(version, parts, body["sources"])

    def history(self, version: int | None = None) -> DataFrame | None:
        """All rows of a snapshot's parts, with the ``batch`` that added each; None for an empty store.

        Parts of one schema are one scan. A column that a part lacks is null, and
        numbers of different width become the wider kind.
        """
        snapshot, out = self.snapshot(version), None
        for columns in sorted({p.columns for p in snapshot.parts}):
            parts = [p for p in snapshot.parts if p.columns == columns]
            rows = self.spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(*[f"{self.root}/data/{p.name}" for p in parts])
            numbers = F.create_map(*[F.lit(x) for p in parts for x in (p.name, p.batch)])  # ``merged_after`` entries at most, or little more
            name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/[^/]*$", 1)
            rows = rows.select("*", numbers[name].cast("long").alias("batch"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def current(self, version: int | None = None) -> DataFrame | None:
        """The latest row of each key; None for an empty store."""
        rows = self.history(version)
        return None if rows is None else self._latest(rows).drop("batch", "ord")

    def _latest(self, rows: DataFrame) -> DataFrame:
        order = F.struct("batch", "ord") if "ord" in rows.columns else F.struct("batch")
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")

    # -- writing -----------------------------------------------------------------

    def append(self, rows: DataFrame, source: tuple[str, int] | None = None) -> int:
        """Add rows, of which the later ``ord`` (if there is such a column) wins within a key; returns the snapshot's number.

        With ``source = (name, number)`` the append counts once: a number not above
        the source's last is left out, and the current version is returned.
        """
        part = None
        for _ in self._attempts():
            base = self.snapshot()
            if source and source[1] <= base.sources.get(source[0], -1):
                return base.version
            part = part or self._written(rows, None)
            sources = base.sources | ({source[0]: source[1]} if source else {})
            if self._committed(base, (*base.parts, self._numbered(part, base)), sources):
                return self._merged(base.version + 1)
        raise Conflict(self.root)

    def update(self, run_ids: Sequence[str] | None, change: Callable[[DataFrame | None], DataFrame]) -> int:
        """Read, change and write the rows of some runs as one step; ``change`` gets their current rows and returns the new ones.

        It is called again when another writer has changed one of the runs since,
        so it must depend on what it is given. The runs are told apart by the
        first key; None names all of them, which any other commit touches. Where
        the store is empty, ``change`` is given None.
        """
        wanted = None if run_ids is None else tuple(sorted({str(r) for r in run_ids}))
        part, read = None, None
        for _ in self._attempts():
            base = self.snapshot()
            if part is None or self._touched(base, read, wanted):
                rows = self.current(base.version)
                if rows is not None and wanted is not None:
                    rows = rows.where(F.col(self.keys[0]).cast("string").isin(*wanted))
                part, read = self._written(change(rows), wanted), base
            if self._committed(base, (*base.parts, self._numbered(part, base)), base.sources):
                return self._merged(base.version + 1)
        raise Conflict(self.root)

    def merge(self) -> int:
        """Write the latest rows of all parts as one part, which takes their place; parts that others add meanwhile stay beside it."""
        base = self.snapshot()
        if len(base.parts) < 2:
            return base.version
        rows = self._latest(self.history(base.version)).drop("batch")
        whole, old = self._written(rows, None), {p.name for p in base.parts}
        whole = Part(whole.name, max(p.batch for p in base.parts), whole.columns)
        for _ in self._attempts():
            now = self.snapshot()
            if not old <= {p.name for p in now.parts}:
                return now.version  # another writer has merged them
            if self._committed(now, (whole, *[p for p in now.parts if p.name not in old]), now.sources):
                return now.version + 1
        raise Conflict(self.root)

    def _merged(self, version: int) -> int:
        return self.merge() if len(self.snapshot(version).parts) > self.merged_after else version

    def _touched(self, now: Snapshot, read: Snapshot, runs: tuple[str, ...] | None) -> bool:
        seen = {p.name for p in read.parts}
        return any(p.runs is None or runs is None or set(p.runs) & set(runs) for p in now.parts if p.name not in seen)

    def _written(self, rows: DataFrame, runs: tuple[str, ...] | None) -> Part:
        name = uuid4().hex
        rows = rows.drop("batch")
        rows.write.parquet(f"{self.root}/data/{name}")
        return Part(name, 0, rows.schema.json(), runs)

    def _numbered(self, part: Part, base: Snapshot) -> Part:
        return Part(part.name, base.version + 1, part.columns, part.runs)

    def _attempts(self):
        for i in range(self.attempts):
            if i:
                time.sleep(random.uniform(0, min(1.0, 0.02 * 2 ** min(i, 6))))
            yield i

    def _named(self, version: int) -> str:
        return f"{self.root}/log/{version:012d}.json"

    def _committed(self, base: Snapshot, parts: Sequence[Part], sources: dict[str, int]) -> bool:
        """Create the next snapshot's file, whole or not at all; False if another writer has it already."""
        body = json.dumps({"parts": [{"name": p.name, "batch": p.batch, "columns": p.columns, "runs": p.runs} for p in parts], "sources": sources})
        target, draft = self._path(self._named(base.version + 1)), self._path(f"{self.root}/log/.{uuid4().hex}.draft")
        stream = self._system.create(draft, False)
        try:
            stream.write(bytearray(body.encode("utf-8")))
        finally:
            stream.close()
        with _TURN:
            try:
                return self._moved(draft, target)
            finally:
                self._system.delete(draft, False)

    def _moved(self, draft, target) -> bool:
        """Give the draft its name unless the name is taken."""
        if target.toUri().getScheme() == "file":
            # A local rename replaces; a hard link does not.
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        try:
            self._context.rename(draft, target, self._keep_others)
        except Py4JJavaError as e:
            if self._system.exists(target):
                return False
            raise e
        return True
