"""A data source of run folders: ``spark.read.format("run_folders").load(root)``, listed by the tasks that read.

Every partition lists the folders of the root itself and takes those whose name
falls to it, so no list of names is in the driver. A filter on ``run_id`` (equal
or in) leaves the named folders only, and one on ``name`` is applied before a
file is opened.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .shared import open_store

#: ``run_id`` is the folder below the root, null for files of the root itself; ``rel`` is the path below the root.
COLUMNS = "run_id string, name string, stem string, ending string, rel string, path string, length long, modified timestamp, content binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Share(InputPartition):
    """One of ``of`` shares of a root's folders by name, or the named ones."""

    number: int
    of: int
    runs: tuple[str, ...] | None


class RunFolders(DataSource):
    """All files below a root, '_' and '.' names and empty files included.

    Options: ``path`` (a path or URI that executors share), ``shares`` (partitions,
    64), ``content`` ('false' leaves bytes unread: null).
    """

    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return RunReader(self.options)


class RunReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.shares = options["path"].rstrip("/"), int(options.get("shares", 64))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.runs: tuple[str, ...] | None = None
        self.names: tuple[str, ...] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            # One filter a column is taken on; Spark applies the others.
            if wanted is not None and f.attribute == ("run_id",) and self.runs is None:
                self.runs = tuple(sorted({w for w in wanted if w is not None}))
            elif wanted is not None and f.attribute == ("name",) and self.names is None:
                self.names = tuple(sorted({w for w in wanted if w is not None}))
            else:
                yield f

    def partitions(self) -> list[Share]:
        if self.runs is not None:
            count = max(1, min(self.shares, len(self.runs)))
            return [Share(i, count, self.runs[i::count]) for i in range(count)]
        return [Share(i, self.shares, None) for i in range(self.shares)]

    def read(self, share: Share) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = open_store(self.root)
        if share.runs is None:
            listed = store.get_file_info(fs.FileSelector(root))
            mine = [i for i in listed if zlib.crc32(i.base_name.encode("utf-8", "surrogatepass")) % share.of == share.number]
        else:
            # A name with a separator is no folder of the root.
            mine = [i for i in store.get_file_info([f"{root}/{r}" for r in share.runs if re.fullmatch(r"(?!\.{1,2}$)[^/\x00]+", r)]) if i.type == fs.FileType.Directory]
        for top in mine:
            if top.type == fs.FileType.File:
                yield from self._rows(store, root, None, [top])
            elif top.type == fs.FileType.Directory:
                yield from self._rows(store, root, top.base_name, store.get_file_info(fs.FileSelector(top.path, recursive=True)))

    def _rows(self, store, root: str, run: str | None, infos) -> Iterator[tuple]:
        from pyarrow import fs

        for info in infos:
            if info.type != fs.FileType.File or (self.names is not None and info.base_name not in self.names):
                continue
            dot = info.base_name.rfind(".")
            stem, ending = (info.base_name, "") if dot < 0 else (info.base_name[:dot], info.base_name[dot + 1 :].lower())
            data = None
            if self.content:
                with store.open_input_stream(info.path) as file:
                    data = file.read()
            yield run, info.base_name, stem, ending, info.path[len(root) + 1 :], info.path, info.size, info.mtime.astimezone().replace(tzinfo=None) if info.mtime else None, data


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand filters to it."""
    spark.dataSource.register(RunFolders)
    spark.conf.set(PUSHDOWN, "true")
