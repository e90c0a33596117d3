"""Folders that all executors share, and access to them from Python workers."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session without it, a temporary folder; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evalspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def open_store(uri: str):
    """The file system of a URI and the path in it; a path without a scheme is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


class NewFile:
    """A stream to a file that has its name only once it is closed, so that no reader sees a part of it."""

    def __init__(self, uri: str):
        self._store, self._path = open_store(uri)
        folder, _, name = self._path.rpartition("/")
        self._store.create_dir(folder)
        self._part = f"{folder}/.{name}.{uuid4().hex}.part"
        self.out = self._store.open_output_stream(self._part)

    def close(self) -> None:
        self.out.close()
        self._store.move(self._part, self._path)


def replace_file(uri: str, body: bytes) -> None:
    """Write a file whole under another name first."""
    file = NewFile(uri)
    file.out.write(body)
    file.close()
