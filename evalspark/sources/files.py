"""Run folders, reports, prompt exports and PNG facts as DataFrames."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Mapping
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import is_file_name, is_hidden, not_blank, strip
from ..operators.numbering import numbered
from .shared import open_store, replace_file

MANIFEST = """run_id string, proof_version string, base_checkpoint struct<name:string,sha256:string>, vae struct<name:string,sha256:string>,
 loras array<struct<name:string,sha256:string,weight:double>>, sampling struct<sampler:string,scheduler:string,steps:int,cfg:double,clip_skip:int,width:int,height:int>,
 prompt string, negative_prompt string, seeds array<decimal(20,0)>, engine string, engine_version string, source_manifest string, source_manifest_version string,
 training_run_id string, created_at string"""
# Endings of image files.
IMAGES = ("png", "jpg", "jpeg", "webp")
SUPPORTED_MAJOR = ("1",)
PLAIN_NAME = re.compile(r"(?!\.{1,2}$)(?=.*\S)[^/\\\x00]+", re.S)


def _root(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system of a folder, and the folder as that writes it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def _read_each(batches):
    for batch in batches:
        batch["content"] = [_content(p) for p in batch["path"]]
        yield batch


def _content(uri: str) -> bytes | None:
    """A file's bytes; null if there is none, or the name is no place at all."""
    try:
        store, path = open_store(uri)
        with store.open_input_stream(path) as file:
            return file.read()
    except (OSError, ValueError):
        return None


def _unseen(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """Files that Spark's file source passes over: empty ones, and those with a name, or below a folder, that begins with '_' or '.'."""
    system, root = _root(spark, folder)
    begin, found = len(root.toString().rstrip("/")) + 1, []
    each = system.listFiles(root, recursive)
    while each.hasNext():
        status = each.next()
        path = status.getPath().toString()
        if not status.getLen() or any(part[:1] in ("_", ".") for part in path[begin:].split("/")):
            found.append((path, status.getLen(), status.getModificationTime() / 1000))
    rows = spark.createDataFrame(found, "path string, length long, modified double").withColumn("modified", F.timestamp_millis((F.col("modified") * 1000).cast("long")))
    return rows.mapInPandas(_read_each, "path string, length long, modified timestamp, content binary")


def files(spark: SparkSession, folder: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """``path, name, stem, ending, rel, length, modified, content`` of all files below a folder; with ``hidden`` also of empty ones and of '_' and '.' ones."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")
    if hidden:
        rows = rows.unionByName(_unseen(spark, folder, recursive))
    name = F.element_at(F.split("path", "/"), -1)
    begin = len(_root(spark, folder)[1].toString().rstrip("/")) + 2
    rel = F.substring("path", F.lit(begin), F.length("path"))
    return rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ending"), rel.alias("rel"), "length", "modified", "content")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per readable ``manifest.json``; an unsupported major version is an error."""
    rows = files(spark, folder).where("name = 'manifest.json'").select("path", F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m")).select("path", "m.*").where("run_id is not null")
    version = F.coalesce("proof_version", F.lit("1.3"))
    ok = F.split(version, r"\.")[0].isin(*SUPPORTED_MAJOR)
    return rows.withColumn("proof_version", F.when(ok, version).otherwise(F.raise_error(F.concat(F.lit("version not supported: "), version)).cast("string")))


def discover_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files whose name is the run's id, a seed and possibly an index; size from the PNG header, else from the manifest."""
    runs = manifests(spark, folder).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "run_id", "sampling")
    found = files(spark, folder).where(F.col("ending").isin(*IMAGES)).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    rest = F.expr("substring(stem, length(run_id) + 1)")
    rows = found.join(runs, "dir").where(F.col("stem").startswith(F.col("run_id"))).withColumn("rest", rest).where(F.col("rest").rlike(r"^-\d+(-\d+)?$"))
    width, height = png_size(F.col("content"))
    return rows.select("run_id", F.col("stem").alias("image_id"), F.regexp_extract("rest", r"^-(\d+)", 1).cast("decimal(20,0)").alias("seed"), "path", F.coalesce(width, "sampling.width").alias("width"), F.coalesce(height, "sampling.height").alias("height"))


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG header; null for anything else."""
    png = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(content) >= 24)

    def number(at: int) -> Column:
        return F.when(png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))

    return number(17), number(21)


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Type and body of each whole chunk before the end mark."""
    held = memoryview(raw)[len(SIGNATURE) :]
    while len(held) >= 8:
        size, kind = struct.unpack_from(">I4s", held)
        if kind == b"IEND" or len(held) < 8 + size:
            return
        yield kind, bytes(held[8 : 8 + size])
        held = held[12 + size :]


def _halves(body: bytes) -> tuple[str, bytes]:
    """Keyword and rest; a body without a separator is a ValueError."""
    at = body.index(b"\0")
    return body[:at].decode("latin-1"), body[at + 1 :]


def _plain(body: bytes) -> tuple[str, str]:
    word, rest = _halves(body)
    return word, rest.decode("latin-1")


def _packed(body: bytes) -> tuple[str, str]:
    word, rest = _halves(body)
    return word, zlib.decompress(rest[1:]).decode("latin-1")


def _unicode(body: bytes) -> tuple[str, str]:
    word, rest = _halves(body)
    _, _, text = rest[2:].split(b"\0", 2)
    return word, (zlib.decompress(text) if rest[0] else text).decode("utf-8")


_DECODERS = {b"tEXt": _plain, b"zTXt": _packed, b"iTXt": _unicode}


def _texts(raw: bytes | None) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and raw.startswith(SIGNATURE):
        for decoder, body in ((_DECODERS[kind], body) for kind, body in _chunks(raw) if kind in _DECODERS):
            with suppress(ValueError, IndexError, zlib.error):
                out.update([decoder(body)])
    return out


def png_text(content: Column | str) -> Column:
    """Keywords and texts of a PNG's text chunks; a broken chunk is skipped, a later keyword wins."""

    def each(column: pd.Series) -> pd.Series:
        return column.map(_texts)

    return F.pandas_udf(each, "map<string,string>")(content)


def reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Readable ``*.json`` reports in order of their file names, also of names that begin with '_' or '.'; others are skipped."""
    rows = files(spark, folder, recursive=False, hidden=True).where("ending = 'json'")
    return rows.select("name", F.from_json(F.decode("content", "UTF-8"), schema).alias("r")).where("r.run_id is not null").select("name", "r.*").orderBy("name")


def report(spark: SparkSession, folder: str, run_id: str, schema: str) -> DataFrame:
    """The one report of a run; an error if none is stored or the id is no plain name."""
    if not PLAIN_NAME.fullmatch(run_id):
        raise ValueError(f"not a run's id: {run_id!r}")
    body = _content(f"{_root(spark, folder)[1].toString()}/{run_id}.json")
    if body is None:
        raise FileNotFoundError(run_id)
    return spark.createDataFrame([(body.decode("utf-8"),)], "body string").select(F.from_json("body", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _plain_name(run_id: Column) -> Column:
    """The id, or an error where it is no plain file name."""
    name = run_id.cast("string")
    return F.when(is_file_name(name), name).otherwise(F.raise_error(F.concat(F.lit("not a run's id: "), F.coalesce(name, F.lit("null")))).cast("string"))


def save_reports(rows: DataFrame, folder: str) -> DataFrame:
    """Write each of ``rows(run_id, ...)`` as ``<run_id>.json``, over an earlier one, and return ``run_id, path``.

    A file appears whole or not at all. Of several rows of one run the last one
    written stays; an id that is no plain file name is an error.
    """
    root = _root(rows.sparkSession, folder)[1].toString()

    def write(batches):
        for batch in batches:
            batch["path"] = [f"{root}/{i}.json" for i in batch["run_id"]]
            for path, body in zip(batch["path"], batch["body"], strict=True):
                replace_file(path, f"{body}\n".encode())
            yield batch[["run_id", "path"]]

    return rows.select(_plain_name(F.col("run_id")).alias("run_id"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("body")).mapInPandas(write, "run_id string, path string")


def save_manifests(rows: DataFrame, folder: str) -> DataFrame:
    """Write each of ``rows(run_id, ...)`` as ``<run_id>/manifest.json`` and return ``run_id, path``."""
    root = _root(rows.sparkSession, folder)[1].toString()

    def write(batches):
        for batch in batches:
            batch["path"] = [f"{root}/{i}/manifest.json" for i in batch["run_id"]]
            for path, body in zip(batch["path"], batch["body"], strict=True):
                replace_file(path, f"{body}\n".encode())
            yield batch[["run_id", "path"]]

    return rows.select(_plain_name(F.col("run_id")).alias("run_id"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("body")).mapInPandas(write, "run_id string, path string")


def schema_document(tables: Mapping[str, DataFrame | StructType]) -> str:
    """The schemas of named tables as one JSON text, the same at every run."""
    schemas = {n: t if isinstance(t, StructType) else t.schema for n, t in tables.items()}
    return json.dumps({"$defs": {n: json.loads(s.json()) for n, s in sorted(schemas.items())}}, indent=2, sort_keys=True) + "\n"


def is_stale(text: str | None, tables: Mapping[str, DataFrame | StructType]) -> bool:
    """Whether a written schema document no longer says what the tables are."""
    return text != schema_document(tables)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet store, or an empty table of its schema where nothing has been stored yet."""
    system, root = _root(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(root) else spark.createDataFrame([], schema)


def beside_images(spark: SparkSession, folder: str) -> DataFrame:
    """``pos, prompt``: captions that lie beside the images which ``manifest.jsonl`` names, where there are any."""
    listed = files(spark, folder, recursive=False).where("name = 'manifest.jsonl'").where(F.expr("is_valid_utf8(cast(content as string))"))
    lines = listed.select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("pos", "line"))
    image = F.from_json("line", "abs_path string")["abs_path"]
    beside = lines.select("pos", F.concat(F.regexp_replace(image, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt")).alias("path")).where(F.length(image) > 0)
    read = beside.mapInPandas(_read_each, "pos int, path string, content binary").where(F.expr("is_valid_utf8(cast(content as string))"))
    text = F.decode("content", "UTF-8")
    return read.where(not_blank(text)).select("pos", strip(text).alias("prompt"))


CAPTION = "struct<name:string,final_caption:string,caption_variants:map<string,string>>"


def export_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """``pos, prompt`` of the first source that has any: captions as JSON, then as JSON lines, then text files, then those beside images.

    Of JSON files the first one with a caption counts. Hidden and non-UTF-8 files and broken lines are skipped.
    """
    held = files(spark, folder, hidden=True).where(~is_hidden(F.col("rel")) & F.expr("is_valid_utf8(cast(content as string))")).withColumn("text", F.decode("content", "UTF-8"))
    picked = F.coalesce(*[F.when(not_blank(v), strip(v)) for v in (F.col("c.caption_variants")["zeroshot"], F.col("c.caption_variants")["training"], F.col("c.final_caption"))])
    arrays = held.where("ending = 'json'").select(F.lit(0).alias("rank"), "path", F.posexplode(F.from_json("text", f"array<{CAPTION}>")).alias("pos", "c"))
    lines = held.where("ending = 'jsonl'").select(F.lit(1).alias("rank"), "path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("rank", "path", "pos", F.from_json("line", CAPTION).alias("c"))
    captions = arrays.unionByName(lines).select("rank", "path", "pos", picked.alias("prompt")).where("prompt is not null")
    texts = held.where("ending = 'txt'").where(not_blank(F.col("text"))).select(F.lit(2).alias("rank"), F.lit("").alias("path"), F.col("path").alias("order"), F.lit(0).alias("pos"), strip(F.col("text")).alias("prompt"))
    beside = beside_images(spark, folder).select(F.lit(3).alias("rank"), F.lit("").alias("path"), F.lit("").alias("order"), "pos", "prompt")
    rows = captions.withColumn("order", F.lit("")).unionByName(texts).unionByName(beside)
    first = rows.agg(F.min(F.struct("rank", "path")).alias("first"))
    kept = rows.join(F.broadcast(first), (F.col("rank") == F.col("first.rank")) & (F.col("path") == F.col("first.path")))  # one row
    return numbered(kept.select("order", F.col("pos").alias("line"), "prompt"), "pos", "order", "line").select("pos", "prompt")


def reference_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of all image files below a folder, in order."""
    return files(spark, folder, hidden=True).where(F.col("ending").isin(*IMAGES)).select("path").orderBy("path")


def exports(spark: SparkSession, root: str) -> DataFrame:
    """``name, n_rows, has_references`` of the folders of ``root`` that hold a readable ``manifest.jsonl``, in order; blank lines don't count."""
    system, path = _root(spark, root)
    # Folders of one level: a listing, which may have no files below ``references``.
    found = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}/*/references")) or ()
    held = [s.getPath().getParent().getName() for s in found if s.isDirectory()]
    folder = F.element_at(F.split("rel", "/"), 1)
    lists = files(spark, root, hidden=True).where("name = 'manifest.jsonl'").where(F.size(F.split("rel", "/")) == 2).where(F.expr("is_valid_utf8(cast(content as string))")).where(folder.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"))
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: not_blank(x))
    return lists.select(folder.alias("name"), F.size(lines).cast("long").alias("n_rows"), folder.isin(*held).alias("has_references")).orderBy("name")


def image_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, path``: the first path of each name."""
    return files(spark, folder).where(F.col("ending").isin(*IMAGES, "gif", "bmp", "tif", "tiff")).groupBy("stem").agg(F.min("path").alias("path"))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("path", "length", "modified", F.sha2("content", 256).alias("sha256"))
