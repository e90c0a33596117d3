"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A document's words are factored greedily against all text before it: where the
next ``window`` words occur earlier, the match is extended word by word as far as
it goes and becomes a factor; else the word is a literal. The parse goes on at
the first window that crosses the factor's end, so a passage that another source
carries on is not lost at a boundary. Factors have ``window`` words at least, and
their words are removed.

References are cut into blocks. A block is named by an anchor, the smallest 8-word
hash inside a window, and holds all windows around one place of it, or around
places that follow one another closely; equal windows always lie in blocks of one
name. Anchors are counted first, and only blocks whose
anchor occurs again are stored. Blocks of one name are read in the order of their
documents: each is factored against every block before it, by exact comparison of
words, and its literals join the index. Factors that meet or overlap at the edges
of blocks are joined when a document's words are taken out.

An anchor with very many places is dealt over chunks of bounded size by document.
Windows that are the first of their kind in a chunk then meet by a 128-bit digest,
and all but the first document's are repeats. Documents with the words of a
smaller one go whole and never reach the index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .scratch import Scratch, bounded_batches
from .words import hashes, pieces, rolling, window_min, words

GRAM = 8
#: Places of one anchor whose blocks are factored together.
CHUNK = 4096


def _parts(texts: list[str | None]):
    """(index, words, word hashes) of each text; hashes are taken for many texts at once."""
    for begin, end in pieces(texts, lambda t: len(t or ""), 1 << 22):
        split = [words(t) for t in texts[begin:end]]
        h, at = hashes([w for s in split for w in s]), 0
        for i, s in enumerate(split):
            yield begin + i, s, h[at : at + len(s)]
            at += len(s)


def _gram(window: int) -> int:
    return max(1, min(GRAM, window // 2))


def _anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes, and for each window the anchor: the least gram hash inside it."""
    k = _gram(window)
    grams = rolling(h, k)
    return grams, window_min(grams, window - k + 1)


def _runs(grams: np.ndarray, named: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the named grams, where places of one gram are joined if a window can hold both or they adjoin."""
    at = np.flatnonzero(np.isin(grams, named))
    at = at[np.argsort(grams[at], kind="stable")]
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (grams[at[1:]] != grams[at[:-1]]) | (np.diff(at) > window - _gram(window) + 1) if len(at) else []
    edge = np.flatnonzero(new)
    return at[edge[:-1]], at[edge[1:] - 1]


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _scanner(window: int):
    def scan(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts, digests, lists = [0] * len(texts), [""] * len(texts), [None] * len(texts)
            for i, ws, h in _parts(texts):
                counts[i], digests[i] = len(ws), _digest(ws)
                if len(h) >= window:
                    grams, least = _anchors(h, window)
                    #: An anchor counts once for each of its blocks, and twice for a block with several places.
                    first, last = _runs(grams, np.unique(least), window)
                    lists[i] = grams[np.repeat(first, 1 + (last > first))].view(np.int64)
            sizes = np.array([0 if x is None else len(x) for x in lists])
            flat = np.concatenate([np.empty(0, np.int64), *(x for x in lists if x is not None)])
            anchors = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), anchors], names=["doc_id", "text_hash", "n_words", "whole_sha256", "anchors"])

    return scan


def _blocker(window: int):
    """The blocks of a document's named anchors: the words of all windows that hold one place, or joined places."""
    k = _gram(window)
    reach = window - k

    def emit(batches):
        for batch in batches:
            ids, marks, named = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("named")
            rows: list[tuple] = []
            for i, ws, h in _parts(batch.column("text").to_pylist()):
                anchors = named[i].values.field("anchor").to_numpy(zero_copy_only=False)
                chunks = dict(zip(anchors.tolist(), named[i].values.field("chunks").to_pylist(), strict=True))
                grams = rolling(h, k).view(np.int64)
                first, last = _runs(grams, anchors, window)
                for p, q, g in zip(first.tolist(), last.tolist(), grams[first].tolist(), strict=True):
                    begin = max(0, p - reach)
                    rows.append((g, hash((ids[i], marks[i])) % chunks[g], chunks[g] > 1, ids[i], marks[i], begin, b" ".join(ws[begin : q + window])))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

    return emit


_BLOCK = pa.schema([("anchor", pa.int64()), ("chunk", pa.int32()), ("crowded", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int32()), ("words", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def factor(block: list[bytes], place: tuple, index: dict, window: int) -> tuple[list[tuple[int, int]], list[tuple[int, bytes]]]:
    """Factors of a block against all blocks of the index as word ranges, and its literal windows, which join the index.

    ``place`` is (document, first word). The index gives for a window's words the
    block that has them first, where in it they begin, and that block's place. A
    block overlaps others of its document: a window is no repeat of itself.
    """
    factors, literals, at = [], [], 0
    document, begin = place
    while at + window <= len(block):
        key = b" ".join(block[at : at + window])
        held = index.get(key)
        if held is None:
            index[key] = (block, at, place)
            literals.append((at, key))
            at += 1
        elif held[2][0] == document and held[2][1] + held[1] == begin + at:
            at += 1
        else:
            reference, source, _ = held
            size = window
            while at + size < len(block) and source + size < len(reference) and block[at + size] == reference[source + size]:
                size += 1
            factors.append((at, at + size))
            at += size - window + 1  # the first window across the factor's end
    return factors, literals


def _factorer(window: int):
    """Blocks in the order of anchors, chunks and places -> factors, and a crowded anchor's windows that its chunk has first."""

    def parse(batches):
        name, index, last = None, {}, None
        for batch in batches:
            rows: list[tuple] = []
            for anchor, chunk, crowded, doc, mark, begin, raw in zip(*(batch.column(c).to_pylist() for c in _BLOCK.names), strict=True):
                if (anchor, chunk) != name:
                    name, index, last = (anchor, chunk), {}, None
                if (doc, mark, begin) == last:
                    continue  # a repeated row
                last = (doc, mark, begin)
                factors, literals = factor(raw.split(b" "), ((doc, mark), begin), index, window)
                rows += [(doc, mark, begin + x, begin + y, None, None) for x, y in factors]
                if crowded:
                    for at, key in literals:
                        rows.append((doc, mark, begin + at, begin + at + window, *np.frombuffer(xxh3_128_digest(key), np.int64).tolist()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)

    return parse


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the factors."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:n]) > 0


def _remover(with_text: bool):
    def remove(batches):
        for batch in batches:
            factors = batch.column("factors")
            removed, digests, kept_texts = [0] * len(batch), [""] * len(batch), [None] * len(batch)
            for i, t in enumerate(batch.column("text").to_pylist()):
                ws, found = words(t), factors[i].values
                gone = covered(len(ws), *(found.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop")))
                kept = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                removed[i], digests[i] = len(ws) - len(kept), _digest(kept)
                if with_text:
                    kept_texts[i] = b" ".join(kept).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                names=["doc_id", "text_hash", "n_removed", "kept_sha256", "kept_text"],
            )

    return remove


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Take every word out that lies in ``window`` words which also start earlier.

    ``docs(doc_id long, text string, ...)``; other columns are not read. Returns
    ``doc_id, n_words, n_removed, kept_sha256``, one row per input row, and with
    ``with_text`` also ``kept_text`` (null where nothing was removed: the text
    stays as it is). Null, empty and short texts keep all they have; equal texts
    keep the words of the smallest doc_id. Rows with a null doc_id are neither
    reference nor changed. Rows of one doc_id with the same words are one document
    and answered alike; one id's texts with different words are documents of their
    own, in a fixed order. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    row = ["doc_id", "text_hash"]
    scanned = scratch.save(texts.mapInArrow(_scanner(window), "doc_id long, text_hash long, n_words long, whole_sha256 string, anchors array<long>"), "scanned")
    long = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    leaders = long.groupBy("whole_sha256").agg(F.min(F.struct(*row)).alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = scratch.save(leaders.select("whole_sha256", F.col("leader.doc_id").alias("lead_id"), F.col("leader.text_hash").alias("lead_hash")), "leaders")
    # Written, so that Spark can split the join of words that very many documents share.
    copied = long.select(*row, "whole_sha256").join(leaders, "whole_sha256")
    followers = scratch.save(copied.where((F.col("doc_id") != F.col("lead_id")) | (F.col("text_hash") != F.col("lead_hash"))).select(*row).distinct(), "followers")
    twice = scratch.save(copied.groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select(*row), "twice")
    places = long.select(*row, "anchors").join(followers, row, "left_anti").select(*row, F.explode("anchors").alias("anchor"))
    # Written, so that the join has a plain shuffle on either side and Spark can split a common anchor.
    repeated = scratch.save(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "repeated")
    named = scratch.save(places.join(repeated, "anchor").groupBy(*row).agg(F.collect_set(F.struct("anchor", "chunks")).alias("named")), "named")
    scratch.sweep()
    if twice.isEmpty():
        once = texts
    else:  # a row that is repeated is read once
        once = texts.join(twice, row, "left_anti").unionByName(texts.join(twice, row, "left_semi").dropDuplicates(row).select(*texts.columns))
    blocks = once.join(named, row).mapInArrow(_blocker(window), "anchor long, chunk int, crowded boolean, doc_id long, text_hash long, begin int, words binary")
    ordered = blocks.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", *row, "begin")
    found = scratch.save(ordered.mapInArrow(_factorer(window), "doc_id long, text_hash long, start int, stop int, h1 long, h2 long"), "found")
    scratch.drop(named, repeated)
    scratch.sweep()
    windows = found.where("h1 is not null")
    first = scratch.save(windows.groupBy("h1", "h2").agg(F.min(F.struct(*row, "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"), "first")
    again = windows.join(first, ["h1", "h2"]).where(F.struct(*row, "start") != F.col("first"))
    factors = found.where("h1 is null").unionByName(again.drop("first")).groupBy(*row).agg(F.collect_list(F.struct("start", "stop")).alias("factors"))
    removed = scratch.save(once.join(scratch.save(factors, "factors"), row).mapInArrow(_remover(with_text), "doc_id long, text_hash long, n_removed long, kept_sha256 string, kept_text string"), "removed")
    scratch.sweep()
    #: Rows with a leader's id and words have its answer; those of a larger id go whole.
    led = scanned.select(*row, "n_words", "whole_sha256").join(leaders, "whole_sha256", "left")
    led = led.withColumn("text_hash", F.when(F.col("doc_id") == F.col("lead_id"), F.col("lead_hash")).otherwise(F.col("text_hash")))
    out = led.join(removed, row, "left")
    gone = F.coalesce(F.col("doc_id") > F.col("lead_id"), F.lit(False))
    kept = [
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(_digest([]))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    ]
    return out.select("doc_id", "n_words", *kept)


# The same by windows: whether a window's words start earlier is asked of every window.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS many, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
v AS (SELECT doc_id, many, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM p),
r AS (SELECT doc_id, pos FROM v WHERE pos <= many - 19 QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
