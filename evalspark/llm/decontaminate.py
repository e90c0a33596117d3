"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ten words, and each window a set of short
shingles with their offsets. A window that occurs in a document has all its
shingles there, so one shingle is a sufficient prefix of the set: the rarest of
the whole corpus. Documents are scanned twice. The first scan counts how often
each shingle of the benchmark occurs; a window with one that never does cannot
occur. The second emits the places of prefix shingles, each with the words
around it. The join is on the shingle; its offset gives the place at which the
window would begin, which must lie inside the document (positional and length
bound), and there the window's own words are compared.

Scans meet the benchmark through a bit filter of bounded size, so nothing grows
with the benchmark but the joins. Windows that share a prefix are listed
in rows of bounded size. A document's items are named once for all documents
that hold the same windows' items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches
from .terms import bit_filter, hashed_terms, hashes, passes, terms
from .words import rolling

#: Windows that one row of a prefix's list holds.
LISTED = 64

_MATCH = pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("begin", pa.int32()), ("around", pa.list_(pa.string()))])


def _text(split: list[bytes]) -> str:
    return b" ".join(split).decode("utf-8", "surrogatepass")


def _itemiser(batches):
    """``item_id, text`` -> ``item_id, words``: the item's words joined by spaces."""
    for batch in batches:
        joined = [_text(terms(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(joined, pa.string())], names=["item_id", "words"])


def _windower(width: int, k: int):
    """``seq, words`` -> each window of the sequence with the hashes of its shingles, by offset."""

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for seq, words in zip(batch.column("seq").to_pylist(), batch.column("words").to_pylist(), strict=True):
                split = words.encode("utf-8", "surrogatepass").split(b" ")
                h, n = hashes(split), min(width, len(split))
                shingles = rolling(h, min(k, n)).view(np.int64).tolist()
                held = n - min(k, n) + 1
                out += [(seq, _text(split[i : i + n]), n, shingles[i : i + held]) for i in range(len(split) - n + 1)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["seq", "window", "n", "shingles"])

    return cut


def _occurring(h: np.ndarray, sizes: list[int], lengths: list[int], held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of concatenated texts, the places and values of shingles that the filter lets pass, for each shingle length."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    for k in lengths:
        rolled = rolling(h, k)
        at = np.flatnonzero(passes(held, rolled))
        at = at[at + k <= ends[at]]
        yield at, rolled[at]


def _counter(shared, lengths: list[int]):
    def count(batches):
        for batch in batches:
            for _, split, h in hashed_terms(batch.column("text").to_pylist()):
                found = [v for _, v in _occurring(h, [len(s) for s in split], lengths, shared.value)]
                values, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return count


def _finder(shared, lengths: list[int], width: int):
    """``row, doc_id, text`` -> ``row, doc_id, n_words, matches``: places of prefix shingles and the words around them."""

    def find(batches):
        for batch in batches:
            for begin, split, h in hashed_terms(batch.column("text").to_pylist()):
                sizes = [len(s) for s in split]
                starts = np.concatenate(([0], np.cumsum(sizes)))
                both = list(_occurring(h, sizes, lengths, shared.value))
                at = np.concatenate([*[a for a, _ in both], np.empty(0, np.int64)]).astype(np.int64)
                values = np.concatenate([*[v for _, v in both], np.empty(0, np.uint64)]).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, values = at[order], values[order]
                doc = np.searchsorted(starts, at, "right") - 1
                place = at - starts[doc]
                first = np.maximum(place - width + 1, 0)
                around = [[w.decode("utf-8", "surrogatepass") for w in split[d][f : p + width]] for d, f, p in zip(doc.tolist(), first.tolist(), place.tolist(), strict=True)]
                fields = [pa.array(place, pa.int32()), pa.array(values), pa.array(first, pa.int32()), pa.array(around, _MATCH[3].type)]
                offsets = np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32)
                part = batch.slice(begin, len(split))
                matches = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_MATCH)))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), matches], names=["row", "doc_id", "n_words", "matches"])

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 3) -> DataFrame:
    """Which words of each document lie in a window that a benchmark item has too.

    ``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)``; other
    columns are not read. A window is ``width`` consecutive words of an item, or
    all words of a shorter one. Returns one row per input row: ``doc_id, n_words,
    n_hit`` (words inside an occurrence of any window), ``n_items`` (items with
    an occurring window), ``items_sha256`` (their ids sorted as strings, joined by
    commas), ``contaminated``.

    Null, empty and wordless texts have no words: such documents hold nothing,
    such items have no windows. Repeated documents and ids are answered row by
    row, null ids too. Items of equal words count each; an id that repeats counts
    once; an item without an id hits words but is not counted or named. An empty
    benchmark hits nothing, an empty table of documents gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "decontaminate")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_itemiser, "item_id string, words string").where("words <> ''")
    items = scratch.save(items.distinct(), "items")
    sequences = scratch.save(items.select("words").distinct().withColumn("seq", F.monotonically_increasing_id()), "sequences")
    members = items.where("item_id is not null").join(sequences, "words").select("seq", "item_id")
    cut = sequences.select("seq", "words").mapInArrow(_windower(width, k), "seq long, window string, n int, shingles array<long>")
    windows = scratch.save(cut.groupBy("window", "n").agg(F.array_sort(F.collect_set("seq")).alias("seqs"), F.any_value("shingles").alias("shingles")), "windows")
    groups = scratch.save(windows.select("seqs").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    lengths = sorted(r["k"] for r in windows.select(F.least(F.lit(k), F.col("n")).alias("k")).distinct().collect())  # k values at most

    offsets = windows.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    everywhere = spark.sparkContext.broadcast(bit_filter(offsets.select(F.col("shingle").alias("h")).distinct()))
    counts = texts.select("text").mapInArrow(_counter(everywhere, lengths), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("times"))
    counts = scratch.save(counts, "counts")
    rarest = offsets.join(counts, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset")).alias("rare"))
    prefixes = windows.join(rarest.where("rare.times > 0"), "window").join(groups, "seqs").select("window", "n", "group", "rare.shingle", "rare.offset")
    prefixes = scratch.save(prefixes, "prefixes")
    crowds = prefixes.groupBy("shingle").agg(F.ceil(F.count("*") / LISTED).alias("parts"))
    listed = prefixes.join(crowds, "shingle").groupBy("shingle", F.pmod(F.xxhash64("window"), "parts").alias("part"))
    lists = scratch.save(listed.agg(F.collect_list(F.struct("offset", "n", "window", "group")).alias("listed")).drop("part"), "lists")

    sought = spark.sparkContext.broadcast(bit_filter(prefixes.select(F.col("shingle").alias("h")).distinct()))
    schema = "row long, doc_id long, n_words long, matches array<struct<at:int,shingle:long,begin:int,around:array<string>>>"
    rows = scratch.save(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_finder(sought, lengths, width), schema), "rows")

    # Written, so that the join has a plain shuffle on either side and Spark can split a common passage.
    places = scratch.save(rows.where(F.size("matches") > 0).select("row", "n_words", F.explode("matches").alias("m")).select("row", "n_words", "m.*"), "places")
    begin = lambda w: F.col("at") - w["offset"]
    there = lambda w: F.array_join(F.slice("around", F.greatest(begin(w) - F.col("begin"), F.lit(0)) + 1, w["n"]), " ") == w["window"]
    fits = lambda w: (begin(w) >= 0) & (begin(w) + w["n"] <= F.col("n_words")) & there(w)
    spans = F.transform(F.filter("listed", fits), lambda w: F.struct(begin(w).alias("start"), (begin(w) + w["n"]).alias("stop"), w["group"].alias("group")))
    held = places.join(lists, "shingle").select("row", spans.alias("spans")).where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    pairs = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    cover = lambda state, s: F.struct((state["n"] + F.greatest(s["stop"] - F.greatest(s["start"], state["end"]), F.lit(0))).alias("n"), F.greatest(state["end"], s["stop"]).alias("end"))
    hit = F.aggregate(pairs, none, cover, lambda s: s["n"])
    found = scratch.save(held.select("row", hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["group"]))).alias("groups")), "found")

    named = found.select("groups").distinct().withColumn("group", F.explode("groups")).join(groups, "group").select("groups", F.explode("seqs").alias("seq")).distinct()
    listed_ids = named.join(members, "seq").groupBy("groups").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    digests = scratch.save(listed_ids.select("groups", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "digests")
    results = found.join(digests, "groups", "left").select("row", "n_hit", "n_items", "items_sha256")
    out = rows.select("row", "doc_id", "n_words").join(results, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


# The same by joining every run of as many words as a window has.
ORACLE = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
b AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos FROM i WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[pos:pos + n - 1], ' ') AS run FROM b),
x AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
y AS (SELECT row, pos, list(word) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS following FROM x),
p AS (SELECT row, pos, n, array_to_string(following[1:n], ' ') AS run FROM y, (SELECT DISTINCT n FROM w) WHERE len(following) >= n),
o AS (SELECT row, pos, p.n, item_id FROM p JOIN w ON p.run = w.run AND p.n = w.n),
h AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS word FROM o) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.row = d.row LEFT JOIN t ON t.row = d.row
"""
