"""Ranked lexical search over an index whose documents are reordered by recursive graph bisection.

Documents and the terms that any query uses form a bipartite graph. On a bounded
sample of documents, the graph is halved again and again: documents change sides
while that lowers the summed cost of the terms' degrees on either side. What a
halving has learned is kept as a weight for each bucket of terms and a cut, by
which every document of the corpus then finds its place in the order. Places of
one leaf form a cluster, cut into shards of bounded size.

A shard keeps the greatest contribution that any of its documents gets from a
term, so a query has a bound for each shard. Queries visit shards by bound, a few
at first and then more, and stop exactly: a shard is left out only if its bound
is below the score that the query's last place already has. An equal bound is
visited, since ties go to the smaller doc_id.

Scores are 64-bit integers. Terms are told apart by a hash while searching; if
another term of the corpus has the hash of a query's term, all is done again
under another seed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch, bounded_batches
from .terms import bit_filter, hashed_terms, hashes, passes, terms

#: Documents of a shard, and queries that meet a shard in one task.
SHARD, CHUNK = 512, 2048
_LAST = np.iinfo(np.int64).max


def _queried(batches):
    """``item_id, text`` -> ``item_id, words``: the item's terms in byte order, joined by spaces."""
    for batch in batches:
        joined = [b" ".join(sorted(terms(t))).decode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(joined, pa.string())], names=["item_id", "words"])


def _hasher(seed: int):
    """``q, term, times`` -> the same with the term's hash ``h``."""

    def add(batches):
        for batch in batches:
            h = hashes([t.encode("utf-8", "surrogatepass") for t in batch.column("term").to_pylist()], seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])

    return add


_PROFILE = "row long, doc_id long, n long, terms array<long>, tfs array<int>, seen array<struct<h:long,term:string,df:long>>"


def _profiler(shared, seed: int):
    """``row, doc_id, text`` -> a row a document, and a row without number for each group of texts: terms seen and their documents."""

    def profile(batches):
        for batch in batches:
            for begin, split, h in hashed_terms(batch.column("text").to_pylist(), seed):
                sizes = np.array([len(s) for s in split], np.int64)
                held = passes(shared.value, h)
                doc, kept = np.repeat(np.arange(len(split)), sizes)[held], h[held]
                order = np.lexsort((kept, doc))
                doc, kept = doc[order], kept[order]
                fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (kept[1:] != kept[:-1])))) if len(doc) else np.empty(0, np.int64)
                tfs, doc, kept = np.diff(np.append(fresh, len(kept))), doc[fresh], kept[fresh]
                offsets = np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32)
                # Two terms of one hash are both reported.
                names = list(set(compress((w for s in split for w in s), held.tolist())))
                values, df = np.unique(kept, return_counts=True)
                own = hashes(names, seed)
                counts = df[np.searchsorted(values, own)] if len(own) else np.empty(0, np.int64)
                seen = pa.StructArray.from_arrays([pa.array(own.view(np.int64)), pa.array([w.decode("utf-8", "surrogatepass") for w in names], pa.string()), pa.array(counts.astype(np.int64))], names=["h", "term", "df"])
                part, n = batch.slice(begin, len(split)), len(split)
                empty = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column("row"), empty]), pa.concat_arrays([part.column("doc_id"), empty]), pa.concat_arrays([pa.array(sizes), empty]),
                        pa.ListArray.from_arrays(np.append(offsets, offsets[-1:]), pa.array(kept.view(np.int64))), pa.ListArray.from_arrays(np.append(offsets, offsets[-1:]), pa.array(tfs.astype(np.int32))),
                        pa.ListArray.from_arrays(np.array([0] * (n + 1) + [len(names)], np.int32), seen),
                    ],
                    names=["row", "doc_id", "n", "terms", "tfs", "seen"],
                )

    return profile


Rows = tuple[np.ndarray, np.ndarray]


def _flat(column) -> Rows:
    """The values of a list column and where each list begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each list; lists are not empty."""
    return np.add.reduceat(values, offsets[:-1]) if len(offsets) > 1 else np.empty(0, values.dtype)


def _halved(flat: np.ndarray, offsets: np.ndarray, buckets: int, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and cut of one bisection: documents above the cut lie to the right."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    right = np.arange(n) % 2 == 1

    def degrees() -> tuple[np.ndarray, np.ndarray]:
        there = np.repeat(right, sizes)
        return np.bincount(flat[~there], minlength=buckets), np.bincount(flat[there], minlength=buckets)

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.maximum(a, 0), np.maximum(b, 0)
        return a * np.log2((n / 2 + 1) / (a + 1)) + b * np.log2((n / 2 + 1) / (b + 1))

    for _ in range(rounds):
        a, b = degrees()
        now = cost(a, b)
        gain = np.where(right, _sums((now - cost(a + 1, b - 1))[flat], offsets), _sums((now - cost(a - 1, b + 1))[flat], offsets))
        order = np.argsort(-gain, kind="stable")
        lefts, rights = order[~right[order]], order[right[order]]
        m = min(len(lefts), len(rights))
        swaps = int(np.count_nonzero(gain[lefts[:m]] + gain[rights[:m]] > 0))
        if not swaps:
            break
        right[lefts[:swaps]], right[rights[:swaps]] = True, False
    a, b = degrees()
    weights = np.log2((b + 1) / (a + 1)).astype(np.float32)
    return weights, float(np.median(_sums(weights[flat], offsets)))


def bisect(flat: np.ndarray, offsets: np.ndarray, depth: int, buckets: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the nodes of a full binary tree, in heap order; nodes with few documents send all to the left."""
    nodes = 2**depth - 1
    weights, cuts = np.zeros((nodes, buckets), np.float32), np.zeros(nodes)
    members = {0: np.arange(len(offsets) - 1)}
    sizes = np.diff(offsets)
    for node in range(nodes):
        rows = members.pop(node, np.empty(0, np.int64))
        if len(rows) < 8:
            continue
        own = np.concatenate(([0], np.cumsum(sizes[rows])))
        part = flat[np.arange(own[-1]) + np.repeat(offsets[rows] - own[:-1], sizes[rows])]
        weights[node], cuts[node] = _halved(part, own, buckets, rounds)
        right = _sums(weights[node][part], own) > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return weights, cuts


def place(weights: np.ndarray, cuts: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The leaf of each document, from left to right."""
    node, sizes = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets)
    while len(node) and node[0] < len(cuts):
        gain = _sums(weights[np.repeat(node, sizes), flat], offsets)
        node = 2 * node + 1 + (gain > cuts[node])
    return node - len(cuts)


def _shares(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def _greatest(rows: pa.Table) -> pa.Table:
    """The greatest contribution of each term in a shard."""
    h, offsets = _flat(rows.column("terms"))
    c = _shares(_flat(rows.column("tfs"))[0], np.repeat(rows.column("m").to_numpy(), np.diff(offsets)))
    order = np.argsort(h, kind="stable")
    values, first = np.unique(h[order], return_index=True)
    return pa.table({"shard": np.full(len(values), rows.column("shard")[0].as_py()), "h": values, "most": np.maximum.reduceat(c[order], first)})


def _scorer(k: int):
    """The ``k`` best documents of one shard for each query that visits it."""

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(queries):
            ids = rows.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
            h, offsets = _flat(rows.column("terms"))
            sizes = np.diff(offsets)
            c = _shares(_flat(rows.column("tfs"))[0], np.repeat(rows.column("m").to_numpy(), sizes))
            order = np.argsort(h, kind="stable")
            h, c, doc = h[order], c[order], np.repeat(np.arange(len(ids)), sizes)[order]
            for q, wanted, weights in zip(*(queries.column(n).to_pylist() for n in ("q", "hs", "weights")), strict=True):
                begin, end = np.searchsorted(h, wanted).tolist(), np.searchsorted(h, wanted, "right").tolist()
                scores = np.zeros(len(ids), np.int64)
                for b, e, w in zip(begin, end, weights, strict=True):
                    scores[doc[b:e]] += w * c[b:e]  # a term meets a document once
                at = np.flatnonzero(scores > 0)
                if len(at) > k:
                    at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                out.append((np.full(len(at), q), ids[at], scores[at]))
        q, ids, scores = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"q": q, "doc_id": pa.array(ids, mask=ids == _LAST), "score": scores})

    return score


def search(docs: DataFrame, items: DataFrame, k: int = 10, sample: int = 8192, depth: int = 8, buckets: int = 4096, first: int = 8, seed: int = 0) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``.

    ``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``; other columns
    are not read. All documents are indexed; the order is fitted on ``sample`` of
    them at most. Equal scores go by ascending doc_id, a null one last; documents
    without a common term are not given. Null and wordless texts have no terms,
    and such documents do not count. Repeated rows of documents are ranked each;
    an item that repeats with its text is answered once, with another text for
    each of them, and a null item_id like any other. Without documents or items
    the result is empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ranked")
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    asked = scratch.save(asked.mapInArrow(_queried, f"item_id {items.schema['item_id'].dataType.simpleString()}, words string").where("words <> ''").distinct(), "items")
    queries = scratch.save(asked.select("words").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    counted = queries.select("q", F.explode(F.split("words", " ")).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    while True:
        wanted = scratch.save(counted.mapInArrow(_hasher(seed), "q long, term string, times long, h long"), "wanted")
        shared = spark.sparkContext.broadcast(bit_filter(wanted.select("h").distinct()))
        profile = scratch.save(texts.mapInArrow(_profiler(shared, seed), _PROFILE), "profile")
        seen = scratch.save(profile.where("row is null").select(F.explode("seen").alias("s")).groupBy("s.h", "s.term").agg(F.sum("s.df").alias("df")), "seen")
        known = wanted.select("h", "term").distinct()
        clash = known.unionByName(seen.join(known.select("h").distinct(), "h", "left_semi").select("h", "term")).distinct().groupBy("h").count().where("count > 1")
        if clash.isEmpty():
            break
        scratch.drop(wanted, profile, seen)
        seed += 1
    total = profile.where("row is not null and n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n, length = total["n"], total["l"] or 1
    weight = F.col("times") * F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    weighed = scratch.save(wanted.join(seen, ["h", "term"]).select("q", "h", weight.cast("long").alias("weight")).where("weight > 0"), "weighed")

    held = profile.where(F.size("terms") > 0)
    feature = F.array_distinct(F.transform("terms", lambda h: h.bitwiseAND(F.lit(buckets - 1))))
    chosen = held.orderBy(F.xxhash64("row"), "row").limit(sample).select(feature.alias("f")).toArrow().column("f")  # at most ``buckets`` numbers a document
    weights = spark.sparkContext.broadcast(bisect(*_flat(chosen), depth, buckets))  # bounded by ``depth`` and ``buckets``

    def placed(batches):
        for batch in batches:
            flat, offsets = _flat(batch.column("terms"))
            # The graph has a document's bucket once, however many terms fall into it.
            key = np.repeat(np.arange(len(batch)), np.diff(offsets)) * buckets + (flat & (buckets - 1))
            key = np.unique(key)
            leaf = place(*weights.value, key % buckets, np.searchsorted(key // buckets, np.arange(len(batch) + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    m = F.expr(f"25 + (75L * n * {n}L) div {length}L").alias("m")
    index = scratch.save(held.select("row", "doc_id", m, "terms", "tfs").mapInArrow(placed, "row long, doc_id long, m long, terms array<long>, tfs array<int>, leaf long"), "index")
    parts = [1] * 2**depth
    for r in index.groupBy("leaf").count().collect():  # a row a leaf
        parts[r["leaf"]] = -(-r["count"] // SHARD)
    part = F.pmod(F.xxhash64("row"), F.element_at(F.lit(parts), (F.col("leaf") + 1).cast("int")))
    index = index.withColumn("shard", F.shiftleft("leaf", 40) + part).select("shard", "doc_id", "m", "terms", "tfs")

    greatest = scratch.save(index.groupBy("shard").applyInArrow(_greatest, "shard long, h long, most long"), "greatest")
    pending = scratch.save(weighed.join(greatest, "h").groupBy("q", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "bounds")
    chunk = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // CHUNK)))).alias("chunk")
    packed = scratch.save(weighed.groupBy("q").agg(F.collect_list(F.struct("h", "weight")).alias("t")).select("q", chunk, F.col("t.h").alias("hs"), F.col("t.weight").alias("weights")), "packed")
    best, visits = None, first
    while best is None or not pending.isEmpty():
        order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "shard"))
        now = scratch.save(pending.withColumn("place", order).where(F.col("place") <= visits).select("q", "shard").join(packed, "q"), "now")
        meets = scratch.save(now.select("shard", "chunk").distinct(), "meets")
        left = index.join(meets, "shard").groupBy("shard", "chunk")
        found = left.cogroup(now.groupBy("shard", "chunk")).applyInArrow(_scorer(k), "q long, doc_id long, score long")
        both = found if best is None else found.unionByName(best.select(*found.columns))
        top = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = scratch.save(both.withColumn("rank", top).where(F.col("rank") <= k), "best")
        last = best.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        rest = pending.join(now.select("q", "shard"), ["q", "shard"], "left_anti").join(last, "q", "left")
        pending = scratch.save(rest.where(F.col("bound") >= F.coalesce("floor", F.lit(1))).select("q", "shard", "bound"), "pending")
        visits *= 8
        scratch.sweep()
    return asked.join(queries, "words").join(best, "q").select("item_id", "rank", "doc_id", "score")


# The same by scoring every document that has any of an item's terms.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
q AS (SELECT item_id, words, term, count(*) AS times FROM (SELECT item_id, words, unnest(words) AS term FROM i) GROUP BY ALL),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, words, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, words ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
