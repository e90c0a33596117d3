"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits its sample by the
hyperplane halfway between two of its vectors. Every row then falls to one leaf
per tree. A query walks all trees at once through one priority queue, always
taking the branch whose summed squared margins so far are least. How many leaves
it takes is fitted too: on the sample, so many that the wanted share of the true
neighbours is found. Vectors with structure need few; vectors without any need
leaves that hold a third of all rows, whatever the search.

Rows and queries meet by leaf: neighbouring leaves of a tree form a cell, a row
goes to one cell a tree, a query to the cells of its leaves, and crowded cells are
cut into parts of bounded size. A cell reranks by exact distance the rows that lie
in a query's leaves, and passes on the nearest of them only.

Equal vectors are one class while searching: of a class only its smallest ids
can be among the nearest, so each class carries as many as a result has, plus
one for the query itself. However many copies a vector has, a leaf holds it once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch, bounded_batches
from .vectors import usable

#: A forest in plain arrays: per node the normal, the offset and two children; a child below 0 is leaf -1 - child.
Forest = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """Split until a node's sample has ``leaf`` rows at most; equal vectors end a branch. Roots are given last."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaves = [], [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        stack, top = [(rows, -1, 0)], None
        while stack:
            rows, parent, side = stack.pop()
            node = None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    size = np.linalg.norm(normal)
                    if size:
                        normal = normal / size
                        offset = float(normal @ (a + b) / 2)
                        right = sample[rows] @ normal > offset
                        if right.any() and not right.all():
                            node = len(normals)
                            normals.append(normal), offsets.append(offset), children.append([0, 0])
                            stack += [(rows[~right], node, 0), (rows[right], node, 1)]
                            break
            if node is None:
                leaves += 1
                node = -leaves
            if parent >= 0:
                children[parent][side] = node
            if top is None:
                top = node
        return top

    everything = np.arange(len(sample))
    roots = [split(everything) for _ in range(trees)]
    d = sample.shape[1]
    return np.array(normals, float).reshape(-1, d), np.array(offsets, float), np.array(children, np.int32).reshape(-1, 2), np.array(roots, np.int32)


def descend(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree."""
    normals, offsets, children, roots = forest
    at = np.tile(roots, (len(x), 1))
    while (live := at >= 0).any():
        row, tree = np.nonzero(live)
        node = at[row, tree]
        right = np.einsum("ij,ij->i", normals[node], x[row]) > offsets[node]
        at[row, tree] = children[node, right.astype(np.int64)]
    return -1 - at


def search(forest: Forest, q: np.ndarray) -> Iterator[int]:
    """The leaves of all trees, best first for one query."""
    normals, offsets, children, roots = forest
    margins = normals @ q - offsets
    margins *= margins
    right = normals @ q > offsets
    queue = [(0.0, int(r)) for r in roots]
    heapq.heapify(queue)
    while queue:
        far, node = heapq.heappop(queue)
        while node >= 0:
            near = int(right[node])
            heapq.heappush(queue, (far + float(margins[node]), int(children[node, 1 - near])))
            node = int(children[node, near])
        yield -1 - node


def needed_leaves(forest: Forest, sample: np.ndarray, k: int, recall: float, seed: int, tries: int = 128) -> int:
    """The number of leaves in which sampled queries find the share ``recall`` of their ``k`` nearest sampled rows."""
    at = descend(forest, sample)
    rng = np.random.default_rng(seed)
    found: list[int] = []
    for i in rng.choice(len(sample), min(tries, len(sample)), replace=False).tolist():
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        wanted = np.argpartition(d, min(k, len(d) - 1))[:k]
        homes = {}
        for j in wanted.tolist():
            for leaf in at[j].tolist():
                homes.setdefault(leaf, []).append(j)
        missing = set(wanted.tolist())
        for n, leaf in enumerate(search(forest, sample[i]), 1):
            for j in homes.get(leaf, ()):
                if j in missing:
                    missing.remove(j)
                    found.append(n)
            if not missing:
                break
    return int(np.quantile(found, recall)) if found else 1


def _matrix(column, width: int) -> np.ndarray:
    """The vectors of a list column; an error unless all have the one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _reranker(k: int, width: int):
    """The nearest classes in one part of a cell, for each query that takes leaves there."""

    def rerank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows) and len(queries):
            order = np.argsort(rows.column("leaf").to_numpy(), kind="stable")
            x, ids, leaf = _matrix(rows.column("vector"), width)[order], rows.column("class_id").to_numpy()[order], rows.column("leaf").to_numpy()[order]
            for i, q, taken in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("query"), width), queries.column("taken").to_pylist(), strict=True):
                begin, end = np.searchsorted(leaf, taken), np.searchsorted(leaf, taken, "right")
                at = np.concatenate([np.arange(b, e) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                at = at[np.unique(ids[at], return_index=True)[1]]  # a cell may hold leaves of two trees
                d = np.sqrt(((x[at] - q) ** 2).sum(axis=1))
                if len(at) > k + 1:
                    near = d <= np.partition(d, k)[k]  # ties with the last are kept
                    at, d = at[near], d[near]
                found.append((np.full(len(at), i), ids[at], d))
        return pa.table(dict(zip(("query_id", "class_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return rerank


#: Neighbouring leaves of one cell, and rows of one part of it.
CELL, PART = 32, 8192


def nearest(table: DataFrame, k: int = 10, trees: int = 20, leaf: int = 16, sample: int = 16_384, recall: float = 0.96, every: int = 100, seed: int = 11) -> DataFrame:
    """The ``k`` nearest of all other rows for each row whose id is divisible by ``every``.

    ``table(vec_id long, embedding array<float>, ...)`` -> ``query_id, rank,
    vec_id, score`` (Euclidean distance in double precision), ties to the smaller
    vec_id. Vectors that are null, zero, or hold a null or non-finite component
    take no part, nor does a null id; an id that occurs several times counts for
    each of its vectors, and no row of the query's own id is a candidate. Vectors
    of different lengths are an error. With fewer than ``k`` others all are given;
    an empty table gives an empty table. Other columns are not read.
    The forest is fitted on at most ``sample`` vectors, and so is the number of
    leaves a query takes (for a share ``recall`` of the sample's true neighbours);
    all rows are indexed.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ann")
    rows = usable(table).distinct()
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = ranked.groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.save(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    chosen = classes.select("least_id", "class_id", "vector").orderBy(F.xxhash64("least_id"), "least_id", "class_id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    width = len(chosen[0]) if len(chosen) else 0
    vectors = _matrix(chosen, width)
    forest = grow(vectors, trees, leaf, seed) if len(vectors) else (np.empty((0, 0)), np.empty(0), np.empty((0, 2), np.int32), np.empty(0, np.int32))
    enough = needed_leaves(forest, vectors, k, recall, seed) if len(vectors) > 1 else 1
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def index(batches):
        for batch in batches:
            if len(batch):
                leaves = descend(shared.value, _matrix(batch.column("vector"), width))
                offsets = np.arange(len(batch) + 1, dtype=np.int32) * leaves.shape[1]
                lists = pa.ListArray.from_arrays(offsets, leaves.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("vector"), lists], names=["class_id", "vector", "leaves"])

    # Components that came as floats travel as floats.
    kind = table.schema["embedding"].dataType.simpleString()
    entries = scratch.save(classes.select("class_id", "vector").mapInArrow(index, "class_id long, vector array<double>, leaves array<int>").withColumn("vector", F.col("vector").cast(kind)), "entries")
    counts = entries.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # a row per leaf: bounded by the sample
    held = np.zeros(1 + max((r["leaf"] for r in counts), default=0), np.int64)
    for r in counts:
        held[r["leaf"]] = r["n"]
    parts = np.maximum(1, -(-np.add.reduceat(held, np.arange(0, len(held), CELL)) // PART))
    held_shared = spark.sparkContext.broadcast((held, parts))

    def probe(batches):
        held, parts = held_shared.value
        for batch in batches:
            out: list[tuple] = []
            for i, q in zip(batch.column("query_id").to_pylist(), _matrix(batch.column("query"), width), strict=True):
                cells: dict[int, list[int]] = {}
                n = rows_held = 0
                for leaf in search(shared.value, q):
                    if leaf < len(held) and held[leaf]:
                        cells.setdefault(leaf // CELL, []).append(leaf)
                        rows_held += int(held[leaf])
                    n += 1
                    # A row lies in one leaf a tree, so these hold more than k of them.
                    if n >= enough and rows_held >= trees * (k + 2):
                        break
                out += [(i, q, c, p, sorted(taken)) for c, taken in cells.items() for p in range(parts[c])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["query_id", "query", "cell", "part", "taken"])

    sizes = spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts.tolist()) if p > 1], "cell int, parts int")  # crowded cells: fewer than leaves of the forest
    placed = entries.select("class_id", "vector", F.explode("leaves").alias("leaf")).withColumn("cell", (F.col("leaf") / CELL).cast("int")).join(sizes, "cell", "left")
    left = placed.withColumn("part", F.pmod(F.xxhash64("class_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts").groupBy("cell", "part")
    right = queries.mapInArrow(probe, "query_id long, query array<double>, cell int, part int, taken array<int>").groupBy("cell", "part")
    scored = left.cogroup(right).applyInArrow(_reranker(k, width), "query_id long, class_id long, score double")
    once = scored.groupBy("query_id", "class_id").agg(F.min("score").alias("score"))
    # Classes tie by their smallest id, which decides whose ids can be given.
    named = once.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy("score"))).where(F.col("place") <= k + 1).join(classes.select("class_id", "ids"), "class_id")
    each = named.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
