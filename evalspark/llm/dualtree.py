"""Hard negatives by a dual-tree search.

Two trees of halving hyperplanes are fitted on bounded samples, one over the
anchors, one over the candidates; every row falls to a leaf of its tree. A node
has a centre and the greatest distance of any of its rows to it, so for a pair of
nodes all inner products lie in an interval. The trees are walked together from
their roots: a pair whose interval has nothing for any anchor of its group is
left out with all that lies below it. Leaf pairs that remain are scored exactly.

What a group still needs comes from a first visit of the few best leaves. For
positives it is the least score that an anchor's last place already has; for
negatives the least score that could still enter an anchor's list, and the
greatest positive score as a ceiling. The walk handles summaries of nodes, whose
number is bounded; rows meet in tasks only, in parts of bounded size on both
sides.

Equal vectors of one label are one candidate class while searching: only its
smallest ids can be among the first, so each class carries as many as a list has,
plus one for the anchor itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch, bounded_batches

#: Candidates and anchors that meet in one task.
PART, CHUNK = 4096, 1024


@dataclass
class Tree:
    """A full binary tree in heap order: a normal and a cut for each inner node, centres for all nodes."""

    normals: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray
    radii: np.ndarray | None = None  # negative where a node has no rows

    @property
    def leaves(self) -> int:
        return len(self.cuts) + 1


def fit(sample: np.ndarray, leaf: int, most: int, seed: int) -> Tree:
    """Halve the sample by the direction between two of its rows until leaves hold about ``leaf`` rows, ``2 ** most`` leaves at most."""
    rng = np.random.default_rng(seed)
    depth = min(most, max(0, int(np.log2(max(1, len(sample) / leaf)))))
    inner, d = 2**depth - 1, sample.shape[1]
    normals, cuts, centres = np.zeros((inner, d)), np.zeros(inner), np.zeros((2 * inner + 1, d))
    members = {0: np.arange(len(sample))}
    for node in range(2 * inner + 1):
        rows = members.pop(node)
        centres[node] = sample[rows].mean(axis=0) if len(rows) else centres[(node - 1) // 2] if node else 0
        if node < inner:
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normals[node] = a - b
                cuts[node] = np.median(sample[rows] @ normals[node])
            right = sample[rows] @ normals[node] > cuts[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return Tree(normals, cuts, centres)


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row, and its distances to the centres from the root to the leaf."""
    node, reach = np.zeros(len(x), np.int64), []
    while True:
        reach.append(np.sqrt(((x - tree.centres[node]) ** 2).sum(axis=1)))
        if not len(node) or node[0] >= len(tree.cuts):
            return node - len(tree.cuts), np.column_stack(reach)
        node = 2 * node + 1 + (np.einsum("ij,ij->i", tree.normals[node], x) > tree.cuts[node])


def _upwards(of_leaf: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """Values of all nodes in heap order, each combined from its children's."""
    inner = len(of_leaf) - 1
    out = np.concatenate([np.zeros(inner), of_leaf])
    for node in range(inner - 1, -1, -1):
        out[node] = combine(out[2 * node + 1], out[2 * node + 2])
    return out


def intervals(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between the rows of nodes ``i`` of one tree and ``j`` of the other; rounding is allowed for."""
    x, y, r, s = a.centres[i], b.centres[j], a.radii[i], b.radii[j]
    middle = np.einsum("ij,ij->i", x, y)
    size_x, size_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    around = size_x * s + size_y * r + r * s
    around += 1e-9 * (size_x + r) * (size_y + s) + 1e-6
    return middle - around, middle + around


def walk(a: Tree, b: Tree, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs whose interval reaches the group's floor and begins no higher than its ceiling; both are given for leaves of ``a``."""
    floors, ceilings = _upwards(floor, np.minimum), _upwards(ceiling, np.maximum)
    i = j = np.zeros(1, np.int64)
    while True:
        there = (a.radii[i] >= 0) & (b.radii[j] >= 0)
        i, j = i[there], j[there]
        low, high = intervals(a, b, i, j)
        near = (high >= floors[i]) & (low <= ceilings[i])
        i, j = i[near], j[near]
        open_i, open_j = i < len(a.cuts), j < len(b.cuts)
        if not (open_i | open_j).any():
            return i - len(a.cuts), j - len(b.cuts)
        # Leaves stay as they are; other nodes give way to their children.
        steps = [(i + (i + 1) * open_i + u * open_i, j + (j + 1) * open_j + v * open_j, (open_i | (u == 0)) & (open_j | (v == 0))) for u in (0, 1) for v in (0, 1)]
        i, j = (np.concatenate([s[n][s[2]] for s in steps]) for n in (0, 1))


def best_leaves(a: Tree, b: Tree, few: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf of ``a`` the ``few`` leaves of ``b`` with the nearest centres, as inner products go."""
    held = b.radii[len(b.cuts) :] >= 0
    score = np.where(held, a.centres[len(a.cuts) :] @ b.centres[len(b.cuts) :].T, -np.inf)
    j = np.argsort(-score, axis=1, kind="stable")[:, : min(few, int(held.sum()))]
    return np.repeat(np.arange(len(j)), j.shape[1]), j.ravel()


def _matrix(column) -> np.ndarray:
    """The vectors of a list column as whole numbers in doubles; an error if lengths differ."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.diff(column.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), widths[0] if len(widths) else 0)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if x.shape[1] != y.shape[1]:
        raise ValueError("vectors differ in length")
    most = float(np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1])
    if most >= 2**62:
        raise ValueError("inner products exceed 64 bits")
    return (x @ y.T).astype(np.int64) if most < 2**53 else x.astype(np.int64) @ y.astype(np.int64).T


def _meeting(rows: pa.Table, anchors: pa.Table):
    """Ids, labels and, for each anchor, its place and its scores; candidates by id."""
    if len(rows) and len(anchors):
        rows = rows.sort_by("vec_id")
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        scores = _products(_matrix(anchors.column("x")), _matrix(rows.column("x")))
        own, label = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        for i in range(len(anchors)):
            yield i, ids, scores[i], (labels == label[i]) & (ids != own[i]), labels != label[i]


def _table(names: tuple[str, ...], found: list[tuple]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [()] * len(names)
    return pa.table({n: np.concatenate([np.empty(0, np.int64), *c]) for n, c in zip(names, columns, strict=True)})


def _positives(k: int):
    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out, number = [], anchors.column("anchor").to_numpy()
        for i, ids, scores, same, _ in _meeting(rows, anchors):
            at = np.flatnonzero(same)
            at = at[np.argsort(-scores[at], kind="stable")[:k]]
            out.append((np.full(len(at), number[i]), ids[at], scores[at]))
        return _table(("anchor", "vec_id", "score"), out)

    return find


def _negatives(k: int, least: int, most: int):
    """For each anchor and positive score ``p`` the first ``k`` rows of another label with least * p <= 100 * score <= most * p."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out, number, positives = [], anchors.column("anchor").to_numpy(), anchors.column("ps").to_pylist()
        for i, ids, scores, _, other in _meeting(rows, anchors):
            at = np.flatnonzero(other)
            at = at[np.argsort(-scores[at], kind="stable")]
            s = 100 * scores[at]
            for p in positives[i]:
                begin = np.searchsorted(-s, -most * p)
                taken = at[begin : begin + k][s[begin : begin + k] >= least * p]
                out.append((np.full(len(taken), number[i]), np.full(len(taken), p), ids[taken], scores[taken]))
        return _table(("anchor", "p", "vec_id", "score"), out)

    return find


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows of each key by score, then by vec_id, with their ``rank``."""
    order = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", order).where(F.col("rank") <= k)


def _grown(rows: DataFrame, sample: int, leaf: int, most: int, seed: int) -> Tree:
    """A tree fitted on ``sample`` of ``rows(vec_id, x)`` at most."""
    chosen = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).select("x").toArrow().column("x")
    return fit(_matrix(chosen), leaf, most, seed)


def _routed(scratch: Scratch, rows: DataFrame, tree: Tree, name: str) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with their leaf, the radii of all nodes set in the tree, and the number of rows of each leaf."""
    shared = scratch.spark.sparkContext.broadcast(tree)  # bounded by the number of leaves

    def route(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"))
                if x.shape[1] != shared.value.centres.shape[1]:
                    raise ValueError("vectors differ in length")
                leaf, reach = descend(shared.value, x)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * reach.shape[1], reach.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), lists], names=[*batch.schema.names, "leaf", "reach"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = scratch.save(rows.mapInArrow(route, f"{fields}, leaf long, reach array<double>"), name)
    levels = int(np.log2(tree.leaves)) + 1
    widest = out.groupBy("leaf").agg(F.count("*").alias("n"), *[F.max(F.col("reach")[i]).alias(f"r{i}") for i in range(levels)]).collect()  # a row a leaf
    counts, tree.radii = np.zeros(tree.leaves, np.int64), np.full(2 * tree.leaves - 1, -1.0)
    for r in widest:
        counts[r["leaf"]], node = r["n"], r["leaf"] + tree.leaves - 1
        for i in range(levels - 1, -1, -1):
            tree.radii[node] = max(tree.radii[node], r[f"r{i}"])
            node = (node - 1) // 2
    return out.drop("reach"), counts


def whole_rows(table: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, x``: distinct rows with an id, a label and a complete, finite vector, whose components become floor(256 * x)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", F.transform("x", lambda x: F.floor(256 * x).cast("long")).alias("x")).distinct()


def shifted_label() -> Column:
    """The label, of ids divisible by 7 the next one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mine(table: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, every: int = 100, label: Column | None = None, sample: int = 16_384, leaf: int = 64, few: int = 4, seed: int = 5) -> DataFrame:
    """Hard negatives of each row whose id is divisible by ``every``.

    ``table(vec_id, embedding, label, ...)`` -> ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``. Scores are inner products of
    floor(256 * component). An anchor's positives are its first ``positives``
    rows of the same label; for each, the first ``negatives`` rows of another
    label with least * positive_score <= 100 * negative_score <= most *
    positive_score. Ties go to the smaller vec_id; ``label`` may replace the
    column.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part. Repeated rows count once; of an id with several vectors
    each is a row, and no row of an anchor's own id is its positive. Anchors
    without positives or negatives give no rows. Vectors of different lengths
    and products beyond 64 bits are errors; an empty table gives an empty one.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "dualtree")
    rows = scratch.save(whole_rows(table, label), "rows")
    alike = F.row_number().over(W.partitionBy("x", "label").orderBy("vec_id"))
    kept = rows.withColumn("place", alike).where(F.col("place") <= 1 + max(positives, negatives)).drop("place")
    chosen = rows.where(F.col("vec_id") % every == 0)
    a, b = _grown(chosen, sample, max(1, leaf // 8), 8, seed), _grown(rows, sample, leaf, 8, seed)
    if not rows.isEmpty() and chosen.isEmpty():
        a = Tree(np.zeros((0, b.centres.shape[1])), np.zeros(0), np.zeros((1, b.centres.shape[1])))
    anchors, n_anchors = _routed(scratch, chosen.withColumn("anchor", F.monotonically_increasing_id()), a, "anchors")
    candidates, sizes = _routed(scratch, kept, b, "candidates")
    parts = F.lit(np.maximum(1, -(-sizes // PART)).tolist())
    chunks = max(1, -(-int(n_anchors.sum()) // CHUNK))
    candidates = candidates.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(parts, (F.col("leaf") + 1).cast("int")))).select("leaf", "part", "vec_id", "label", "x")

    def visited(pairs: tuple[np.ndarray, np.ndarray], who: DataFrame, find, schema: str) -> DataFrame:
        """The findings of all leaf pairs, by parts of candidates and chunks of anchors."""
        others: dict[int, list[int]] = {}
        for i, j in zip(*(p.tolist() for p in pairs), strict=True):
            others.setdefault(i, []).append(j)
        listed = spark.createDataFrame(list(others.items()), "leaf long, others array<long>")  # bounded by the leaves of both trees
        chunk = F.pmod(F.xxhash64("anchor"), F.lit(chunks)).alias("chunk")
        goes = who.join(listed, "leaf").select(F.explode("others").alias("leaf"), "anchor", "vec_id", "label", "x", chunk, *[c for c in who.columns if c == "ps"])
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(parts, (F.col("leaf") + 1).cast("int")) - 1))
        goes = scratch.save(goes.withColumn("part", each), "goes")
        meets = scratch.save(goes.select("leaf", "part", "chunk").distinct(), "meets")
        come = candidates.join(meets, ["leaf", "part"]).groupBy("leaf", "part", "chunk")
        return come.cogroup(goes.groupBy("leaf", "part", "chunk")).applyInArrow(find, schema)

    def without(pairs: tuple[np.ndarray, np.ndarray], done: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fresh = ~np.isin(pairs[0] * b.leaves + pairs[1], done[0] * b.leaves + done[1])
        return pairs[0][fresh], pairs[1][fresh]

    def of_leaves(needs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The least floor and the greatest ceiling of each leaf's anchors; leaves without needs look for nothing."""
        low, high = np.full(a.leaves, np.inf), np.full(a.leaves, -np.inf)
        for r in needs.groupBy("leaf").agg(F.min("floor").alias("floor"), F.max("ceiling").alias("ceiling")).collect():  # a row a leaf
            low[r["leaf"]], high[r["leaf"]] = r["floor"], r["ceiling"]
        return low, high

    endless = F.lit(float("inf"))
    seeds, schema = best_leaves(a, b, few), "anchor long, vec_id long, score long"
    near = scratch.save(_first(visited(seeds, anchors, _positives(positives), schema), positives, "anchor"), "near")
    last = near.where(F.col("rank") == positives).select("anchor", F.col("score").cast("double").alias("floor"))
    needs = anchors.select("anchor", "leaf").join(last, "anchor", "left").select("leaf", F.coalesce("floor", -endless).alias("floor"), endless.alias("ceiling"))
    more = visited(without(walk(a, b, *of_leaves(needs)), seeds), anchors, _positives(positives), schema)
    best = scratch.save(_first(near.drop("rank").unionByName(more), positives, "anchor"), "positives")

    # A negative score can't lie between a negative bound and its smaller multiple.
    wanted = best.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("ps"))
    asking = scratch.save(anchors.join(wanted, "anchor"), "asking")
    schema = "anchor long, p long, vec_id long, score long"
    find = _negatives(negatives, least, most)
    near = scratch.save(_first(visited(seeds, asking, find, schema), negatives, "anchor", "p"), "near")
    last = near.where(F.col("rank") == negatives).select("anchor", "p", F.col("score").cast("double").alias("floor"))
    open_to = asking.select("anchor", "leaf", F.explode("ps").alias("p")).join(last, ["anchor", "p"], "left")
    needs = open_to.select("leaf", F.coalesce("floor", F.col("p") * least / 100).alias("floor"), (F.col("p") * most / 100).alias("ceiling"))
    more = visited(without(walk(a, b, *of_leaves(needs)), seeds), asking, find, schema)
    hard = scratch.save(_first(near.drop("rank").unionByName(more), negatives, "anchor", "p"), "negatives")
    named = best.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("p"))
    out = named.join(hard, ["anchor", "p"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


# The same by scoring every row for every anchor.
ORACLE = """
WITH t AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM t a JOIN t b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, vec_id) AS rank, vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""
