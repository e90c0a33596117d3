"""Embedding near-dedup by cross-polytope hashing with verified links.

A hash rotates a vector by three rounds of random signs and a fast Hadamard
transform and names the nearest signed axis. A table's bucket joins three such
hashes; probes add the buckets with one second-nearest axis. Vectors that share
a bucket are candidates, and every link is verified in double precision.

Equal vectors are one class. Candidates first give components: a class is
verified against the centre that most of its buckets share, then against the
centres of other components that it has met, and buckets that still hold several
components are compared in blocks of bounded size, which pass on one link for
each two components.

Links are then counted once per component, not once per bucket. Angles obey the
triangle inequality: members of a component whose angles to its first vector add
up to less than the bound are linked without being compared. So only the members
farther out than half the bound are compared, with each other and with the rest,
in blocks; a crowd of near copies has none. A component of n members of which m
lie farther out takes m * n products of vectors, the one step that can grow
faster than its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import placed
from .components import REACHED, connected_components
from .scratch import Scratch, bounded_batches
from .vectors import flagged

TABLES, HASHES, SEED = 17, 3, 23
#: A table gives a vector its own bucket and one probe for each hash.
PROBES = 1 + HASHES
#: Members of one side of a block, and placements that one call handles.
BLOCK, TOGETHER = 512, 8192
#: Radians by which an angle must clear a bound before it stands for a comparison.
MARGIN = 1e-6

def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, d // (2 * half), 2, half)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x


def _axes(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second-nearest signed axis of each row after a random rotation."""
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1])) / np.sqrt(x.shape[1])
    size = np.abs(x)
    rows = np.arange(len(x))
    first = size.argmax(axis=1)
    size[rows, first] = -1
    second = size.argmax(axis=1) if x.shape[1] > 1 else first
    return tuple(2 * a + (x[rows, a] > 0) for a in (first, second))


def buckets(x: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers of unit rows, PROBES for each table in turn. Rotations depend on the width alone."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), PROBES * tables), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        axes = [_axes(padded, rng) for _ in range(HASHES)]
        for p in range(PROBES):
            key = np.full(len(x), t, np.int64)
            for h, (first, second) in enumerate(axes):
                key = key * 2 * width + (second if h + 1 == p else first)
            out[:, PROBES * t + p] = key
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_width(column):
    """Row numbers and unit rows of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    for w in np.unique(sizes):
        at = np.flatnonzero(sizes == w)
        yield at, _unit(_matrix(column.take(pa.array(at))))


def _hasher(tables: int, seed: int):
    def go(batches):
        for batch in batches:
            found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
            for at, x in _by_width(batch.column("vector")):
                keys = np.sort(buckets(x, tables, seed), axis=1)
                row, place = np.nonzero(np.diff(keys, axis=1, prepend=-1))
                ids = batch.column("class_id").to_numpy()[at]
                found.append(np.column_stack([keys[row, place], np.full(len(row), x.shape[1]), ids[row]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found).T], names=["bucket", "width", "class_id"])

    return go


def _verifier(batches):
    """``x, y, cosine`` of each row's two vectors, which are of one length."""
    for batch in batches:
        cosine = np.zeros(len(batch))
        for (at, x), (_, y) in zip(_by_width(batch.column("x")), _by_width(batch.column("y")), strict=True):
            cosine[at] = np.einsum("ij,ij->i", x, y)
        kept = [c for c in batch.schema.names if c not in ("x", "y")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cosine)], names=[*kept, "cosine"])


def _blocks(group: pa.Table, keys: list[str]):
    """The row numbers of each block of one call."""
    columns = [group.column(c).to_numpy() for c in keys]
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        new |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new) + 1)


def _linker(least: float):
    """Of the blocks of one call: each two labels that a link joins."""

    def link(group: pa.Table) -> pa.Table:
        x, label, side = _unit(_matrix(group.column("vector"))), group.column("label").to_numpy(), group.column("side").to_numpy()
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        for rows in _blocks(group, ["bucket", "x", "y"]):
            left, right = rows[side[rows] <= 1], rows[side[rows] >= 1]
            i, j = np.nonzero((x[left] @ x[right].T >= least) & (label[left][:, None] != label[right][None, :]))
            both = np.sort(np.column_stack([label[left[i]], label[right[j]]]), axis=1)
            found.append(np.unique(both, axis=0))
        u, v = np.unique(np.concatenate(found), axis=0).T
        return pa.table({"u": u, "v": v})

    return link


def _counter(least: float):
    """Of the blocks of one call: per class the copies linked to it there. Two main rows are linked without being compared."""

    def count(group: pa.Table) -> pa.Table:
        x, ids, copies, side = _unit(_matrix(group.column("vector"))), group.column("class_id").to_numpy(), group.column("copies").to_numpy(), group.column("side").to_numpy()
        total = np.zeros(len(ids), np.int64)
        for rows in _blocks(group, ["component", "x", "y"]):
            left, right = rows[side[rows] <= 1], rows[side[rows] >= 1]
            met = x[left] @ x[right].T >= least
            if side[rows[0]] == 1:
                np.fill_diagonal(met, False)
                total[left] += met @ copies[right]
            else:
                total[left] += met @ copies[right]
                total[right] += met.T @ copies[left]
        return pa.table({"class_id": ids, "new": total})

    return count


def near_duplicates(table: DataFrame, least: float = 0.9, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """Links of cosine ``least`` or more, and their components.

    ``table(vec_id long, embedding array<float>, ...)`` -> one row per input row:
    ``vec_id, n_links, component_id, kept``. Cosines are taken in double precision.
    Vectors that are null, zero, or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths with each other. Repeated rows
    are vectors of their own that link with each other (under one id, which is
    then its own neighbour). A row with a null vec_id takes no part: no links, a
    null component, kept. An empty table gives an empty table. Other columns are
    not read. No link below ``least`` is ever made; a pair at 0.9 is missed with a
    chance of about one in ten thousand, and less the closer it is, and never
    where other links join its two vectors.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "crosspolytope")
    key = ["key_a", "key_b"]
    keyed = flagged(table).withColumns({"key_a": F.xxhash64("vector"), "key_b": F.xxhash64(F.lit(seed), "vector")})
    rows = scratch.save(keyed.select("vec_id", "usable", *key), "rows")
    #: A class is a vector; its id is its smallest row's, and a number of its own where one id has several vectors.
    classes = keyed.where("usable").groupBy("vector", *key).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    vectors = classes.select("class_id", "vector")
    hashed = scratch.save(vectors.mapInArrow(_hasher(tables, seed), "bucket long, width long, class_id long"), "hashed")
    bucket = ["bucket", "width"]
    order = F.xxhash64("class_id")
    # Written, so that the join has a plain shuffle on either side and Spark can split a crowded bucket.
    crowded = scratch.save(hashed.groupBy(*bucket).agg(F.count("*").alias("n"), F.min_by("class_id", order).alias("centre")).where("n > 1").drop("n"), "crowded")
    members = scratch.save(hashed.join(crowded, bucket), "members")
    scratch.drop(hashed, crowded)
    scratch.sweep()

    def linked(pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs(u, v, ...)`` with a cosine of ``least`` or more."""
        both = pairs.join(vectors.toDF("u", "x"), "u").join(vectors.toDF("v", "y"), "v").select(*pairs.columns, "x", "y")
        schema = ", ".join(f"{c} long" for c in pairs.columns)
        return both.mapInArrow(_verifier, f"{schema}, cosine double").where(F.col("cosine") >= least).drop("cosine")

    def mixed(rows: DataFrame) -> DataFrame:
        """The members of buckets that hold several labels, and the label of the bucket's first member, which is its centre."""
        held = rows.groupBy(*bucket).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", order).alias("main_label"))
        return rows.join(held.where("lo < hi").select(*bucket, "main_label"), bucket)

    def relabelled(rows: DataFrame, component: DataFrame) -> DataFrame:
        """``alone`` stays true while a label's component is its class alone."""
        found = rows.join(component.toDF("label", "component"), "label", "left")
        return found.withColumns({"label": F.coalesce("component", "label"), "alone": F.col("alone") & F.col("component").isNull()}).drop("component")

    # A class and the centre that most of its buckets share: chance meetings are single ones.
    shared = members.where(F.col("class_id") != F.col("centre")).groupBy(F.col("class_id").alias("u"), F.col("centre").alias("v")).agg(F.count("*").alias("n"))
    star = shared.groupBy("u").agg(F.max_by("v", F.struct(F.col("n"), F.xxhash64("v").alias("h"))).alias("v"))
    label = scratch.save(connected_components(scratch, linked(star)), "label")
    apart = scratch.save(mixed(relabelled(members.withColumns({"label": F.col("class_id"), "alone": F.lit(True)}), label)), "apart")
    scratch.sweep()
    again = apart.where(F.col("label") != F.col("main_label")).groupBy(F.col("class_id").alias("u"), F.col("label").alias("label_u"), F.col("main_label").alias("label_v"))
    again = again.agg(F.min_by("centre", F.xxhash64("class_id", "centre")).alias("v"))
    between = scratch.save(linked(again).select(F.col("label_u").alias("u"), F.col("label_v").alias("v")), "between")
    # A centre that has remained alone has met all its members above; where two meet by chance, nothing is left.
    left = relabelled(apart.drop("main_label"), connected_components(scratch, between)).where((F.col("class_id") != F.col("centre")) | ~F.col("alone"))
    left = scratch.save(mixed(left).withColumn("main", F.col("label") == F.col("main_label")), "left")
    counts = left.groupBy(*bucket).agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest"))

    def together(rows: DataFrame, *names: str) -> DataFrame:
        """Blocks dealt to calls of bounded size, with their vectors."""
        load = rows.count()
        call = F.pmod(F.xxhash64(*names, "x", "y"), F.lit(max(1, load // TOGETHER)))
        return rows.withColumn("call", call).join(vectors.withColumn("width", F.size("vector").cast("long")), ["class_id", "width"]).groupBy("width", "call")

    split = scratch.save(placed(left.join(counts, bucket), F.col("main"), "class_id", BLOCK).select("bucket", "width", "x", "y", "side", "class_id", "label"), "split")
    more = together(split, "bucket").applyInArrow(_linker(least), "u long, v long")
    outer = scratch.save(connected_components(scratch, between.unionByName(more)), "outer")
    component = scratch.save(relabelled(label.toDF("class_id", "label").withColumn("alone", F.lit(False)), outer).drop("alone").unionByName(outer.join(label, "node", "left_anti").toDF("class_id", "label")), "component")
    scratch.sweep()
    # Counting: angles to the component's first vector tell who needs no comparing.
    joined = component.select(F.col("class_id").alias("u"), F.col("label").alias("v"))
    angled = joined.join(vectors.toDF("u", "x"), "u").join(vectors.toDF("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(_verifier, "u long, v long, cosine double")
    half = np.arccos(min(1.0, max(-1.0, least))) / 2 - MARGIN
    angled = angled.select(F.col("u").alias("class_id"), F.col("v").alias("component"), (F.acos(F.least(F.lit(1.0), "cosine")) <= half).alias("main"))
    sized = classes.select("class_id", "least_id", "copies", F.size("vector").cast("long").alias("width"), *key)
    inside = scratch.save(angled.join(sized, "class_id"), "inside")
    main = F.when(F.col("main"), F.col("copies")).otherwise(0)
    whole = inside.groupBy("component").agg(F.sum(main).alias("near"), F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest"), F.min("least_id").alias("found"))
    inside = scratch.save(inside.join(scratch.save(whole, "whole"), "component"), "inside")
    met = scratch.save(placed(inside, F.col("main"), "class_id", BLOCK).select("component", "width", "x", "y", "side", "class_id", "copies"), "met")
    new = together(met, "component").applyInArrow(_counter(least), "class_id long, new long").groupBy("class_id").agg(F.sum("new").alias("new"))
    sure = F.when(F.col("main"), F.col("near")).otherwise(F.col("copies"))
    linked_rows = inside.select("class_id", sure.alias("sure"), "found").join(new, "class_id", "left").select("class_id", (F.col("sure") - 1 + F.coalesce("new", F.lit(0))).alias("n"), "found")
    known = sized.select("class_id", "copies", "least_id", *key).join(linked_rows, "class_id", "left")
    known = known.select(*key, F.coalesce("n", F.col("copies") - 1).alias("n_links"), F.coalesce("found", "least_id").alias("component_id"))
    # Equal digests of different vectors would join a row twice; such an input is refused.
    known = known.groupBy(*key).agg(F.count("*").alias("n"), F.min("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    known = known.select(*key, F.when(F.col("n") == 1, F.col("n_links")).otherwise(F.raise_error(F.lit("two vectors share a digest")).cast("long")).alias("n_links"), "component_id", F.lit(True).alias("usable"))
    out = rows.join(known, [*key, "usable"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# The same by comparing all pairs.
ORACLE = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM e WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
{REACHED},
d AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM e LEFT JOIN d ON d.u = vec_id LEFT JOIN components ON node = vec_id
"""
