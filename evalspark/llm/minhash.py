"""MinHash near-duplicate detection with b-bit signatures.

A document's set holds its distinct k-word shingles. One pass over the texts
keeps, per document, 1152 minima cut to their low 4 bits and packed into a binary
signature, and a 128-bit hash of the set. Bands are cut from the first 512
minima's packed bits, 64 of 8 each. Documents with equal sets collapse into one class; classes
that share a band are candidates. Bit counts of the packed signatures give a
similarity estimate that is corrected for chance collisions, and pairs far below
the threshold go. What is left is confirmed exactly on the full shingle sets.

Only connectivity is asked of a group, so a group of copies is not paired with
itself. Each band bucket has a centre. A class is first paired with one centre of
all its buckets, the link is confirmed and components are found; then with one
centre of each other component that it has met. Buckets that still hold several
components are compared in blocks of bounded size, and a pair leaves its block
only if it joins different components, has a good estimate, and shares no
earlier band. Nothing is capped.

At similarity 0.8 a pair shares a band with a probability of over 0.9999, and its
estimate, which only pairs of the blocks need, is kept with over 0.99999. Both are probabilities, not proofs; they hold
for sets of any size, as minima are mixed like independent random orders. A band
has 2**32 values, so beyond some 10**9 classes BITS should be 8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .blocks import placed
from .components import REACHED, connected_components
from .scratch import Scratch, bounded_batches
from .words import hashes, pieces, rolling, words

MINIMA, BANDS, ROWS, BITS = 1152, 64, 8, 4
CHUNK = 64
#: Members of a bucket that one block holds on each side.
BLOCK = 1024

_SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, packed binary"


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1), rng.integers(0, 2**32, MINIMA, np.uint32)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; words lower-cased in A-Z."""
    out: list[np.ndarray] = []
    for begin, end in pieces(texts, lambda t: len(t or ""), 1 << 22):
        split = [words(t, lower=True) for t in texts[begin:end]]
        sizes = [len(s) for s in split]
        h = hashes([w for s in split for w in s])
        rolled, at = rolling(h, k), 0
        for n in sizes:
            if n >= k:
                out.append(np.unique(rolled[at : at + n - k + 1]))
            elif n:
                out.append(rolling(h[at : at + n], n))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash by each permutation. Sums and products alone keep order among few values, so a finaliser follows."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), CHUNK):
        h = x[i : i + CHUNK] * a
        h += b
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        np.minimum(least, h.min(axis=0), out=least)
    return least ^ (least >> np.uint32(16))


def _pack(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << np.uint8(BITS))


def _unpack(packed: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), MINIMA // 2)
    return np.stack([both & np.uint8(15), both >> np.uint8(BITS)], axis=2).reshape(len(packed), MINIMA)


def _bands(low: np.ndarray) -> np.ndarray:
    """The value of each band of the unpacked signatures."""
    nibbles = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint32)
    return np.bitwise_or.reduce(nibbles << (np.arange(ROWS, dtype=np.uint32) * np.uint32(BITS)), axis=2)


def _signer(k: int):
    def sign(batches):
        a, b = _permutations()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            n = len(sets)
            least, digest = np.zeros((n, MINIMA), np.uint32), np.zeros((n, 2), np.int64)
            for i, s in enumerate(sets):
                if len(s):
                    least[i] = _minima(s, a, b)
                    digest[i] = np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)
            packed = pa.array([row.tobytes() if len(s) else None for row, s in zip(_pack(least), sets, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), packed],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "packed"],
            )

    return sign


def _bander(batches):
    """``rep, n_shingles, packed`` -> ``rep, n_shingles, band``: the band's number above its 32-bit value."""
    for batch in batches:
        values = _bands(_unpack(batch.column("packed").to_pylist())).astype(np.int64) | (np.arange(BANDS, dtype=np.int64) << 32)
        reps, sizes = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("rep", "n_shingles"))
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(sizes), pa.array(values.ravel())], names=["rep", "n_shingles", "band"])


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity estimates of signature pairs from bit counts, less the matches that chance gives."""
    differ = x ^ y
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    unequal = np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 1.0 / 2**BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def _comparer(least: float, percent: int):
    """Pairs of one block of a bucket, with their labels: different labels, a good estimate, and no earlier shared band."""

    def compare(group: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.empty((0, 4), np.int64)]
        rep, label, side, size = (group.column(c).to_numpy() for c in ("rep", "label", "side", "n_shingles"))
        packed = group.column("packed").to_pylist()
        number = group.column("band")[0].as_py() >> 32
        words, bands = np.frombuffer(b"".join(packed), np.uint64).reshape(len(rep), -1), _bands(_unpack(packed))[:, :number]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        for i in left.tolist():
            j = right[(label[right] != label[i]) & ((side[right] != 1) | (side[i] != 1) | (rep[right] > rep[i]))]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            j = j[_estimate(words[j], words[i]) >= least]
            j = j[~(bands[j] == bands[i]).any(axis=1)]
            found.append(np.column_stack([np.full(len(j), rep[i]), rep[j], np.full(len(j), label[i]), label[j]]))
        return pa.table(dict(zip(("u", "v", "label_u", "label_v"), np.concatenate(found).T, strict=True)))

    return compare


def _set_maker(k: int):
    def make(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            first = np.array([np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)[0] if len(s) else 0 for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(first), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "set_a", "shingles"])

    return make


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, slack: float = 0.0615, with_hash: bool = False) -> DataFrame:
    """Components of documents whose shingle sets have 100 * |A & B| >= percent * |A | B|.

    ``docs(doc_id long, text string, ...)``; other columns are not read. Returns
    one row per input row: ``doc_id, n_shingles, component_id, kept``, and with
    ``with_hash`` also ``text_hash``, Spark's ``xxhash64`` of the row's text.

    Texts with fewer than ``k`` words have the whole word sequence as their one
    shingle; null, empty and blank texts have an empty set and link with nothing.
    Repeated rows are copies of each other; of a doc_id that carries several
    texts, each row is judged by its own text; those of one component all stay if
    the id is its smallest. A row with a null doc_id takes no
    part: null component, kept. An empty table gives an empty table.
    ``slack`` is how far below the threshold the signature estimate may lie: 0.0615
    is five standard deviations of the estimate at similarity 0.8.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signer(k), _SIGNED), "signed")
    key = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.max("packed").alias("packed"))
    # Classes have numbers of their own, which stay as written: one id may be the smallest of several.
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = scratch.save(classes.select("rep", "n_shingles", "packed").mapInArrow(_bander, "rep long, n_shingles long, band long"), "banded")
    # Written, so that the join has a plain shuffle on either side and Spark can split a crowded band.
    buckets = scratch.save(banded.groupBy("band").agg(F.count("*").alias("n"), F.min_by(F.struct(F.col("rep").alias("centre"), F.col("n_shingles").alias("centre_size")), F.xxhash64("rep")).alias("c")).where("n > 1").select("band", "n", "c.*"), "buckets")
    members = scratch.save(banded.join(buckets, "band"), "members")
    scratch.drop(banded, buckets)
    scratch.sweep()
    involved = classes.select("rep", F.col("least_id").alias("doc_id"), "set_a").join(members.select("rep").distinct(), "rep", "left_semi")
    #: A class's smallest document carries its shingles; an id with several texts has several sets.
    holders = texts.join(involved.select("doc_id").distinct(), "doc_id").mapInArrow(_set_maker(k), "doc_id long, set_a long, shingles array<long>")
    held = holders.join(classes.select("rep", F.col("least_id").alias("doc_id"), "set_a", "n_shingles", "packed"), ["doc_id", "set_a"])
    sets = scratch.save(held.dropDuplicates(["rep"]).drop("doc_id", "set_a"), "sets")
    scratch.sweep()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs(u, v, ...)`` whose full sets are linked."""
        a, b = sets.select("rep", "shingles", "n_shingles").toDF("u", "set_u", "n_u"), sets.select("rep", "shingles", "n_shingles").toDF("v", "set_v", "n_v")
        fits = pairs.join(a, "u").join(b, "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        both = F.size(F.array_intersect("set_u", "set_v"))
        return fits.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("n_u") + F.col("n_v") - F.col("both"))).select(*pairs.columns)

    def mixed(rows: DataFrame) -> DataFrame:
        """The members of bands that hold several labels, and the label of the band's centre."""
        bands = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("rep") == F.col("centre"), F.col("label"))).alias("main_label"))
        return rows.join(bands.where("lo < hi").select("band", "main_label"), "band")

    def relabelled(rows: DataFrame, component: DataFrame) -> DataFrame:
        return rows.join(component.toDF("label", "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")

    alike = 100 * F.least("n_shingles", "centre_size") >= percent * F.greatest("n_shingles", "centre_size")
    # First one pair a class, with one centre of all its bands: in a crowd mostly the same one.
    star = members.where((F.col("centre") != F.col("rep")) & alike).groupBy(F.col("rep").alias("u")).agg(F.min_by("centre", F.xxhash64("centre")).alias("v"))
    label = scratch.save(connected_components(scratch, confirmed(star)), "label")
    scratch.sweep()
    apart = scratch.save(mixed(relabelled(members.drop("n").withColumn("label", F.col("rep")), label)), "apart")
    # Then one pair for each class and other component whose centre it has met.
    again = apart.where((F.col("label") != F.col("main_label")) & alike).groupBy(F.col("rep").alias("u"), F.col("label").alias("label_u"), F.col("main_label").alias("label_v"))
    again = again.agg(F.min_by("centre", F.xxhash64("rep", "centre")).alias("v"))
    between = scratch.save(confirmed(again).select(F.col("label_u").alias("u"), F.col("label_v").alias("v")), "between")
    # What still shares a band under different labels is compared in blocks; rows of the centre's component need no comparing.
    left = scratch.save(mixed(relabelled(apart.drop("main_label"), connected_components(scratch, between))).withColumn("main", F.col("label") == F.col("main_label")), "left")
    scratch.sweep()
    counts = left.groupBy("band").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest"))
    split = placed(left.join(counts, "band"), F.col("main"), "rep", BLOCK).select("band", "x", "y", "side", "rep", "label", "n_shingles").join(sets.select("rep", "packed"), "rep")
    pairs = split.groupBy("band", "x", "y").applyInArrow(_comparer(percent / 100 - slack, percent), "u long, v long, label_u long, label_v long")
    more = confirmed(pairs.distinct()).select(F.col("label_u").alias("u"), F.col("label_v").alias("v"))
    # The new links are between components, so only component ids need joining again.
    outer = scratch.save(connected_components(scratch, between.unionByName(more)), "outer")
    scratch.sweep()
    first = classes.select(*key, "rep", "least_id").join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "least_id", F.coalesce("component", "rep").alias("inner"))
    # Written, so that Spark can split the join of a large component.
    numbered = scratch.save(first.join(outer.toDF("inner", "outer"), "inner", "left").select(*key, "least_id", F.coalesce("outer", "inner").alias("number")), "numbered")
    roots = scratch.save(numbered.groupBy("number").agg(F.min("least_id").alias("found"), F.count("*").alias("n")).where("n > 1").select("number", "found"), "roots")
    found = numbered.join(roots, "number", "left").select(*key, F.coalesce("found", "least_id").alias("found"))
    out = signed.select("doc_id", "text_hash", *key).join(found, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", *(["text_hash"] if with_hash else []), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


# The same by counting common shingles of all pairs that have any.
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
p AS (SELECT doc_id, len(words) AS many, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
g AS (SELECT doc_id, many, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM p),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE pos <= greatest(many - 3, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM m JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * common >= 80 * (nu.n + nv.n - common)),
{REACHED}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN components ON node = w.doc_id
"""
