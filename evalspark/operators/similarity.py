"""Hash groups, diversity and identity by embeddings."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import unit_range
from .components import checkpointed, connected_components


def sign_hash(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``hash``: a 64-bit number with bit i set where component i is positive. Vectors of more components are refused."""
    held = F.when(F.size(vector) > 64, F.raise_error(F.lit("a sign hash holds 64 components at most")).cast("array<double>")).otherwise(F.col(vector).cast("array<double>"))
    bits = F.transform(held, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    word = F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return table.withColumn("hash", word)


@dataclass(frozen=True)
class Bands:
    """The 64 bits in bands: where each begins and ends, and within how many bits its values are looked up."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    radius: tuple[int, ...]

    @classmethod
    def of(cls, threshold: int, count: int) -> Bands:
        """Bands of which two hashes within ``threshold`` bits meet in one at least.

        Were they farther apart than its radius in every band, they would differ in
        more bits than the threshold: t % count + 1 bands have radius t // count,
        the others one less.
        """
        cuts = [b * 64 // count for b in range(count + 1)]
        radii = [threshold // count - (b > threshold % count) for b in range(count)]
        held = [b for b in range(count) if radii[b] >= 0]
        return cls(*(tuple(x[b] for b in held) for x in (cuts[:-1], cuts[1:], radii)))

    def looked_up(self) -> int:
        """Values that one hash looks up."""
        return sum(comb(h - w, i) for w, h, r in zip(self.low, self.high, self.radius, strict=True) for i in range(r + 1))

    def share(self) -> float:
        """The share of random pairs that meet, counted once for each band."""
        return sum(comb(h - w, i) / 2 ** (h - w) for w, h, r in zip(self.low, self.high, self.radius, strict=True) for i in range(r + 1))

    @classmethod
    def fitted(cls, threshold: int, rows: int, pairs: int) -> Bands:
        """The number of bands for which values looked up and pairs met are fewest together."""
        if threshold >= 64:
            return cls((0,), (0,), (0,))
        return min((cls.of(threshold, n) for n in range(1, threshold + 2)), key=lambda b: rows * b.looked_up() + pairs * b.share() if b.looked_up() <= 1 << 14 else inf)

    def mask(self, b: int) -> int:
        return (1 << self.high[b]) - (1 << self.low[b])

    def flips(self, b: int) -> list[int]:
        """Words of which each changes a value of the band into one within its radius."""
        bits = range(self.low[b], self.high[b])
        words = [sum(1 << i for i in c) for r in range(self.radius[b] + 1) for c in combinations(bits, r)]
        return [w - (1 << 64) if w >> 63 else w for w in words]


def met_pairs(hashed: DataFrame, threshold: int, bands: Bands, run: str = "run_id") -> DataFrame:
    """``run, u, v, hu, hv`` of pairs u < v that meet in a band, each in the first band where they do.

    Only one side is looked up under all values within the radius; the other has
    a row a band.
    """

    def word(value: int) -> Column:
        return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")

    def values(b: int, flipped: bool) -> Column:
        part = F.col("hash").bitwiseAND(word(bands.mask(b)))
        # One literal, folded once: thousands of them would be a tree as large.
        flips = F.split(F.lit(",".join(map(str, bands.flips(b)))), ",").cast("array<long>")
        words = F.transform(flips, lambda f: f.bitwiseXOR(part)) if flipped else F.array(part)
        return F.transform(words, lambda p: F.struct(F.lit(b).alias("b"), p.alias("p")))

    def rows(side: str, flipped: bool) -> DataFrame:
        keys = F.concat(*[values(b, flipped) for b in range(len(bands.low))])
        keyed = hashed.select(F.col(run).alias("run"), F.col("ordinal").alias(side), F.col("hash").alias("h" + side), F.explode(keys).alias("k"))
        return keyed.select("run", side, "h" + side, "k.b", "k.p")

    differ = F.col("hu").bitwiseXOR(F.col("hv"))
    first = F.lit(None).cast("int")
    for b in range(len(bands.low) - 1, -1, -1):
        first = F.when(F.bit_count(differ.bitwiseAND(word(bands.mask(b)))) <= bands.radius[b], b).otherwise(first)
    met = rows("u", True).join(rows("v", False), ["run", "b", "p"]).where("u < v")
    return met.where(F.col("b") == first).select("run", "u", "v", "hu", "hv")


def hamming_pairs(hashed: DataFrame, threshold: int = 5, run: str = "run_id", bands: Bands | None = None) -> DataFrame:
    """``run, u, v, distance`` of pairs of a run's images within ``threshold`` bits.

    The bits are cut into bands, in each of which hashes are looked up under all
    values within a few bits, so that wide thresholds keep wide bands. Without
    ``bands`` their number is fitted to the runs' sizes. From 64 bits on, one empty
    band pairs everything.
    """
    if bands is None:
        size = hashed.groupBy(run).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).first()
        bands = Bands.fitted(threshold, size["rows"] or 0, size["pairs"] or 0)
    distance = F.bit_count(F.col("hu").bitwiseXOR(F.col("hv")))
    met = met_pairs(hashed, threshold, bands, run).withColumn("distance", distance).where(F.col("distance") <= threshold)
    # A repeated row would give its pairs again.
    return met.select(F.col("run").alias(run), "u", "v", "distance").distinct()


def group_labels(hashed: DataFrame, threshold: int = 5, run: str = "run_id") -> DataFrame:
    """``run, ordinal, duplicate_group``: components of near hashes, numbered by first appearance.

    Images with one hash are one node, however many they are; nodes are paired by
    bands of their hashes and joined by star contraction, whose rounds are checkpointed.
    """
    nodes = checkpointed(hashed.groupBy(run, "hash").agg(F.min("ordinal").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    links = hamming_pairs(nodes.select(run, F.col("node").alias("ordinal"), "hash"), threshold, run).select("u", "v")
    found = nodes.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = found.groupBy("component").agg(F.min("first").alias("label"))
    labelled = hashed.select(run, "ordinal", "hash").join(found.join(first, "component").select(run, "hash", "label"), [run, "hash"])
    return labelled.select(run, "ordinal", (F.dense_rank().over(W.partitionBy(run).orderBy("label")) - 1).alias("duplicate_group"))


def diversity(hashed: DataFrame, bits: int = 64, run: str = "run_id") -> DataFrame:
    """Mean share of differing bits over all pairs of a run, from counts per bit; 0.0 for one image."""
    ones = [F.sum(F.shiftrightunsigned("hash", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(bits)]
    counted = hashed.groupBy(run).agg(F.count("*").alias("n"), *ones)
    differing = sum((F.col(f"b{b}") * (F.col("n") - F.col(f"b{b}")) for b in range(bits)), F.lit(0).cast("long"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return counted.select(run, "n", F.when(F.col("n") > 1, differing / pairs / bits).otherwise(0.0).alias("diversity"))


#: References of one block, and images that meet a block in one task.
BLOCK, IMAGES = 512, 4096


def _unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    x = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(size == 0, F.lit(0.0)).otherwise(v / size))


def _dot(a: Column, b: Column) -> Column:
    """Inner product; an error for different lengths."""
    value = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def _mean_cosine(images: DataFrame, refs: DataFrame) -> DataFrame:
    """The mean cosine is one inner product with the subject's summed unit vectors."""
    parts = refs.select("subject", F.posexplode("reference").alias("pos", "x")).groupBy("subject", "pos").agg(F.sum("x").alias("x"))
    summed = parts.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))
    sizes = refs.groupBy("subject").agg(F.count("*").alias("n"), F.min(F.size("reference")).alias("least"), F.max(F.size("reference")).alias("most"))
    totals = checkpointed(sizes.join(summed, "subject", "left"))
    score = F.when(F.col("least") != F.col("most"), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(_dot(F.col("unit"), F.coalesce("total", F.array().cast("array<double>"))) / F.col("n"))
    return images.join(totals, "subject").select("image", F.when(F.col("unit").isNull(), 0.0).otherwise(score).alias("s"))


def _packed(rows: pa.Table) -> pa.Table:
    """A block of references as one row: its centre, the widest angle to it, and all vectors one after another."""
    x = rows.column("reference").combine_chunks()
    widths = np.diff(x.offsets.to_numpy())
    if (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(rows), widths[0])
    centre = vectors.mean(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 0 else centre
    reach = float(np.arccos(np.clip(vectors @ centre, -1, 1)).max()) if size > 0 else np.pi
    keys = {c: rows.column(c)[:1] for c in ("subject", "cell", "part")}
    return pa.table(keys | {"centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "reach": [reach], "vectors": pa.array([flat.tolist()], pa.list_(pa.float64()))})


def _best_of_block(images: pa.Table, blocks: pa.Table) -> pa.Table:
    """The greatest cosine of each image with the references of one block."""
    best = np.empty(0)
    if len(images) and len(blocks):
        x = images.column("unit").combine_chunks()
        width = len(blocks.column("centre")[0])
        if (np.diff(x.offsets.to_numpy()) != width).any():
            raise ValueError("vectors differ in length")
        vectors = np.array(blocks.column("vectors")[0].as_py()).reshape(-1, width)
        best = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(images), width) @ vectors.T).max(axis=1)
    return pa.table({"image": images.column("image")[: len(best)], "s": best})


def _greatest_cosine(images: DataFrame, refs: DataFrame) -> DataFrame:
    """Images against blocks of references: first the block with the nearest centre, then those that may hold a nearer vector.

    References with like signs share a block, of a bounded size. All vectors of a
    block lie within an angle of its centre, so none is nearer to an image than
    the angle between image and centre less that one.
    """
    sizes = refs.groupBy("subject").agg(F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK)).cast("int"))).alias("bits"))
    signs = F.aggregate(F.slice(F.transform("reference", lambda v: F.when(v > 0, 1).otherwise(0)), 1, 30), F.lit(1), lambda s, b: s * 2 + b)
    cut = refs.join(sizes, "subject").withColumn("cell", F.when(F.col("bits") == 0, 1).otherwise(signs.cast("long") % F.pow(F.lit(2), F.col("bits")).cast("long")).cast("long"))
    held = cut.groupBy("subject", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = cut.join(held, ["subject", "cell"]).withColumn("part", F.pmod(F.xxhash64("reference"), "parts").cast("long"))
    kind = refs.schema["subject"].dataType.simpleString()
    key = ["subject", "cell", "part"]
    blocks = checkpointed(placed.select(*key, "reference").groupBy(*key).applyInArrow(_packed, f"subject {kind}, cell long, part long, centre array<double>, reach double, vectors array<double>"))
    whole = images.where("unit is not null")
    counts = whole.groupBy("subject").agg(F.ceil(F.count("*") / IMAGES).alias("chunks"))
    whole = checkpointed(whole.join(counts, "subject").withColumn("chunk", F.pmod(F.xxhash64("image"), "chunks").cast("long")).drop("chunks"))
    nearness = _dot(F.col("unit"), F.col("centre"))
    angles = checkpointed(whole.join(blocks.drop("vectors"), "subject").select("image", *key, nearness.alias("near"), "reach"))

    def visited(pairs: DataFrame) -> DataFrame:
        come = whole.join(pairs.select("image", "cell", "part"), "image")
        by = [*key, "chunk"]
        goes = checkpointed(come.select(*by).distinct()).toDF(*[f"_{c}" for c in by]).join(blocks, [F.col(f"_{c}") == F.col(c) for c in key]).select(*[F.col(f"_{c}").alias(c) for c in by], "centre", "vectors")
        return come.groupBy(*by).cogroup(goes.groupBy(*by)).applyInArrow(_best_of_block, "image long, s double")

    first = angles.groupBy("image").agg(F.max_by(F.struct("cell", "part"), F.struct("near", "cell", "part")).alias("b")).select("image", "b.cell", "b.part")
    first = checkpointed(first)
    found = checkpointed(visited(first))
    # Rounding is allowed for.
    bound = F.cos(F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "near"))) - F.col("reach"))) + 1e-9
    rest = angles.join(first, ["image", "cell", "part"], "left_anti").join(found, "image").where(F.isnan(bound) | (bound > F.col("s"))).select("image", "cell", "part")
    more = visited(rest)
    missing = images.where("unit is null").join(refs.select("subject").distinct(), "subject").select("image", F.lit(0.0).alias("s"))
    return found.unionByName(more).groupBy("image").agg(F.max("s").alias("s")).unionByName(missing)


def identity(images: DataFrame, references: DataFrame, how: str = "max") -> DataFrame:
    """``image_id, subject, embedding`` against ``subject, reference``: the best (or mean) cosine.

    Null without references; 0.0 without a face (a null embedding) and for a
    negative similarity; NaN stays NaN. No pair of an image and a reference is a
    row: the mean needs a sum a subject, the best meets references in blocks.
    """
    refs = references.toDF("subject", "reference").where("reference is not null").select("subject", _unit(F.col("reference")).alias("reference"))
    rows = checkpointed(images.select("image_id", "subject", _unit(F.col("embedding")).alias("unit")).withColumn("image", F.monotonically_increasing_id()))
    scored = (_greatest_cosine if how == "max" else _mean_cosine)(rows, refs)
    met = rows.select("image", "image_id", "subject").join(scored, "image", "left")
    best = met.groupBy("image_id", "subject").agg((F.max if how == "max" else F.avg)("s").alias("s"))
    return best.select("image_id", "subject", F.when(F.isnan("s"), F.col("s")).otherwise(unit_range(F.col("s"))).alias("identity"))
