"""Human review and second-pass refinement, folded from update logs; archives of rejects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import checkpointed
from .numbering import running_total

#: Distinct ratings of one block, when values meet in blocks.
BLOCK = 2048


def last_updates(updates: DataFrame, *key: str) -> DataFrame:
    """Only the last update of each key within a batch, by ``ord``."""
    picked = updates.groupBy(*key).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in key]), "ord").alias("u"))
    return picked.select(*key, "u.*")


def decision():
    """Reasons reject; else no rating decides nothing; else three stars and more pass."""
    return F.when(F.coalesce(F.size("reject_codes"), F.lit(0)) > 0, F.lit(False)).when(F.col("hitl_rating").isNotNull(), F.col("hitl_rating") >= 3)


def apply_reviews(images: DataFrame, updates: DataFrame) -> DataFrame:
    """Images with all review batches folded in, in order.

    ``updates(run_id, image_id, batch, ord, rater, hitl_rating, reject_codes)``;
    within a batch the last update of an image counts. An undecided one keeps the
    decision as it stands. Rating and codes are those of the last batch, the
    rater is the last one named. Updates of unknown images are ignored.
    """
    key = ["run_id", "image_id"]
    if updates.where(F.col("hitl_rating").isNotNull() & ~F.col("hitl_rating").between(1, 5)).limit(1).count():
        raise ValueError("ratings run from 1 to 5")
    each = last_updates(updates, *key, "batch").withColumn("decision", decision())
    state = each.groupBy(*key).agg(
        F.max_by("decision", F.when(F.col("decision").isNotNull(), F.col("batch"))).alias("decision"), F.max_by("hitl_rating", "batch").alias("hitl_rating"),
        F.max_by("reject_codes", "batch").alias("hitl_codes"), F.max_by("rater", F.when(F.col("rater").isNotNull(), F.col("batch"))).alias("hitl_rater"),
    )
    joined = images.drop("hitl_rating", "hitl_codes", "hitl_rater").join(state, key, "left")
    return joined.withColumn("passed", F.coalesce("decision", "passed")).drop("decision")


def stray_updates(images: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates of images that did not pass or do not exist."""
    return updates.join(images.where("passed").select("run_id", "image_id"), ["run_id", "image_id"], "left_anti")


def apply_refinements(images: DataFrame, updates: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``rank, notes, refined_by`` of passing images from ``updates(run_id, image_id, batch, ord, rater, rank, notes)``.

    A null rank clears the layer; notes and rater fall back to earlier ones of the same layer.
    """
    if strict and stray_updates(images, updates).limit(1).count():
        raise ValueError("only passing images can be refined")
    key = ["run_id", "image_id"]
    each = last_updates(updates, *key, "batch")
    cleared = each.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("rank").isNull(), F.col("batch"))), F.lit(-1).cast("long")).alias("cleared"))
    live = each.join(cleared, key).where(F.col("batch") > F.col("cleared"))
    state = live.groupBy(*key).agg(
        F.max_by("rank", "batch").alias("rank"), F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("batch"))).alias("notes"),
        F.max_by("rater", F.when(F.col("rater").isNotNull(), F.col("batch"))).alias("refined_by"),
    )
    out = images.join(state, key, "left")
    on = F.coalesce(F.col("passed"), F.lit(False))
    return out.withColumns({c: F.when(on, F.col(c)) for c in ("rank", "notes", "refined_by")})


def refined_ranking(images: DataFrame) -> DataFrame:
    """Passing images of each run by refinement, then stars, then id; ``place`` from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy(F.col("rank").isNull(), F.desc("rank"), F.desc(F.coalesce("hitl_rating", F.lit(0))), "image_id")
    return images.where("passed").withColumn("place", F.row_number().over(order))


def reject_records(images: DataFrame) -> DataFrame:
    """Metadata of rejected images only: no path and no image id leaves the run."""
    return images.where("passed = false").drop("path", "image_id", "passed", "duplicate_group")


def missing_images(decided: DataFrame, files: DataFrame) -> DataFrame:
    """Decided rows of which no file is there."""
    return decided.where("passed is not null").join(files, "image_id", "left_anti")


def passing(images: DataFrame) -> DataFrame:
    return images.where("passed")


def krippendorff_alpha(ratings: DataFrame, level: str = "interval") -> DataFrame:
    """One row ``alpha, n_ratings, n_units`` from ``ratings(unit_id, rater, rating)``.

    Only units with two ratings or more count; NaN without one, without two
    raters, or when all ratings are equal. ``interval`` needs sums per unit and
    ``nominal`` counts per value. ``ordinal`` is ``interval`` on the ranks of the
    values, each in the middle of its equals, since its distance is a difference
    of those. For these three no pairs are made. At ``ratio`` the distinct values
    of a unit, and of all units, meet in blocks of bounded size.
    """
    held = ratings.where("rating is not null and not isnan(rating)").withColumn("rating", F.col("rating").cast("double"))
    if level == "ordinal":
        return krippendorff_alpha(_ranked(held), "interval")
    if level == "interval":
        units = held.groupBy("unit_id").agg(F.count("*").alias("m"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q")).where("m > 1")
        sums = units.agg(F.sum("m").alias("n"), F.count("*").alias("u"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"))
        expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    elif level == "nominal":
        counts = held.groupBy("unit_id", "rating").agg(F.count("*").alias("c"))
        units = counts.groupBy("unit_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc")).where("m > 1")
        values = counts.join(units.select("unit_id"), "unit_id").groupBy("rating").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("vv"))
        sums = units.agg(F.sum("m").alias("n"), F.count("*").alias("u"), F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("o")).crossJoin(F.broadcast(values))
        expected = (F.col("n") * F.col("n") - F.col("vv")) / (F.col("n") * (F.col("n") - 1))
    elif level == "ratio":
        return _alpha_by_ratio(held)
    else:
        raise ValueError(f"level {level!r} is not supported")
    raters = held.agg(F.approx_count_distinct("rater").alias("raters"))
    ok = (F.col("raters") > 1) & (F.col("u") > 0) & (expected > 0)
    alpha = F.when(ok, 1 - (F.col("o") / F.col("n")) / expected).otherwise(F.lit(float("nan")))
    return sums.crossJoin(F.broadcast(raters)).select(alpha.alias("alpha"), F.coalesce("n", F.lit(0)).alias("n_ratings"), F.col("u").alias("n_units"))


def _ranked(held: DataFrame) -> DataFrame:
    """Ratings of the units that count, replaced by the middle of their ranks, measured from the middle of all."""
    paired = held.groupBy("unit_id").agg(F.count("*").alias("m")).where("m > 1").select("unit_id")
    rows = held.join(paired, "unit_id")
    values = running_total(rows.groupBy("rating").agg(F.count("*").alias("t")), "t", "upto", "rating")
    n = values.agg(F.max("upto")).first()[0] or 0
    middle = values.select("rating", (F.col("upto") - F.col("t") / 2 - n / 2).alias("middle"))
    return rows.join(middle, "rating").select("unit_id", "rater", F.col("middle").alias("rating"))


def _distances(batches):
    """Of two blocks of values with counts, the summed distances of all pairs, each counted in both orders."""
    for batch in batches:
        xs, cs, ys, ds = (batch.column(c).to_pylist() for c in ("x", "c", "y", "d"))
        sums = []
        for x, c, y, d, once in zip(xs, cs, ys, ds, batch.column("once").to_pylist(), strict=True):
            a, b = np.array(x)[:, None], np.array(y)[None, :]
            total = a + b
            apart = np.divide(a - b, total, out=np.zeros(total.shape), where=total != 0)
            sums.append(float(np.array(c, float) @ (apart * apart) @ np.array(d, float)) * (1 if once else 2))
        yield pa.RecordBatch.from_arrays([batch.column("weight"), pa.array(sums, pa.float64())], names=["weight", "sum"])


def _spread(counts: DataFrame) -> DataFrame:
    """``total`` of ``counts(unit_id, x, c, weight)``: squared ratio distances of all pairs of a unit, weighted by unit."""
    sizes = counts.groupBy("unit_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = counts.join(sizes, "unit_id").withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int"))
    blocks = placed.groupBy("unit_id", "part", "parts", "weight").agg(F.collect_list(F.struct("x", "c")).alias("v"))
    blocks = checkpointed(blocks.select("unit_id", "part", "parts", "weight", F.col("v.x").alias("x"), F.col("v.c").alias("c")))
    alone = blocks.where("parts = 1").select("weight", "x", "c", F.col("x").alias("y"), F.col("c").alias("d"), F.lit(True).alias("once"))
    several = blocks.where("parts > 1").withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    others = blocks.where("parts > 1").select("unit_id", F.col("part").alias("other"), F.col("x").alias("y"), F.col("c").alias("d"))
    met = several.join(others, ["unit_id", "other"]).select("weight", "x", "c", "y", "d", (F.col("part") == F.col("other")).alias("once"))
    each = alone.unionByName(met).mapInArrow(_distances, "weight double, sum double")
    return each.agg(F.coalesce(F.sum(F.col("weight") * F.col("sum")), F.lit(0.0)).alias("total"))


def _alpha_by_ratio(held: DataFrame) -> DataFrame:
    """Distances of two values are squares of their difference over their sum; 0 where the sum is."""
    counts = held.groupBy("unit_id", F.col("rating").alias("x")).agg(F.count("*").alias("c"))
    units = counts.groupBy("unit_id").agg(F.sum("c").alias("m")).where("m > 1")
    counts = checkpointed(counts.join(units, "unit_id"))
    # Units of one value have no distances.
    observed = _spread(counts.withColumn("weight", 1 / (F.col("m") - 1).cast("double"))).withColumnRenamed("total", "o")
    everything = counts.groupBy("x").agg(F.sum("c").alias("c")).select(F.lit(0).alias("unit_id"), "x", "c", F.lit(1.0).alias("weight"))
    expected = _spread(everything).withColumnRenamed("total", "e")
    sums = units.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count("*").alias("k")).crossJoin(observed).crossJoin(expected).crossJoin(held.agg(F.count_distinct("rater").alias("raters")))  # one row each
    e = F.col("e") / (F.col("n") * (F.col("n") - 1))
    alpha = F.when((F.col("raters") > 1) & (F.col("k") > 0) & (F.col("e") > 0), 1 - (F.col("o") / F.col("n")) / e).otherwise(F.lit(float("nan")))
    return sums.select(alpha.alias("alpha"), F.col("n").alias("n_ratings"), F.col("k").alias("n_units"))
