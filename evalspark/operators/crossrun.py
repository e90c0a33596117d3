"""Runs pooled over time: the store's rows, latest-wins appends, and pass rates by factor."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..functions.text import fixed, label_of, lora_key, python_float
from .numbering import numbered

# The columns that pass rates may be sliced by, besides ``label:<key>``.
DIMENSIONS = ("base_checkpoint", "lora", "lora_weight", "prompt", "training_run_id", "step_config")
LABEL = re.compile(r"label:([A-Za-z0-9_-]+)")


def check_dimension(dimension: str) -> str | None:
    """The label key, or None for a column; an error for anything else, before any data is read."""
    if dimension in DIMENSIONS:
        return None
    if found := LABEL.fullmatch(dimension):
        return found[1]
    raise ValueError(f"cannot slice by {dimension!r}")


def run_stats(manifests: DataFrame, rolled: DataFrame, tails: DataFrame | None = None, confidence: float = 0.95) -> DataFrame:
    """One row per run, in the store's columns: manifest identity, counts, interval, diversity, scorers and, where safety was measured, its tail.

    ``rolled`` may hold ``diversity``, ``proof_version`` and ``scorers
    array<struct<name,version>>`` of the report; what it lacks is null. Only a
    single LoRA has a digest and a weight; several are one key of their own.
    """
    single = F.size("loras") == 1
    rows = rolled.join(manifests.drop(*[c for c in ("diversity", "proof_version", "scorers") if c in rolled.columns]), "run_id")
    if tails is not None:
        rows = rows.join(tails, "run_id", "left")
        measured = F.col("mean_safety").isNotNull()
        safety = [F.when(measured, F.col("safety_min")).alias("safety_min"), F.when(measured, F.col("hit_rate")).alias("safety_hit_rate")]
    else:
        safety = [F.lit(None).cast("double").alias("safety_min"), F.lit(None).cast("double").alias("safety_hit_rate")]
    n = F.coalesce("n_groups", "n_images")
    k = F.least("n_passed", n)
    low, high = wilson(k, n, confidence)
    weight = F.when(single, fixed(F.col("loras")[0]["weight"], 4).cast("double"))

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in rolled.columns else F.lit(None).cast(kind)

    named = F.transform(given("scorers", "array<struct<name:string,version:string>>"), lambda s: F.concat(s["name"], F.when(F.coalesce(s["version"], F.lit("")) != "", F.concat(F.lit("@"), s["version"])).otherwise("")))
    return rows.select(
        "run_id", "training_run_id", F.col("base_checkpoint.name").alias("base_checkpoint"), F.col("base_checkpoint.sha256").alias("base_checkpoint_sha"), lora_key(F.col("loras")).alias("lora"),
        F.when(single, F.col("loras")[0]["sha256"]).alias("lora_sha"), weight.alias("lora_weight"), "prompt", "n_images", n.alias("n_groups"), k.alias("n_passed"), "n_needs_hitl", "pass_rate",
        low.alias("pass_rate_ci_low"), high.alias("pass_rate_ci_high"),
        given("diversity", "double").alias("diversity"), *safety, F.coalesce(given("proof_version", "string"), F.lit("")).alias("proof_version"), F.nullif(F.array_join(named, ","), F.lit("")).alias("scorers"), "created_at", "step_config", "labels",
    )


def latest(rows: DataFrame, *version: str) -> DataFrame:
    """The row of each run with the highest version columns."""
    picked = rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("r"))
    return picked.select("r.*")


def append(store: DataFrame, batch: DataFrame, number: int) -> DataFrame:
    """The store with a batch whose rows replace earlier ones; within it the later ``ord`` wins. Missing columns are null."""
    old = store if "batch" in store.columns else store.withColumns({"batch": F.lit(0).cast("long"), "ord": F.lit(0).cast("long")})
    new = batch if "ord" in batch.columns else batch.withColumn("ord", F.lit(0).cast("long"))
    return latest(old.unionByName(new.withColumn("batch", F.lit(number).cast("long")), allowMissingColumns=True), "batch", "ord")


def slice_value(store: DataFrame, dimension: str) -> Column:
    key = check_dimension(dimension)
    if key is not None:
        if "labels" not in store.columns:
            raise ValueError("the store has no labels: it was written by an older build")
        return label_of(F.col("labels"), key)
    if dimension not in store.columns:
        raise ValueError(f"the store has no {dimension}: it was written by an older build")
    return F.col(dimension)


def slice_pass_rate(store: DataFrame, dimension: str, confidence: float = 0.95) -> DataFrame:
    """Runs pooled by a factor; null is a cell of its own. ``place`` ranks by interval's lower end, then rate, then value.

    ``value`` keeps the factor's type; ``text`` is the same as the reports write it.
    """
    value = slice_value(store, dimension)
    cells = store.groupBy(value.alias("value")).agg(F.count("*").alias("n_runs"), F.sum("n_groups").alias("n_groups"), F.sum("n_passed").alias("n_passed"))
    k = F.greatest(F.lit(0), F.least("n_passed", "n_groups"))
    low, high = wilson(k, F.col("n_groups"), confidence)
    out = cells.withColumns({"pass_rate": F.when(F.col("n_groups") > 0, F.col("n_passed") / F.col("n_groups")).otherwise(0.0), "ci_low": low, "ci_high": high})
    ranked = numbered(out, "place", *_best_first())
    written = python_float(F.col("value")) if dict(out.dtypes)["value"] in ("double", "float") else F.col("value").cast("string")
    return ranked.withColumns({"place": (F.col("place") + 1).cast("int"), "dimension": F.lit(dimension), "text": written})


def _best_first() -> list[Column]:
    return [F.desc("ci_low"), F.desc("pass_rate"), F.asc_nulls_first("value")]


def clear_winner(sliced: DataFrame) -> DataFrame:
    """The first cell, if its interval lies above the second's; null cells do not compete."""
    two = sliced.where("value is not null").orderBy("place").limit(2)
    pair = two.agg(F.min_by(F.struct(*sliced.columns), "place").alias("best"), F.max("place").alias("last"), F.max_by("ci_high", "place").alias("next_high"))
    return pair.where("last > best.place and best.ci_low > next_high").select("best.*")
