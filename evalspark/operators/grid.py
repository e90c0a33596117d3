"""Prompt grids and experiment cells: sizes by arithmetic first, rows only afterwards."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell_id, labels_json, not_blank, run_id, strip
from .numbering import numbered


def base_prompts(prompts: DataFrame, most: int | None = None) -> DataFrame:
    """``pos, prompt``: stripped, blanks out, each once at its first place, the first ``most``; ``item`` from 0."""
    kept = prompts.where(not_blank(F.col("prompt"))).groupBy(strip(F.col("prompt")).alias("prompt")).agg(F.min("pos").alias("pos"))
    if most is not None:
        kept = kept.orderBy("pos").limit(most)
    return numbered(kept, "item", "pos")


def combo_count(axes: Mapping[str, Sequence[str]], cap: int | None = None) -> int:
    n = 1
    for values in axes.values():
        n *= len(values) or 1
    return min(n, cap) if cap is not None else n


def token_combos(spark: SparkSession, axes: Mapping[str, Sequence[str]], cap: int | None = None, seed: int = 0) -> DataFrame:
    """``combo_pos, combo``: one value of each axis by sorted axis name, the last fastest, joined by ', '.

    Rows are decoded from their number; a cap draws numbers on the driver, and the drawn combos are ordered by text.
    """
    names = [k for k in sorted(axes) if axes[k]]
    total = combo_count({k: axes[k] for k in names})
    capped = cap is not None and total > cap
    rows = spark.createDataFrame([(n,) for n in random.Random(seed).sample(range(total), cap)], "id long") if capped else spark.range(total)
    parts, size = [], total
    for k in names:
        size //= len(axes[k])
        parts.append(F.element_at(F.array(*[F.lit(v) for v in axes[k]]), (F.floor(F.col("id") / size) % len(axes[k]) + 1).cast("int")))
    text = F.concat_ws(", ", *parts) if parts else F.lit("")
    if capped:
        return numbered(rows.select(text.alias("combo"), "id"), "combo_pos", "combo", "id").select("combo_pos", "combo")
    return rows.select(F.col("id").alias("combo_pos"), text.alias("combo"))


def prompt_items(bases: DataFrame, combos: DataFrame, flexibility: DataFrame | None = None) -> DataFrame:
    """``item, prompt, kind``: every base with every combo, then flexibility prompts as they are. Items count over both."""
    joined = F.when(F.col("combo") == "", F.col("prompt")).otherwise(F.concat_ws(", ", "prompt", "combo"))
    n = combos.count()
    # Every base takes the same number of items, so a number needs no sorting of the product.
    made = bases.crossJoin(combos).select((F.col("item") * n + F.col("combo_pos")).alias("item"), F.lit("p").alias("kind"), joined.alias("prompt"))
    if flexibility is not None:
        after = bases.count() * n
        rest = numbered(flexibility.where(not_blank(F.col("prompt"))).select("pos", strip(F.col("prompt")).alias("prompt")), "item", "pos")
        made = made.unionByName(rest.select((F.col("item") + after).alias("item"), F.lit("f").alias("kind"), "prompt"))
    return made


def expand(items: DataFrame, loras: DataFrame, weights: DataFrame, prefix: str) -> DataFrame:
    """One run for each checkpoint, weight and prompt. ``loras(lora_pos, lora)``, ``weights(weight_pos, weight)``."""
    runs = items.crossJoin(loras).crossJoin(weights)
    args = (F.lit(prefix), F.col("lora_pos").cast("int"), F.col("weight_pos").cast("int"), F.col("item").cast("int"))
    return runs.withColumn("run_id", F.when(F.col("kind") == "f", run_id(*args, kind="f")).otherwise(run_id(*args)))


@dataclass(frozen=True)
class Estimate:
    runs: int
    images: int
    gpu_seconds: float

    @property
    def gpu_hours(self) -> float:
        return self.gpu_seconds / 3600


def estimate(loras: int, weights: int, prompts: int, seeds: int, seconds_per_image: float = 6.0) -> Estimate:
    runs = loras * weights * prompts
    return Estimate(runs, runs * seeds, runs * seeds * seconds_per_image)


def experiment_cells(bases: DataFrame, steps: DataFrame, images_per_cell: int, prefix: str = "exp", seconds_per_image: float = 6.0) -> DataFrame:
    """``cell_id, base, step, n_images, gpu_seconds``: bases outside, steps inside; a step's own rate overrides the matrix rate.

    ``bases(base_pos, base)``, ``steps(step_pos, step, seconds)``.
    """
    cells = bases.crossJoin(steps)
    index = (F.col("base_pos") * steps.count() + F.col("step_pos")).cast("int")
    return cells.select(
        cell_id(F.lit(prefix), index, F.col("base"), F.col("step")).alias("cell_id"), "base", "step", F.lit(images_per_cell).cast("long").alias("n_images"),
        (F.coalesce("seconds", F.lit(seconds_per_image)) * images_per_cell).alias("gpu_seconds"),
    )


def plan(bases: DataFrame, combos: DataFrame, loras: DataFrame, weights: DataFrame, prefix: str, flexibility: DataFrame | None = None) -> DataFrame:
    """The runs of one grid: prompts, then every checkpoint and weight with each of them."""
    return expand(prompt_items(bases, combos, flexibility), loras, weights, prefix)


def plan_from_export(prompts: DataFrame, axes: Mapping[str, Sequence[str]], loras: DataFrame, weights: DataFrame, prefix: str, most: int | None = None, cap: int | None = None, seed: int = 0) -> DataFrame:
    """A grid over the prompts of an export, as ``sources.files.export_prompts`` reads them."""
    return plan(base_prompts(prompts, most), token_combos(prompts.sparkSession, axes, cap, seed), loras, weights, prefix)


def experiment_runs(cells: DataFrame, items: DataFrame, loras: DataFrame, weights: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The inner grid of every cell: the cell's id is the prefix of its runs, which carry its arm and labels."""
    runs = cells.select("cell_id", F.col("base").alias("base_checkpoint"), F.col("step").alias("step_config")).crossJoin(items).crossJoin(loras).crossJoin(weights)
    args = (F.col("cell_id"), F.col("lora_pos").cast("int"), F.col("weight_pos").cast("int"), F.col("item").cast("int"))
    said = F.map_from_arrays(F.array(*[F.lit(k) for k in (*(labels or {}), "step_config")]), F.array(*[F.lit(v) for v in (labels or {}).values()], F.col("step_config")))
    return runs.withColumns({"run_id": F.when(F.col("kind") == "f", run_id(*args, kind="f")).otherwise(run_id(*args)), "labels": labels_json(said)})


def images_per_cell(runs: DataFrame, seeds: int) -> DataFrame:
    """``per_cell``: one map from cell to its number of images."""
    counted = runs.groupBy("cell_id").agg((F.count("*") * seeds).alias("n"))
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_id", "n")))).alias("per_cell"))


def preview(bases: DataFrame, n: int = 5) -> DataFrame:
    """The first prompts of a plan."""
    return bases.orderBy("item").limit(n)


def within_budget(gpu_hours: float, most: float | None) -> None:
    """Refuses a plan that costs more than its budget; equal is fine."""
    if most is not None and gpu_hours > most:
        raise ValueError(f"{gpu_hours:.2f} GPU-hours exceed the budget of {most:.2f}")


def search(space: Mapping[str, Sequence], objective: Callable[[dict], float], trials: int, maximize: bool = True, seed: int = 0) -> dict:
    """Best of seeded random trials over a finite space; all of it when that is no more than ``trials``."""
    names, total = sorted(space), combo_count(space)
    numbers = range(total) if total <= trials else sorted(random.Random(seed).sample(range(total), trials))
    tried = []
    for n in numbers:
        params, rest = {}, n
        for k in reversed(names):
            rest, at = divmod(rest, len(space[k]))
            params[k] = space[k][at]
        tried.append((float(objective(params)), params))
    best = (max if maximize else min)(tried, key=lambda t: t[0])
    return {"best_params": best[1], "best_value": best[0], "n_trials": len(tried)}
