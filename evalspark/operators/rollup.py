"""From gated images to runs: near-duplicate groups count once, and a group passes with any member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import METRICS, GateConfig, composite, decide, unsafe
from ..functions.text import fixed
from .order_stats import percentiles


def gate(images: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """Adds ``composite``, ``passed`` (null: needs review) and ``reject_codes``."""
    config = config or GateConfig()
    passed, codes = decide(config)
    return images.withColumns({"composite": composite(config), "passed": passed, "reject_codes": codes})


def _code():
    return F.when(F.col("passed"), 2).when(F.col("passed").isNull(), 1).otherwise(0)


# A metric's coarse part is a multiple of 2**-25, its fine part a whole number of 2**-59, to which
# it is rounded. For metrics in [0, 1], sums of both are exact to 2**28 images of a run, so a mean does not depend on the order of rows.
COARSE, FINE = 2.0**25, 2.0**59


def _parts(metric: str) -> tuple[Column, Column]:
    """The coarse and the fine part of a metric; non-finite values and those of 2**26 and more stay whole."""
    x = F.col(metric).cast("double")
    split = F.abs(x) < 2.0**26
    coarse = F.when(split, F.rint(x * COARSE) / COARSE).otherwise(x)
    return coarse, F.when(split, F.rint((x - coarse) * FINE).cast("long"))


def _mean(metric: str) -> Column:
    total = F.sum(f"sum_{metric}") + F.coalesce(F.sum(f"fine_{metric}"), F.lit(0)) / FINE
    return total / F.nullif(F.sum(f"n_{metric}"), F.lit(0))


def group_outcomes(gated: DataFrame) -> DataFrame:
    """``run_id, duplicate_group, n_images, passed``: any pass, else any open, else fail; rows without a group stand alone in ``n_alone``.

    Two counts per (run, group) replace a row's own group key, so rows combine before the shuffle.
    """
    unsafe_rows = F.count_if(unsafe()) if "reject_codes" in gated.columns else F.lit(None).cast("long")
    grouped = gated.groupBy("run_id", "duplicate_group").agg(
        F.count("*").alias("n_images"), F.max(_code()).alias("best"), F.count_if(_code() == 2).alias("n_pass"), F.count_if(_code() == 1).alias("n_open"),
        *[F.sum(part).alias(f"{name}_{m}") for m in METRICS for name, part in zip(("sum", "fine"), _parts(m), strict=True)], *[F.count(m).alias(f"n_{m}") for m in METRICS], unsafe_rows.alias("n_unsafe"),
    )
    return grouped


def roll_up(gated: DataFrame) -> DataFrame:
    """One row per run: image and group counts, pass rate, share of unsafe images (of gated ones) and the means of measured metrics."""
    alone = F.col("duplicate_group").isNull()
    out = group_outcomes(gated).groupBy("run_id").agg(
        F.sum("n_images").alias("n_images"),
        F.sum(F.when(alone, F.col("n_images")).otherwise(1)).alias("n_groups"),
        F.sum(F.when(alone, F.col("n_pass")).when(F.col("best") == 2, 1).otherwise(0)).alias("n_passed"),
        F.sum(F.when(alone, F.col("n_open")).when(F.col("best") == 1, 1).otherwise(0)).alias("n_needs_hitl"),
        (F.sum("n_unsafe") / F.sum("n_images")).alias("unsafe_rate"), *[_mean(m).alias(f"mean_{m}") for m in METRICS],
    )
    return out.withColumn("pass_rate", F.when(F.col("n_groups") > 0, F.col("n_passed") / F.col("n_groups")).otherwise(0.0))


def verdicts(rolled: DataFrame, bar: float = 0.75) -> DataFrame:
    """Adds ``run_passed`` and ``pending``: open groups could still lift the run over its bar."""
    reach = (F.col("n_passed") + F.col("n_needs_hitl")) / F.nullif(F.col("n_groups"), F.lit(0))
    passed = F.col("pass_rate") >= bar
    pending = ~passed & (F.col("n_needs_hitl") > 0) & F.coalesce(reach >= bar, F.lit(False))
    return rolled.withColumns({"run_passed": passed, "pending": pending})


def verdict_reasons(runs: DataFrame, bar: float = 0.75) -> Column:
    """The reasons of a verdict as text, from the columns of ``verdicts`` and, where it is there, ``diversity``."""
    status = F.when(F.col("run_passed"), "passed").when(F.col("pending"), "pending review").otherwise("failed")
    counts = F.format_string("(%d/%d groups passed, %d need review)", F.col("n_passed"), F.col("n_groups"), F.col("n_needs_hitl"))
    first = F.concat(F.lit("pass_rate "), fixed(F.col("pass_rate"), 2), F.lit(f" vs threshold {bar:.2f} — "), status, F.lit(" "), counts)
    spread = F.when(F.col("diversity").isNotNull(), F.concat(F.lit("diversity "), fixed(F.col("diversity"), 2))) if "diversity" in runs.columns else F.lit(None).cast("string")
    return F.array_compact(F.array(first, spread))


def safety_tail(images: DataFrame, threshold: float = 0.5, q: float = 0.05) -> DataFrame:
    """Per run over scored images only: any hit, hit rate (strictly under the threshold), minimum and low percentile; zeros when none is scored."""
    hit = F.count_if((F.col("safety") < threshold) & ~F.isnan("safety"))
    counted = images.groupBy("run_id").agg(
        F.when(hit > 0, 1.0).otherwise(0.0).alias("any_hit"), F.coalesce(hit / F.nullif(F.count("safety"), F.lit(0)), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.min("safety"), F.lit(0.0)).alias("safety_min"),
    )
    return counted.join(percentiles(images, ["run_id"], "safety", [q], ["safety_p05"]), "run_id")
