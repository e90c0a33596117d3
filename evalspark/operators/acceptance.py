"""Acceptance checks of runs and routed recommendations, as rule tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import unsafe
from ..functions.stats import wilson
from ..functions.text import fixed, quoted
from .crossrun import clear_winner, slice_pass_rate


def unsafe_rate(gated: DataFrame, floor: float = 0.5) -> DataFrame:
    """Unsafe images over all images of each run, measured or not."""
    return gated.groupBy("run_id").agg((F.count_if(unsafe(floor)) / F.count("*")).alias("unsafe_rate"))


@dataclass(frozen=True)
class Thresholds:
    min_pass_rate: float | None = 0.75
    min_pass_rate_ci_lower: float | None = None
    min_identity: float | None = None
    max_unsafe_rate: float | None = None
    confidence: float = 0.95


def acceptance(runs: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """``run_id, ord, name, actual, threshold, passed, detail`` for each configured check, in order.

    A check of a metric that was not measured fails. Nothing configured rejects
    each run with the one row ``no_checks``. ``runs`` has the roll-up's columns
    and ``unsafe_rate`` (null: no images, counted as 0).
    """
    t = t or Thresholds()
    n = F.coalesce("n_groups", "n_images")
    low, _ = wilson(F.least("n_passed", n), n, t.confidence)

    def row(ord_: int, name: str, actual: Column, bar: float, ok: Column, text: str, signs: tuple[str, str] = (">=", "<"), middle: Column | str = "") -> Column:
        sound = F.coalesce(ok & ~F.isnan(actual), F.lit(False))
        middle = F.lit(middle) if isinstance(middle, str) else middle
        said = F.concat(F.lit(f"{text} "), fixed(actual, 3), middle, F.when(sound, f" {signs[0]} ").otherwise(f" {signs[1]} "), F.lit(f"{bar:.3f}"))
        detail = F.when(actual.isNull(), F.lit(f"{name.removesuffix('_mean')} not measured")).otherwise(said)
        return F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("name"), actual.cast("double").alias("actual"), F.lit(float(bar)).alias("threshold"), sound.alias("passed"), detail.alias("detail"))

    rows = []
    if t.min_pass_rate is not None:
        rows.append(row(1, "pass_rate", F.col("pass_rate"), t.min_pass_rate, F.col("pass_rate") >= t.min_pass_rate, "pass_rate"))
    if t.min_pass_rate_ci_lower is not None:
        rows.append(row(2, "pass_rate_ci_lower", low, t.min_pass_rate_ci_lower, low >= t.min_pass_rate_ci_lower, f"{t.confidence:.0%} Wilson lower bound", middle=F.format_string(" (%d/%d)", F.least("n_passed", n), n)))
    if t.min_identity is not None:
        rows.append(row(3, "identity_mean", F.col("mean_identity"), t.min_identity, F.col("mean_identity") >= t.min_identity, "identity mean"))
    if t.max_unsafe_rate is not None:
        rate = F.coalesce("unsafe_rate", F.lit(0.0))
        rows.append(row(4, "unsafe_rate", rate, t.max_unsafe_rate, rate <= t.max_unsafe_rate, "unsafe rate", ("<=", ">")))
    if not rows:
        none = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(0).alias("ord"), F.lit("no_checks").alias("name"), none.alias("actual"), none.alias("threshold"), F.lit(False).alias("passed"), F.lit("no acceptance thresholds configured").alias("detail")))
    return runs.select("run_id", F.explode(F.array(*rows)).alias("c")).select("run_id", "c.*")


def accepted(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id").agg(F.every("passed").alias("accepted"), F.count("*").alias("n_checks"))


@dataclass(frozen=True)
class Floors:
    """Bounds of the recommendation rules; None switches one off."""

    max_unsafe_rate: float | None = 0.0
    min_safety: float | None = 0.5
    min_identity: float | None = 0.6
    min_clip_score: float | None = 0.5
    min_aesthetic: float | None = 0.5
    min_preference: float | None = None
    min_diversity: float | None = 0.3


# What a rule says is wrong, and what to do, by stage and metric.
ADVICE = {
    ("lens", "unsafe_rate"): ("unsafe outputs", "filter/re-caption training data to remove unsafe content"),
    ("lens", "safety"): ("unsafe outputs", "filter/re-caption training data to remove unsafe content"),
    ("forge", "identity"): ("identity didn't transfer", "add/curate more identity-representative training images, or adjust training steps/rank"),
    ("lens", "clip_score"): ("prompt adherence low", "outputs drift from the prompt — revisit the captioning strategy (more descriptive captions)"),
    ("grid", "clip_score"): ("prompt adherence low", "try different prompt / token combinations in the grid"),
    ("forge", "aesthetic"): ("technical/aesthetic quality low", "revisit training config (learning rate / steps) or the base checkpoint"),
    ("forge", "preference"): ("human-preference proxy low", "the LoRA's outputs are under-preferred — revisit training data quality / config"),
    ("grid", "diversity"): ("low output diversity", "widen the token/prompt axes; if the LoRA reproduces training data, reduce training (overfit)"),
    ("refine", "pass_rate"): ("borderline results awaiting review", "run a HITL review on the needs-review band before deciding"),
}
# The factors in which a clear winner is recommended, and their stages.
FACTORS = (("base_checkpoint", "checkpoint"), ("lora_weight", "weight"))


def recommend_from_store(store: DataFrame) -> DataFrame:
    """``ord, stage, issue, action, metric, value, threshold``: the checkpoint and the weight whose interval lies above all others, if any does."""
    out = None
    for ord_, (dimension, stage) in enumerate(FACTORS, 8):
        best = clear_winner(slice_pass_rate(store, dimension))
        action = F.concat(F.lit(f"prefer {dimension}="), quoted(F.col("text")), F.lit(" (highest evidence-adjusted pass-rate, lower bound "), fixed(F.col("ci_low"), 2), F.lit(")"))
        row = best.select(
            F.lit(ord_).alias("ord"), F.lit(stage).alias("stage"), F.lit(f"{dimension} outcome varies across runs").alias("issue"), action.alias("action"),
            F.lit("pass_rate").alias("metric"), F.col("pass_rate").alias("value"), F.lit(None).cast("double").alias("threshold"),
        )
        out = row if out is None else out.unionByName(row)
    return out


#: A rule fires for a run whose ``measure`` lies ``below`` or ``above`` the bound, or ``holds``; NaN fires too. ``shown`` is
#: the measure that is reported, under the name ``metric``. A rule with ``unless`` fires only where that measure is missing.
RULE = "ord int, stage string, metric string, measure string, direction string, bound double, shown string, unless string, issue string, action string"


def default_rules(spark: SparkSession, floors: Floors | None = None) -> DataFrame:
    """The rules as rows; those without a bound are left out."""
    f = floors or Floors()
    low = lambda ord_, stage, metric, bound, measure="", unless=None: (ord_, stage, metric, measure or f"mean_{metric}", "below", bound, measure or f"mean_{metric}", unless)
    rules = [
        (0, "lens", "unsafe_rate", "unsafe_rate", "above", f.max_unsafe_rate, "unsafe_rate", None), low(0, "lens", "safety", None if f.max_unsafe_rate is None else f.min_safety, unless="unsafe_rate"),
        low(1, "forge", "identity", f.min_identity), low(2, "lens", "clip_score", f.min_clip_score), low(3, "grid", "clip_score", f.min_clip_score), low(4, "forge", "aesthetic", f.min_aesthetic),
        low(5, "forge", "preference", f.min_preference), low(6, "grid", "diversity", f.min_diversity, "diversity"), (7, "refine", "pass_rate", "pending", "holds", None, "pass_rate", None),
    ]
    return spark.createDataFrame([(*r, *ADVICE[r[1], r[2]]) for r in rules if r[5] is not None or r[4] == "holds"], RULE)


def recommend_by(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """``run_id, ord, stage, metric, value, issue, action, threshold`` of the rules that fire.

    ``rules`` has the columns of RULE. All numbers and truth values of ``runs``
    are measures; a rule about one that is not there, or not measured, does not fire.
    """
    numbers = [c for c, kind in runs.dtypes if c != "run_id" and (kind in ("double", "float", "bigint", "int", "smallint", "boolean") or kind.startswith("decimal"))]
    held = F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]), F.array(*[F.col(c).cast("double") for c in numbers]))
    # Rules are few: they go to the runs, which are not shuffled again.
    rows = runs.select("run_id", held.alias("all")).crossJoin(F.broadcast(rules))
    x, bound = F.try_element_at("all", F.col("measure")), F.col("bound")
    fires = F.when(F.col("direction") == "below", F.isnan(x) | (x < bound)).when(F.col("direction") == "above", x > bound).when(F.col("direction") == "holds", x == 1.0)
    spared = F.try_element_at("all", F.col("unless")).isNotNull()
    fired = rows.where(x.isNotNull() & fires & ~spared)
    return fired.select("run_id", "ord", "stage", "metric", F.try_element_at("all", F.col("shown")).alias("value"), "issue", "action", bound.alias("threshold"))


def recommend(runs: DataFrame, floors: Floors | None = None) -> DataFrame:
    """The recommendations of the default rules. A metric that was not measured fires none; NaN does."""
    return recommend_by(runs, default_rules(runs.sparkSession, floors))
