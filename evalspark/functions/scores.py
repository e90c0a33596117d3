"""Per-image score expressions: weighting, hard gates, the tri-state decision and normalisation.

Null means not measured and is never zero. NaN compares false, as in Python, and
is never clamped into a perfect score.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("identity", "clip_score", "aesthetic", "preference", "safety")
# The reject code of a failed hard gate by metric; any other metric gives "other".
REJECT_CODE = {"identity": "identity_mismatch", "clip_score": "prompt_mismatch", "aesthetic": "low_quality", "preference": "low_quality", "safety": "unsafe"}
REJECT_CODES = ("identity_mismatch", "prompt_mismatch", "low_quality", "anatomy", "artifact", "duplicate", "overfit", "unsafe", "other")


@dataclass(frozen=True)
class GateConfig:
    """Weights, decision bands, hard floors and the run's bar."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(METRICS, 1.0))
    auto_pass: float = 0.7
    auto_fail: float = 0.4
    hard_gates: Mapping[str, float] = field(default_factory=dict)
    run_pass_rate: float = 0.75

    def __post_init__(self):
        if self.auto_fail > self.auto_pass:
            raise ValueError("auto_fail must not exceed auto_pass")


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def below(value: Column, floor: float) -> Column:
    """Strictly below, false for null and NaN."""
    return is_true(~F.isnan(value) & (value < floor))


def at_least(value: Column, bar: float) -> Column:
    return is_true(~F.isnan(value) & (value >= bar))


def at_most(value: Column, bar: float) -> Column:
    return is_true(~F.isnan(value) & (value <= bar))


def composite(config: GateConfig) -> Column:
    """Weighted mean over the measured metrics; null when no weight is left. Unknown metrics are ignored."""
    used = [(m, w) for m, w in config.weights.items() if m in METRICS and w != 0]
    if not used:
        return F.lit(None).cast("double")
    top, bottom = F.lit(0.0), F.lit(0.0)
    for m, w in used:
        top = top + F.coalesce(F.col(m) * w, F.lit(0.0))
        bottom = bottom + F.when(F.col(m).isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.when(bottom != 0, top / bottom)


def hard_reasons(config: GateConfig) -> Column:
    """A reason for each measured metric under its floor."""
    from .text import fixed

    def reason(m: str, floor: float) -> Column:
        note = F.concat(F.lit(f"{m} "), fixed(F.col(m), 3), F.lit(f" < hard gate {floor:.3f}"))
        return F.when(below(F.col(m), floor), F.struct(F.lit(REJECT_CODE.get(m, "other")).alias("code"), F.lit(m).alias("metric"), note.alias("note")))

    found = [reason(m, floor) for m, floor in config.hard_gates.items() if m in METRICS]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<code:string,metric:string,note:string>>")


def notes(config: GateConfig) -> Column:
    """What the decision says of a failed image: a note for each broken gate, or that its composite is too low."""
    from .text import fixed

    passed, codes = decide(config)
    low = F.concat(F.lit("composite "), fixed(composite(config), 3), F.lit(f" <= auto_fail {config.auto_fail:.3f}"))
    hard = F.transform(hard_reasons(config), lambda r: r["note"])
    return F.when(F.size(hard) > 0, hard).when(~passed, F.array(low)).otherwise(F.array().cast("array<string>"))


def decide(config: GateConfig) -> tuple[Column, Column]:
    """The decision (true, false, or null for review) and the reject codes."""
    hard, score = hard_reasons(config), composite(config)
    codes = F.transform(hard, lambda r: r["code"])
    failed = F.size(hard) > 0
    low = ~failed & ~at_least(score, config.auto_pass) & at_most(score, config.auto_fail)
    passed = F.when(failed, F.lit(False)).when(at_least(score, config.auto_pass), F.lit(True)).when(low, F.lit(False))
    return passed, F.when(low, F.array(F.lit("low_quality"))).otherwise(codes)


def unit_range(x: Column) -> Column:
    """Into [0, 1]; null stays null, which ``least`` and ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null, NaN and infinities pass through."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(unit_range(x))


def linear_normalize(raw: Column, low: float, high: float) -> Column:
    """[low, high] to [0, 1]; an empty range is a step at low."""
    return F.when(raw >= low, 1.0).when(raw < low, 0.0) if high <= low else clamp01((raw - low) / (high - low))


def detector_score(x: Column) -> Column:
    """A detector's score in [0, 1]; a non-finite one counts as certain."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(unit_range(x))


def checked(metric: str) -> Column:
    """The metric, or an error if it is measured and not within [0, 1]."""
    x = F.col(metric)
    return F.when(x.isNotNull() & (F.isnan(x) | ~x.between(0.0, 1.0)), F.raise_error(F.lit(f"{metric} is out of range")).cast("double")).otherwise(x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 with a zero vector; an error for different lengths."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def unsafe(floor: float = 0.5) -> Column:
    """Safety under the floor, or a reason ``unsafe``."""
    return below(F.col("safety"), floor) | is_true(F.exists("reject_codes", lambda c: c == "unsafe"))


def verdict_label(passed: Column) -> Column:
    return F.when(passed, "passed").when(~passed, "failed").otherwise("needs_review")
