"""Composed plans: from scored images to verdicts, and from runs to the cross-run store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import METRICS, GateConfig, checked
from ..functions.stats import wilson
from ..operators.rollup import gate, roll_up, verdicts
from ..operators.similarity import diversity, group_labels


def evaluate(images: DataFrame, config: GateConfig | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Run verdicts of images whose metrics must lie within [0, 1].

    With ``hashes(run_id, ordinal, hash)``, images carry ``ordinal`` and are
    grouped by near hashes; diversity comes from the same hashes.
    """
    config = config or GateConfig()
    rows = images.withColumns({m: checked(m) for m in METRICS})
    if hashes is not None:
        rows = rows.drop("duplicate_group").join(group_labels(hashes), ["run_id", "ordinal"], "left")
    gated = gate(rows, config)
    out = verdicts(roll_up(gated), config.run_pass_rate)
    spread = diversity(hashes).select("run_id", "diversity") if hashes is not None else None
    out = out.join(spread, "run_id", "left") if spread is not None else out.withColumn("diversity", F.lit(None).cast("double"))
    low, high = wilson(F.col("n_passed"), F.col("n_groups"))
    return out.withColumns({"ci_low": low, "ci_high": high})
