"""Grouping and variety of a run's images by a user's own function, in Arrow groups of a checked size."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import _always, is_available


@dataclass(frozen=True)
class Deduper:
    """Near-copies of a run; ``group(images)`` gives a label for each row, equal for images that count as one."""

    name: str
    group: Callable[[pd.DataFrame], Sequence[int]]
    version: str | None = None
    model: str | None = None
    probe: Callable[[], bool] = _always
    metric: str = "duplicate_group"


@dataclass(frozen=True)
class DiversityScorer:
    """Variety of a run; ``score(images)`` lies in [0, 1], or is None where it can't be told."""

    name: str
    score: Callable[[pd.DataFrame], float | None]
    version: str | None = None
    model: str | None = None
    probe: Callable[[], bool] = _always
    metric: str = "diversity"


def _within(images: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The images, or an error where more than ``most`` have the same keys; it is raised before any are gathered."""
    counts = images.groupBy(*keys).agg(F.count("*").alias("_n"))
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    checked: Column = F.when(F.col("_n") > most, F.raise_error(F.concat(F.lit(f"more than {most} images in one group: "), name)).cast("boolean")).otherwise(F.lit(True))
    return images.join(counts, keys).where(checked).drop("_n")


def group_images(images: DataFrame, deduper: Deduper | None, run: str = "run_id", order: str = "ordinal", split: str | None = None, most: int = 100_000) -> DataFrame:
    """``run, ordinal, duplicate_group``: the deduper's label of every image; without an available one each is a group of its own.

    The function gets all columns of one run's images, in order, and must give as
    many labels. A run of more than ``most`` images is refused, unless a column
    ``split`` parts it into groups that are labelled apart; an image is then
    labelled by the first of its group.
    """
    if deduper is None or not is_available(deduper):
        return images.select(run, order, F.col(order).cast("long").alias("duplicate_group"))
    keys = [run] if split is None else [run, split]
    call, name = deduper.group, deduper.name

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        labels = list(call(rows))
        if len(labels) != len(rows):
            raise ValueError(f"{name} gave {len(labels)} labels for {len(rows)} images")
        out = rows[[run, order]].assign(duplicate_group=labels)
        if split is not None:
            out["duplicate_group"] = out.groupby("duplicate_group")[order].transform("min")
        return out

    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    return _within(images, keys, most).groupBy(*keys).applyInPandas(label, f"{run} {kinds[run]}, {order} {kinds[order]}, duplicate_group long")


def score_diversity(images: DataFrame, scorer: DiversityScorer | None, run: str = "run_id", order: str = "ordinal", most: int = 100_000) -> DataFrame:
    """``run, diversity`` of every run: the scorer's value, null without an available one; an error outside [0, 1] and for runs of more than ``most`` images."""
    if scorer is None or not is_available(scorer):
        return images.select(run).distinct().withColumn("diversity", F.lit(None).cast("double"))
    call, name = scorer.score, scorer.name

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        value = call(rows.sort_values(order, ignore_index=True))
        if value is not None and not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} gave {value}, which is not within [0, 1]")
        return rows[[run]].head(1).assign(diversity=None if value is None else float(value))

    kind = images.schema[run].dataType.simpleString()
    return _within(images, [run], most).groupBy(run).applyInPandas(score, f"{run} {kind}, diversity double")
