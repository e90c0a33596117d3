"""Policy detectors: ensembles, tails by category, and a keyword detector for texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import detector_score
from .components import checkpointed
from .order_stats import percentiles

# The policy categories in order, the taxonomy's name, and hazard codes.
CATEGORIES = ("sexual", "violence", "hate", "self_harm", "weapons", "illegal")
TAXONOMY = "proof-policy-1"
HAZARDS = {"S1": "violence", "S2": "illegal", "S3": "sexual", "S9": "weapons", "S10": "hate", "S11": "self_harm", "S12": "sexual"}


def combine(scores: DataFrame) -> DataFrame:
    """``item_id, detector, category, score`` -> the highest score of each item and category."""
    return scores.where("score is not null").groupBy("item_id", "category").agg(F.max(detector_score(F.col("score").cast("double"))).alias("score"))


def tails(items: DataFrame, combined: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every category over all items: a missing score is 0.0; a hit is at or above the threshold."""
    grid = items.select("item_id").withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])))
    full = checkpointed(grid.join(combined, ["item_id", "category"], "left").select("category", F.coalesce("score", F.lit(0.0)).alias("score")))
    hit = F.count_if(F.col("score") >= threshold)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    counted = full.groupBy("category").agg((hit > 0).alias("any_hit"), (hit / F.count("*")).alias("hit_rate"), F.max("score").alias("max_score"))
    return counted.join(percentiles(full, ["category"], "score", [0.95], ["p95"]), "category").withColumn("category_order", order[F.col("category")])


def flagged(tail: DataFrame, floor: float = 0.0) -> DataFrame:
    """Categories hit more often than the floor, worst first, ties in taxonomy order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("max_score"), "category_order"))  # six rows at most
    return tail.where(F.col("hit_rate") > floor).select("category", "hit_rate", "max_score", place.alias("rank"))


def hazard_scores(found: DataFrame) -> DataFrame:
    """``item_id, code, confidence`` -> scores by category; codes without a category go."""
    table = F.create_map(*[F.lit(x) for pair in HAZARDS.items() for x in pair])
    return found.withColumn("category", table[F.col("code")]).where("category is not null").groupBy("item_id", "category").agg(F.max("confidence").alias("score"))


def keyword_scores(texts: DataFrame, words: Mapping[str, tuple[str, ...]], detector: str = "keywords") -> DataFrame:
    """``item_id, text`` -> a score of 1.0 for each category of which a word occurs."""
    found = [F.when(F.lower("text").rlike(rf"\b({'|'.join(ws)})\b"), F.lit(c)) for c, ws in words.items()]
    return texts.select("item_id", F.explode(F.array_compact(F.array(*found))).alias("category")).select("item_id", F.lit(detector).alias("detector"), "category", F.lit(1.0).alias("score"))


def moderate(items: DataFrame, scores: DataFrame, side: str, detectors: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """The report of one side: tails with its provenance; an error without detectors."""
    if not detectors:
        raise ValueError(f"no detector is available for {side}")
    n = items.agg(F.count("*").alias("n_items"))  # one row
    return tails(items, combine(scores), threshold).crossJoin(F.broadcast(n)).withColumns({"side": F.lit(side), "taxonomy": F.lit(TAXONOMY), "detectors": F.lit("+".join(detectors)), "threshold": F.lit(threshold)})
