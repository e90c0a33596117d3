"""Review tables for dataset viewers: sample fields, tags, and decisions read back from tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import METRICS, verdict_label
from ..functions.text import rating_of, rejects_of


def sample_fields(images: DataFrame) -> DataFrame:
    """``image_id, fields``: JSON of what is known of an image; nulls are left out."""
    held = [c for c in (*METRICS, "composite", "duplicate_group", "hitl_rating", "notes") if c in images.columns]
    parts = [F.col(c) for c in held] + ([F.col("rank").alias("refined_rank")] if "rank" in images.columns else [])
    codes = [F.when(F.size("reject_codes") > 0, F.col("reject_codes")).alias("reject_codes")] if "reject_codes" in images.columns else []
    return images.select("image_id", F.to_json(F.struct(verdict_label(F.col("passed")).alias("verdict"), *parts, *codes)).alias("fields"))


def sample_tags(images: DataFrame) -> DataFrame:
    """``image_id, tags``: the verdict, and ``refined`` for images with a second look."""
    refined = F.when(F.col("rank").isNotNull(), F.lit("refined")) if "rank" in images.columns else F.lit(None).cast("string")
    return images.select("image_id", F.array_compact(F.array(verdict_label(F.col("passed")), refined)).alias("tags"))


def updates_from_tags(tagged: DataFrame, images: DataFrame) -> DataFrame:
    """Review updates of known images whose tags hold a rating or a reject: ``run_id, image_id, hitl_rating, reject_codes``."""
    read = tagged.select("image_id", rating_of(F.col("tags")).alias("hitl_rating"), rejects_of(F.col("tags")).alias("reject_codes"))
    decided = read.where(F.col("hitl_rating").isNotNull() | (F.size("reject_codes") > 0))
    return decided.join(images.select("run_id", "image_id"), "image_id").select("run_id", "image_id", "hitl_rating", "reject_codes")


def with_paths(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Images whose file was found, by the name without its ending: ``paths(stem, path)``."""
    return images.join(paths.withColumnRenamed("stem", "image_id"), "image_id")
