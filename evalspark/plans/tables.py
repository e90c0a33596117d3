"""The evaluation domain's tables, as read from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored images: a line item is an image of the run that its order is. One group in four is null: images on their own."""
    li = read(spark, sf_dir, "lineitem")
    clip = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("l_discount") * 10))
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_partkey") % 4 != 3, (F.col("l_partkey") % 4).cast("int")).alias("duplicate_group"),
        (F.col("l_quantity") / 50).alias("identity"),
        F.when(~((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")), clip).alias("clip_score"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 105000).alias("aesthetic"),
        F.when(F.col("l_returnflag") != "R", (F.col("l_suppkey") % 101) / 100.0).alias("preference"),
        F.greatest(F.lit(0.0), 1 - F.col("l_tax") * 12.5).alias("safety"),
    )


# The same in DuckDB; n numbers the rows, because null groups are rows of their own.
IMAGES = """
images AS (SELECT row_number() OVER () AS n, l_orderkey AS run_id, CASE WHEN l_partkey % 4 <> 3 THEN (l_partkey % 4)::INT END AS duplicate_group,
  l_quantity / 50 AS identity, CASE WHEN NOT (l_linestatus = 'F' AND l_returnflag = 'N') THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - l_discount * 10)) END AS clip_score,
  least(1.0::DOUBLE, l_extendedprice / 105000) AS aesthetic, CASE WHEN l_returnflag <> 'R' THEN (l_suppkey % 101) / 100.0::DOUBLE END AS preference,
  greatest(0.0::DOUBLE, 1 - l_tax * 12.5) AS safety FROM lineitem)"""
COMPOSITE = """
scored AS (SELECT *, (identity + coalesce(clip_score, 0) + aesthetic + coalesce(preference, 0) + safety)
  / (3.0 + CASE WHEN clip_score IS NULL THEN 0 ELSE 1 END + CASE WHEN preference IS NULL THEN 0 ELSE 1 END) AS composite FROM images)"""
GATED = """
gated AS (SELECT *, CASE WHEN safety < 0.1 THEN false WHEN composite >= 0.7 THEN true WHEN composite <= 0.4 THEN false END AS passed FROM scored)"""
GROUPS = """
groups AS (SELECT run_id, coalesce('g' || duplicate_group, 'n' || n) AS g, max(CASE WHEN passed THEN 2 WHEN passed IS NULL THEN 1 ELSE 0 END) AS best FROM gated GROUP BY ALL)"""
ROLLED = """
counts AS (SELECT run_id, count(*) AS n_groups, count(*) FILTER (best = 2) AS n_passed, count(*) FILTER (best = 1) AS n_needs_hitl FROM groups GROUP BY run_id),
means AS (SELECT run_id, count(*) AS n_images, avg(identity) AS mean_identity, avg(clip_score) AS mean_clip_score, avg(aesthetic) AS mean_aesthetic,
  avg(preference) AS mean_preference, avg(safety) AS mean_safety, count(*) FILTER (safety < 0.5) / count(*)::DOUBLE AS unsafe_rate FROM gated GROUP BY run_id),
rolled AS (SELECT *, n_passed / n_groups::DOUBLE AS pass_rate FROM counts JOIN means USING (run_id))"""
Z2 = "(1.959963986120195 * 1.959963986120195)"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """The interval as text for DuckDB."""
    p, trials = f"({k} / ({n})::DOUBLE)", f"({n})::DOUBLE"
    middle, reach = f"(({p} + {Z2} / (2 * {trials})) / (1 + {Z2} / {trials}))", f"(1.959963986120195 / (1 + {Z2} / {trials}) * sqrt({p} * (1 - {p}) / {trials} + {Z2} / (4 * {trials} * {trials})))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {middle} - {reach})) END", f"CASE WHEN {n} = 0 THEN 1.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {middle} + {reach})) END"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per label of ``embeddings``, its images hashed by the signs of their vectors."""
    from ..operators.similarity import sign_hash

    return sign_hash(read(spark, sf_dir, "embeddings")).select(F.col("label").alias("run_id"), F.col("vec_id").alias("ordinal"), "hash")
