"""Run manifests: digests of models, agreement with what was asked for, and where model files lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields in which a manifest must agree with its request.
COMPARED = ("run_id", "base_checkpoint", "loras", "sampling", "prompt", "negative_prompt", "seeds")


def with_digests(specs: DataFrame, digests: DataFrame) -> DataFrame:
    """``specs(run_id, base_checkpoint, vae, loras array<struct<name,weight>>)`` with every name's ``digests(name, sha256)``.

    LoRAs keep their order; a name without a digest is an error before anything is generated.
    """
    loras = specs.select("run_id", F.posexplode("loras").alias("pos", "l")).select("run_id", "pos", F.col("l.name").alias("name"), F.col("l.weight").alias("weight"))
    found = loras.join(digests, "name", "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "sha256", "weight"))).alias("held"))
    base, vae = digests.toDF("base_checkpoint", "base_sha256"), digests.toDF("vae", "vae_sha256")
    rows = specs.join(base, "base_checkpoint", "left").join(vae, "vae", "left").join(found, "run_id", "left")
    unknown = F.col("base_sha256").isNull() | (F.col("vae").isNotNull() & F.col("vae_sha256").isNull()) | F.exists(F.coalesce("held", F.array()), lambda x: x["sha256"].isNull())
    sound = F.when(F.coalesce(unknown, F.lit(False)), F.raise_error(F.concat(F.lit("a model of this run was not found: "), "run_id")).cast("string")).otherwise(F.col("base_sha256"))
    return rows.withColumn("base_sha256", sound).withColumn("loras", F.transform(F.coalesce("held", F.array().cast("array<struct<pos:int,name:string,sha256:string,weight:double>>")), lambda x: F.struct(x["name"].alias("name"), x["sha256"].alias("sha256"), x["weight"].alias("weight")))).drop("held")


def differences(manifests: DataFrame, requests: DataFrame, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """``run_id, differing``: the compared fields in which a manifest is not what was asked for."""
    other = requests.select("run_id", *[F.col(f).alias(f"_asked_{f}") for f in fields if f != "run_id"])
    parts = [F.when(~F.col(f).eqNullSafe(F.col(f"_asked_{f}")), F.lit(f)) for f in fields if f != "run_id"]
    return manifests.join(other, "run_id").select("run_id", F.array_compact(F.array(*parts)).alias("differing"))


def resolve(names: DataFrame, listing: DataFrame) -> DataFrame:
    """``name`` -> ``path`` from ``listing(root_ord, rel, path)``: the first root wins, in it the direct path before the first file of that name."""
    base = F.element_at(F.split("rel", "/"), -1)
    # Two equi-joins: a file in the root itself comes from both, which changes no minimum.
    direct = names.join(listing.withColumn("name", F.col("rel")), "name").withColumn("within", F.lit(0))
    deeper = names.join(listing.withColumn("name", base), "name").withColumn("within", F.lit(1))
    best = direct.unionByName(deeper).groupBy("name").agg(F.min(F.struct("root_ord", "within", "path")).alias("best"))
    return names.join(best.select("name", F.col("best.path").alias("path")), "name", "left")


def models(listing: DataFrame, endings: tuple[str, ...] = ("safetensors", "ckpt", "pt")) -> DataFrame:
    """Relative names of model files over all roots, each once."""
    return listing.where(F.lower(F.regexp_extract("rel", r"\.([^.]*)$", 1)).isin(*endings)).select("rel").distinct()


def exports(lines: DataFrame, references: DataFrame) -> DataFrame:
    """``folder, n_rows, has_references`` of ``lines(folder, line)`` and ``references(folder)``; blank lines don't count."""
    counted = lines.groupBy("folder").agg(F.count_if(F.trim("line") != "").alias("n_rows"))
    return counted.join(references.select("folder").distinct().withColumn("has_references", F.lit(True)), "folder", "left").fillna(False, ["has_references"])
