"""Shared treatment of vector tables: which vectors count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(table: DataFrame) -> DataFrame:
    """``vec_id, vector array<double>, usable``: with an id and a finite, non-zero, complete vector. Unusable vectors are null."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    return rows.select("vec_id", F.when(good, F.col("vector")).alias("vector"), good.alias("usable"))


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the usable rows."""
    return flagged(table).where("usable").drop("usable")
