"""Pairs of a large group in blocks of bounded size.

A group's rows come in two kinds. The main rows are known to be alike, so no two
of them need comparing; the rest meet each other and all main rows. Each kind is
cut into parts by hash, and each two parts that may hold a pair to compare meet
in a block. Main rows are copied once per part of the rest, so a crowd with few
others costs little more than its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed(rows: DataFrame, main: Column, row: str, size: int) -> DataFrame:
    """Each of ``rows(n_main, n_rest, ...)``, numbers of both kinds in its group, once for every block it meets in.

    ``row`` names a column that tells a group's rows apart, ``size`` bounds a part.
    Adds the block's parts ``x`` <= ``y`` and ``side``: 0 and 2 for its two parts, 1 where a part meets itself.
    """
    mains, rests = (F.ceil(F.col(n) / size).cast("int") for n in ("n_main", "n_rest"))
    hashed = F.xxhash64(row)
    part = F.when(main, F.pmod(hashed, mains)).otherwise(mains + F.pmod(hashed, F.greatest(rests, F.lit(1)))).cast("int")
    # A group without a rest has nothing to compare.
    others = F.when(rests > 0, F.sequence(F.when(main, mains).otherwise(F.lit(0)), mains + rests - 1))
    split = rows.withColumns({"part": part, "others": others}).withColumn("other", F.explode("others"))
    side = F.when(F.col("part") == F.col("other"), 1).when(F.col("part") < F.col("other"), 0).otherwise(2)
    return split.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other"), "side": side}).drop("part", "other", "others")
