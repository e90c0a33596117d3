"""Exact percentiles of groups of any size, without any group in one task.

Small groups are aggregated as they are. In a large one the value at a rank is
found by nested histograms: a sketch of the group names two of its own values
between which the rank should lie; exact counts of the rows below, at and
between them tell in which of the five parts it does lie; and only that part is
looked at again. A rank that falls on one of the two values is found, however
many rows equal it. Sketches only steer: a bad one costs a round, never a wrong
value. The next value in order, for interpolation, comes from one last scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpointed

#: Cuts of a sketch, and its accuracy (relative error of a rank: one over this).
CUTS, ACCURACY = 1024, 10_000
_CELL = ["g", "q"]
#: Bytes of group keys up to which what is known of the groups goes to all tasks; beyond, rows and groups meet in a shuffle.
SPREAD = 1 << 20


def _bracket(r: Column, n: Column) -> tuple[Column, Column]:
    """The places, among the cuts, of the two values around rank ``r`` of ``n``."""
    at = r / n * CUTS
    return F.greatest(F.floor(at).cast("int") - 1, F.lit(0)), F.least(F.ceil(at).cast("int") + 2, F.lit(CUTS))


def _counts(pool: DataFrame) -> DataFrame:
    """Rows of each cell below, at, between, at and above its bracket's values ``a`` and ``b``."""
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    parts = (v < a, v == a, (v > a) & (v < b), (v == b) & (b > a), v > b)
    return pool.groupBy(*_CELL).agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)])


def _selected(rows: DataFrame, sought: DataFrame, limit: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``g, q, v``: the value at rank ``r`` (from 0) of each cell of ``sought(g, q, r)`` among ``rows(g, v)``."""
    cuts = [i / CUTS for i in range(CUTS + 1)]
    pool, found = rows.join(near(sought.select(*_CELL)), "g"), None
    while True:
        sizes = pool.groupBy(*_CELL).agg(F.count("*").alias("n"), F.percentile_approx("v", cuts, ACCURACY).alias("cut"))
        low, high = _bracket(F.col("r"), F.col("n"))
        state = checkpointed(sought.join(sizes, _CELL).select(*_CELL, "r", "n", F.col("cut")[low].alias("a"), F.col("cut")[high].alias("b")))
        # What is left of a cell fits in one row: its values in order.
        small = pool.join(near(state.where(F.col("n") <= limit).select(*_CELL, "r")), _CELL).groupBy(*_CELL, "r").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        done = small.select(*_CELL, F.get("vs", F.col("r").cast("int")).alias("v"))
        wide = state.where(F.col("n") > limit).drop("n")
        counted = wide.join(_counts(pool.join(near(wide.drop("r")), _CELL)), _CELL)
        before, part = [F.lit(0)], None
        for i in range(5):
            before.append(before[-1] + F.col(f"n{i}"))
        for i in range(4, -1, -1):
            part = F.when(F.col("r") < before[i + 1], i) if part is None else F.when(F.col("r") < before[i + 1], i).otherwise(part)
        chosen = counted.withColumn("part", part)
        left = F.col("r") - F.when(F.col("part") == 0, 0).when(F.col("part") == 2, before[2]).otherwise(before[4])
        chosen = checkpointed(chosen.select(*_CELL, "a", "b", "part", left.alias("r")))
        hit = chosen.where("part in (1, 3)").select(*_CELL, F.when(F.col("part") == 1, F.col("a")).otherwise(F.col("b")).alias("v"))
        answers = checkpointed(done.unionByName(hit))
        found = answers if found is None else found.unionByName(answers)
        sought = chosen.where("part not in (1, 3)")
        if sought.isEmpty():
            return found
        inside = F.when(F.col("part") == 0, F.col("v") < F.col("a")).when(F.col("part") == 4, F.col("v") > F.col("b")).otherwise((F.col("v") > F.col("a")) & (F.col("v") < F.col("b")))
        pool = checkpointed(pool.join(near(sought.drop("r")), _CELL).where(inside).select(*_CELL, "v"))
        sought = sought.select(*_CELL, "r")


def percentiles(rows: DataFrame, keys: Sequence[str], value: Column | str, qs: Sequence[float], names: Sequence[str], limit: int = 4096) -> DataFrame:
    """Each group's exact percentiles ``qs``, linearly interpolated, as columns ``names`` beside the ``keys``.

    Nulls do not count, a group without values has 0.0, null keys are keys, and
    NaN is above every number. No keys make one group; an empty table has none.
    Groups of more than ``limit`` values are searched, in a few scans of the
    rows, whose plan should therefore be cheap or written.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    base = rows.select(F.struct(*keys, F.lit(0).alias("_")).alias("g"), (v + F.lit(0.0)).alias("v"))
    sizes = base.groupBy("g").agg(F.count("v").alias("total"), F.count_if(~F.isnan("v")).alias("n"))
    large = checkpointed(sizes.where(F.col("total") > limit))
    direct = F.percentile("v", F.array(*[F.lit(q) for q in qs]))
    plain = [F.coalesce(F.col("p")[i], F.lit(0.0)).alias(c) for i, c in enumerate(names)]
    size = large.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json("g")) + 64).alias("bytes")).first()
    if not size["n"]:
        return base.groupBy("g").agg(direct.alias("p")).select(*[F.col("g")[k].alias(k) for k in keys], *plain)
    near = F.broadcast if size["bytes"] * len(qs) <= SPREAD else lambda t: t
    few = base.join(near(large.select("g")), "g", "left_anti").groupBy("g").agg(direct.alias("p")).select("g", *plain)

    held = base.where("v is not null").join(near(large.select("g")), "g")
    nan = F.lit(float("nan"))
    cells = large.select("g", "total", "n", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("q", "share"))
    cells = checkpointed(cells.withColumn("place", F.col("share") * (F.col("total") - 1)).withColumn("r", F.floor("place")))
    numbers = held.where(~F.isnan("v"))
    at = checkpointed(_selected(numbers, cells.where("r < n").select("g", "q", "r"), limit, near))
    beyond = numbers.join(near(at.withColumnRenamed("v", "x")), "g").groupBy("g", "q").agg(F.count_if(F.col("v") <= F.col("x")).alias("upto"), F.min(F.when(F.col("v") > F.col("x"), F.col("v"))).alias("next"))
    known = cells.join(at, _CELL, "left").join(beyond, _CELL, "left")
    part = F.col("place") - F.col("r")
    next_value = F.when(F.col("r") + 1 < F.col("upto"), F.col("v")).otherwise(F.coalesce("next", nan))
    exact = F.when(F.col("v").isNull(), nan).when((part == 0) | (next_value == F.col("v")), F.col("v")).otherwise(F.col("v") + part * (next_value - F.col("v")))
    many = known.groupBy("g").agg(*[F.max(F.when(F.col("q") == i, exact)).alias(c) for i, c in enumerate(names)])
    return few.unionByName(many).select(*[F.col("g")[k].alias(k) for k in keys], *names)
