"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each source has a word budget. A document's hash decides: documents below the
source's threshold are taken once more than the others. The threshold is found
by histograms of words per source and hash bucket: one pass finds the bucket in
which the budget ends, and each further pass splits only that bucket. Budgets
are nested: a larger one takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

HASH_BITS, LEVEL_BITS = 60, 10
WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this many rows are broadcast; beyond it they are joined.
BROADCAST_SOURCES = 50_000


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Word targets of sources: ``sizes(key, source, source_size)`` plus ``target``.

    ``weights`` repeat over the sources in code point order, null last. A target
    above ``limit`` times its source's size stops there and the excess goes to
    the others by weight, until none is above.
    """
    place = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)  # one row per source
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).withColumn("most", limit * F.col("source_size"))
    scratch = Scratch(sizes.sparkSession, "targets")
    ranked = scratch.save(ranked, "ranked")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, above = 0.0, -1
    while True:
        full = level * F.col("weight") > F.col("most")
        r = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(full, 1)).alias("full")
        ).first()
        if r["full"] == above or not r["weight"]:
            break
        above, level = r["full"], (share * total - r["most"]) / r["weight"]
    return ranked.select("key", "source", "source_size", F.when(level * F.col("weight") > F.col("most"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _meet(rows: DataFrame, table: DataFrame, n: int, on: str = "key") -> DataFrame:
    return rows.join(F.broadcast(table) if n <= BROADCAST_SOURCES else table, on)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """All rows of ``docs(doc_id, text, source, ...)`` with what the mix takes of them.

    Adds ``size`` (words; a null text has none), ``source_size``, ``target`` (of
    the row's source), ``copies`` (0 to ``limit``) and ``taken`` = size * copies;
    a column of one of these names is replaced. Documents are taken whole. The
    document in which a budget ends is taken if that comes nearer to the target,
    so a source misses it by half a document at most. A null source is a source.
    Rows with the same doc_id (null is an id too) have the same hash and are
    taken or left together. The result depends on the rows alone, not on their
    order or partitions. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = base.withColumns({"size": word_count(F.col("text")), "_mix_key": _key(F.col("source")), "_mix_hash": _hash(F.col("doc_id"))})
    narrow = scratch.save(sized.select(F.col("_mix_key").alias("key"), "source", "size", F.col("_mix_hash").alias("hash")), "narrow")
    sizes = narrow.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = scratch.save(targets(sizes, weights, share, float(limit)), "targets")
    n = goal.count()
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(0).cast("long")
    state = goal.withColumn("times", whole).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    edge = scratch.save(state.where("source_size > 0 and times < %d" % limit).select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside")), "edge")
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        within = _meet(narrow.where("size > 0").select("key", "size", "hash"), edge, n).where(F.shiftright("hash", bits + LEVEL_BITS) == F.col("prefix"))
        bucket = F.shiftright("hash", bits)
        histogram = within.groupBy("key", "rest", "below", bucket.alias("bucket")).agg(F.sum("size").alias("held"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        upto = F.sum("held").over(W.partitionBy("key").orderBy("bucket")) + F.col("below")
        crossed = histogram.withColumn("upto", upto).where("upto > rest").groupBy("key", "rest").agg(F.min_by(F.struct("bucket", "held", "upto", "lo", "hi"), "bucket").alias("b"))
        edge = scratch.save(crossed.select("key", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.held")).alias("below"), F.col("b.held").alias("inside"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")), "edge")
        # A bucket with one hash left is the document in which the budget ends.
        if edge.agg(F.coalesce(F.max(F.col("hi") - F.col("lo")), F.lit(0)).alias("wide")).first()["wide"] == 0:
            break
    nearer = 2 * (F.col("rest") - F.col("below")) >= F.col("inside")
    cut = edge.select("key", F.when(nearer, F.col("lo") + 1).otherwise(F.col("lo")).alias("cut"))
    plan = state.select("key", "source_size", "target", "times").join(cut, "key", "left").toDF("_mix_key", "source_size", "target", "_mix_times", "_mix_cut")
    copies = F.col("_mix_times") + F.when(F.col("_mix_hash") < F.col("_mix_cut"), 1).otherwise(0)
    out = _meet(sized, plan, n, "_mix_key").withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*base.columns, "size", "source_size", "target", "copies", "taken")


# The same by sorting: budgets in closed form, documents in hash order.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM w),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
l AS (SELECT (budget - spent) / weights AS level FROM c WHERE (budget - spent) / weights * weight <= most ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) * weight > most THEN most ELSE (SELECT level FROM l) * weight END AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS times FROM t),
g AS (SELECT d.source, d.h, sum(d.size) AS held FROM d GROUP BY d.source, d.h),
a AS (SELECT source, h, held, sum(held) OVER (PARTITION BY source ORDER BY h) - held AS below FROM g)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.times + CASE WHEN p.times < 2 AND p.source_size > 0 AND (a.below + a.held <= p.target - p.times * p.source_size
             OR (a.below <= p.target - p.times * p.source_size AND 2 * (p.target - p.times * p.source_size - a.below) >= a.held)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN a ON a.source IS NOT DISTINCT FROM d.source AND a.h = d.h
"""
