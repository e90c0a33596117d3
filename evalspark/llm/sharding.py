"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions only.

The ring has ``cells`` places; each shard owns virtual nodes on it, and a key
hashes to a cell and belongs to the next virtual node clockwise. With bounded
loads a shard that is full passes further keys on to the next virtual node.
Which keys pass on is a matter of counts: one aggregation gives the keys per
cell, a table of fixed size, from which the driver lays intervals of ranks onto
shards; every row then finds its interval by its rank within its cell. Ranks
come from windows over sub-buckets of cells whose number follows the input.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

CELLS, VIRTUAL = 1024, 16
CHUNK = 4096


def ring(shards: int, cells: int = CELLS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise; another shard only adds nodes."""

    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest())

    nodes = sorted((place(s, v) % cells, place(s, v), s) for s in range(shards) for v in range(virtual))
    return [(cell, s) for cell, _, s in nodes]


def owners(shards: int, cells: int = CELLS, virtual: int = VIRTUAL) -> list[int]:
    """The index into the ring of each cell's first virtual node clockwise."""
    at = [cell for cell, _ in ring(shards, cells, virtual)]
    return [bisect_left(at, c) % len(at) for c in range(cells)]


def spread(counts: dict[int, int], shards: int, law: str, cells: int = CELLS, virtual: int = VIRTUAL) -> list[dict]:
    """Intervals of each cell's ranks, the shard that takes them, and the first slot there.

    ``rows``: shard s holds n // shards rows, and one more if s < n % shards.
    ``key``: no bound; a cell's keys all stay with its owner.
    """
    nodes, first = ring(shards, cells, virtual), owners(shards, cells, virtual)
    grown_nodes, grown_first = ring(shards + 1, cells, virtual), owners(shards + 1, cells, virtual)
    n = sum(counts.values())
    room = [n if law == "key" else n // shards + (s < n % shards) for s in range(shards)]
    used, out = [0] * shards, []
    waiting = [(c, 0, counts[c], first[c]) for c in sorted(counts)]
    while waiting:
        passed = []
        for cell, low, high, k in waiting:
            s = nodes[k % len(nodes)][1]
            take = min(room[s] - used[s], high - low)
            if take:
                out.append({"cell": cell, "low": low, "high": low + take, "shard": s, "first": used[s], "grown": grown_nodes[grown_first[cell]][1] if law == "key" else None})
                used[s] += take
            if low + take < high:
                passed.append((cell, low + take, high, k + 1))
        waiting = passed
    return out


def shard(docs: DataFrame, shards: int = 16, law: str = "rows", cells: int = CELLS, virtual: int = VIRTUAL, bucket_rows: int = 2000) -> DataFrame:
    """Put every row of ``docs(doc_id, text, ...)`` into a shard and a slot.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and
    ``cell``. ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32``
    its unsigned CRC-32 (null: that of no bytes, 0). Slots run from 0 without
    gaps in each shard. With law ``rows`` the bound is exact, so row counts
    differ by one at most. Rows with a null doc_id are one key. Rows equal in
    doc_id and text cannot be told apart and are laid out as a counted group, so
    a key that holds a large part of all rows never meets in one task. An empty
    table gives an empty table. Other columns are not read.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    groups = facts.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    # XXH64 of a null is its seed: one more key. The high bits choose the cell, the whole row the sub-bucket.
    cell = F.shiftrightunsigned(F.xxhash64("doc_id"), 32) % cells
    groups = scratch.save(groups.withColumns({"cell": cell.cast("int"), "mark": F.xxhash64("doc_id", "size", "text_crc32")}), "groups")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.coalesce(F.max("copies"), F.lit(0)).alias("most")).first()
    subs = max(1, -(-total["n"] // (cells * bucket_rows)))
    groups = groups.withColumn("sub", F.pmod("mark", F.lit(subs)))
    sums = scratch.save(groups.groupBy("cell", "sub").agg(F.sum("copies").alias("held")), "sums")
    counts = {r["cell"]: r["held"] for r in sums.groupBy("cell").agg(F.sum("held").alias("held")).collect()}  # `cells` rows at most
    plan = json.dumps(spread(counts, shards, law, cells, virtual))
    laid = spark.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<cell:int,low:long,high:long,shard:int,first:long,grown:int>>")))
    before = F.sum("held").over(W.partitionBy("cell").orderBy("sub")) - F.col("held")
    starts = sums.select("cell", "sub", before.alias("before"))
    running = F.sum("copies").over(W.partitionBy("cell", "sub").orderBy("mark", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0))
    ranked = groups.withColumn("until", running).join(starts, ["cell", "sub"]).withColumn("until", F.col("until") + F.col("before")).withColumn("since", F.col("until") - F.col("copies"))
    # The plan has a row for each cell and for each overflow, whatever the input's size.
    met = ranked.join(F.broadcast(laid), "cell").where((F.col("since") < F.col("high")) & (F.col("until") > F.col("low")))
    begin = F.greatest("since", "low")
    met = met.withColumns({"slot": F.col("first") + begin - F.col("low"), "span": F.least("until", "high") - begin})
    if total["most"] > CHUNK:
        chunked = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("span") - 1, F.lit(CHUNK)))).withColumns({"slot": F.col("slot") + F.col("part"), "span": F.least(F.col("span") - F.col("part"), F.lit(CHUNK))})
        met = chunked.repartition(F.col("slot"))
    rows = met.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("span") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"), "cell")
