"""Connected components of a link table, by alternating star contraction.

Each round replaces a vertex's links by links to its smallest neighbour, first
towards larger neighbours, then towards smaller ones, so a component becomes a
star around its smallest member in a number of rounds that grows with the
logarithm of its size; stars end the rounds. Rounds are written: no link list ever reaches the driver
and a lost executor costs one re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def checkpointed(rows: DataFrame, _name: str = "") -> DataFrame:
    """``rows`` written to the session's checkpoint folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def _settled(edges: DataFrame) -> bool:
    """Whether links ``u > v`` form stars: no vertex has two smaller neighbours, or one on either side."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(links: DataFrame, save: Callable[..., DataFrame] = checkpointed, drop: Callable[..., None] = lambda *_: None) -> DataFrame:
    """``links(u, v)`` -> ``(node, component)`` for every linked node.

    Self links and repeated links are ignored, as are links with a null end; the
    component is the smallest node. An empty table gives an empty table. ``save``
    writes a table and reads it back, ``drop`` deletes what nothing reads any more.
    """
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = save(links.where("u <> v").select(*ends).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the joins have a plain shuffle on either side and Spark can split a crowded vertex.
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        drop(least)
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(*[F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")])
        now = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        drop(edges, large, least)
        edges = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
