"""The library's star contraction, with rounds written to an operator's own scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components
from .scratch import Scratch


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(node, component)`` for every linked node; the component is the smallest node."""
    return components.connected_components(links, scratch.save, scratch.drop)


#: SQL of the same, by following all paths of ``links(u, v)``; for the equivalents of queries.
REACHED = """ends AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached(node, other) AS (SELECT u, v FROM ends UNION SELECT reached.node, ends.v FROM reached JOIN ends ON ends.u = reached.other),
components AS (SELECT node, least(node, min(other)) AS component FROM reached GROUP BY node)"""
