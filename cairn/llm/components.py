"""Connected components of a table of links, by alternating large and small stars.

Every half step replaces a node's neighbours' links by links to their smallest one:
minima are partial aggregates, and the join back merges written tables, so a node that
holds a third of all links is split by adaptive execution and no table is broadcast.  Links and components stay
in tables; the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import written


def _half(links: DataFrame) -> DataFrame:
    least = written(links.groupBy("_u").agg(F.min("_v").alias("_least")), "least")
    return links.join(least.hint("merge"), "_u")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("_u", "_v"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``_node``, ``_root`` of every linked node; the root is the smallest node of its component.

    ``links`` has the columns ``_u`` and ``_v`` of one orderable type.  Nodes without a
    link are not returned.
    """
    pair = F.col("_u") != F.col("_v")
    now = written(links.where(pair).select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct(), "links")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        large = _half(both).where("_v > _u").select(F.col("_v").alias("_u"), F.least("_u", "_least").alias("_v")).distinct()
        large = written(large, "large")
        small = _half(large)
        moved = small.where("_v > _least").select(F.col("_v").alias("_u"), F.col("_least").alias("_v"))
        now = written(moved.unionByName(small.select("_u", F.col("_least").alias("_v"))).distinct(), "links")
    roots = now.select(F.col("_v").alias("_node"), F.col("_v").alias("_root")).distinct()
    return now.select(F.col("_u").alias("_node"), F.col("_v").alias("_root")).unionByName(roots)
