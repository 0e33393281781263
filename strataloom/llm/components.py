"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, spread_join


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Each node joins its neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.write(arcs.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), F.count("*").alias("n")), "cc-least")
    met = spread_join(arcs, least, ["a"], "n", "b")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return scratch.write(out.filter("a > b").distinct(), "cc")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class): for each node with an edge (a, b) the least node of its component.

    Nodes are long and a <> b. Minima are combined before the shuffle and neighbours are never gathered; the edges of
    a hub are dealt over several tasks. Each round is written to the scratch folder; the number of rounds grows with the
    logarithm of the number of nodes. The driver sees one checksum a round.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    check = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen, was = check(now), None
    while seen != was:
        now = _stars(_stars(now, True, scratch), False, scratch)
        seen, was = check(now), seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
