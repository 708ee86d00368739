"""Connected components of links, by alternating stars; nothing is gathered on the driver but a count and a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnlake.llm import common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node with a link, but for roots themselves; edges has columns u and v, root is the least node reached.

    A round links all larger neighbours of a node to its least neighbour, then all smaller ones, until nothing changes; the rounds are no more
    than about the square of the logarithm of the nodes. Every round is a written table. A node of very many links is a hot key of the
    two joins on u, whose other side has one row a key, so adaptive execution splits it; the groupings combine before they shuffle.
    """
    edges = C.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before, state = None, _state(edges)
    while state[0] and before != state:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = C.written(small.distinct(), "links")
        before, state = state, _state(edges)
    return edges.select("u", F.col("v").alias("root"))
