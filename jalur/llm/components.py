"""Connected components of an edge table, as alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> Table:
    """A table (node, root) of every node with an edge; root is the component's least node.

    edges: (u, v), long; either order, loops and repeats are allowed.  The
    number of rounds grows with the logarithm of the longest path; each is
    written to the shared folder, so that the plan stays short and a lost
    executor costs one round at most.
    """
    now = Table(edges.where("u <> v"))
    mark = None
    for _ in range(rounds):
        new = Table(_small(_large(now.df)))
        now.drop()
        now = new
        row = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = Table(now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots))
    now.drop()
    return out
