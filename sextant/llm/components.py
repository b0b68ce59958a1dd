"""Connected components of a graph given as links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, written


def _jumped(table: DataFrame) -> DataFrame:
    """(node, root) with each root's own root instead."""
    far = table.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return table.join(far, "root").select("node", F.col("far").alias("root"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of a link, the smallest node of its component. Null ends make no link.

    Each round, a node goes with the neighbour of least hash (or stays, if it is less itself), and then four
    steps along such choices; nodes that end at the same one become one, and only links between different ones
    stay. As hashes are in no order, chains of choices are short, and each round leaves a fraction of the links. Rounds
    are written to the shared folder, and a round's links go when the next are written. A node that very many
    others go with is one row on its side of the join, so what is skewed is the side that an adaptive join splits.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = both.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    none = both.select("node", F.col("other").alias("root"))
    placed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        near = both.groupBy("node").agg(F.min(placed("other")).alias("least"))
        chosen = written(near.select("node", F.least("least", placed("node"))["v"].alias("root")), "chosen")
        rounds.append(written(_jumped(_jumped(chosen)), "merged"))
        discard(chosen)
        mine, other = (rounds[-1].select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("node", "x"), ("other", "y")))
        left = both.join(mine, "node").select("other", "x").join(other, "other").where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("other"))
        before, both = both, written(left.distinct(), "links")
        if len(rounds) > 1:  # the first links are what an empty result is made of
            discard(before)
    if not rounds:
        return none
    labels = rounds.pop()
    while rounds:
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = rounds.pop().join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    labels = written(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
