"""Predicates over a graph of commits, given as (sha, parent) with a row per parent (null for none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import links


def history(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, sha): each tip and what it descends from. tips: a column of commits; those that do not exist are left out."""
    there = tips.select(F.col(tips.columns[0]).alias("tip")).distinct().join(commits.select(F.col("sha").alias("tip")).distinct(), "tip", "left_semi")
    up = links.closure(commits.select(F.col("sha").alias("src"), F.col("parent").alias("dst")), there.select(F.col("tip").alias("start")))
    return there.select("tip", F.col("tip").alias("sha")).unionByName(up.select(F.col("start").alias("tip"), F.col("node").alias("sha"))).distinct()


def exists(commits: DataFrame, shas: DataFrame) -> DataFrame:
    """(sha, there)."""
    known = commits.select("sha", F.lit(True).alias("there")).distinct()
    return shas.select("sha").join(known, "sha", "left").select("sha", F.coalesce("there", F.lit(False)).alias("there"))


def left_right(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ahead, behind, is_ancestor): commits of a that b lacks, of b that a lacks, and whether b descends from a."""
    tips = pairs.select(F.col("a").alias("tip")).union(pairs.select("b"))
    h = history(commits, tips)
    mine = pairs.join(h.withColumnRenamed("tip", "a"), "a").select("a", "b", "sha", F.lit(1).alias("l"))
    other = pairs.join(h.withColumnRenamed("tip", "b"), "b").select("a", "b", "sha", F.lit(1).alias("r"))
    both = mine.join(other, ["a", "b", "sha"], "full")
    n = lambda test, name: F.count_if(test).alias(name)
    return both.groupBy("a", "b").agg(n(F.col("r").isNull(), "ahead"), n(F.col("l").isNull(), "behind")).withColumn("is_ancestor", F.col("ahead") == 0)
