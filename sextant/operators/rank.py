"""Ranking files by how much they define, and declarations by who consumes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths, words
from sextant.plans.ordering import placed

LEAST_STEM = 3


def density(tags: DataFrame, files: DataFrame) -> DataFrame:
    """(path, defs, score) of files (path, size) with bytes; files without occurrences score 0."""
    defs = tags.groupBy("path").agg(F.count_if(F.col("role") == "def").alias("defs"))
    found = files.where("size > 0").join(defs, "path", "left").withColumn("defs", F.coalesce("defs", F.lit(0)))
    return found.withColumn("score", words.density(F.col("defs"), F.col("size")))


def best(scored: DataFrame, top: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The highest scores, the least path of equals, over all (a global limit) or for each value of `by`; 0 keeps all."""
    order = [F.col("score").desc(), F.col("path")]
    if not by:
        return scored.orderBy(*order).limit(top) if top else scored.orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= top) if top else ranked


def tiers(files: DataFrame, code: tuple[str, ...]) -> DataFrame:
    """Adds tier: code by extension, dsl otherwise; tests and files without a usable name are left to the caller."""
    return files.withColumn("tier", F.when(paths.extension(F.col("path")).isin(*code), "code").otherwise("dsl"))


def consumers(declarations: DataFrame, code: DataFrame, module: str = "module", stem: str = "stem") -> DataFrame:
    """(module, stem, consumers): how many declarations' stems in the module begin this code's stem.

    The join is on the module and the shortest stem's letters, so it hashes on both and tests prefixes in what meets.
    """
    first = lambda c: F.substring(F.col(c), 1, LEAST_STEM).alias("__first")
    d = declarations.where(F.length(stem) >= LEAST_STEM).select(F.col(module).alias("__m"), F.col(stem).alias("__d"), first(stem))
    c = code.select(F.col(module).alias("module"), F.col(stem).alias("stem"), first(stem))
    meets = (F.col("module") == F.col("__m")) & (c["__first"] == d["__first"]) & F.col("stem").startswith(F.col("__d"))
    return c.join(d, meets).groupBy("module", "stem").agg(F.count(F.lit(1)).alias("consumers"))


def listing(code: DataFrame, dsl: DataFrame, top: int = 0) -> DataFrame:
    """(tier, score, path, position): the best files of the code tier, then of the dsl tier, each at most `top` (0: all), by score and path."""
    out = None
    for nth, (tier, rows) in enumerate((("code", code), ("dsl", dsl))):
        kept = best(rows.select("path", F.col("score").cast("double").alias("score")), top)
        kept = kept.select(F.lit(nth).alias("__tier"), F.lit(tier).alias("tier"), "score", "path")
        out = kept if out is None else out.unionByName(kept)
    return placed(out, [F.col("__tier"), F.col("score").desc(), F.col("path")]).drop("__tier")
