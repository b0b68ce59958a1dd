"""What the corpus operators share: code on executors, plan-time sizes, numbering, and the engine's shared storage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.plans.storage import discard, written  # noqa: F401, for the operators

#: Where this package can be imported from; workers add it if they cannot import it otherwise.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def partitions(spark: SparkSession) -> int:
    """Shuffle width, which the cluster sets in proportion to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ran: list = [None]  # what a worker ran last


def _found(root: str, module: str, name: str):
    """A function by name, on a worker; what the worker remembers for another function is dropped first."""
    import importlib
    import sys

    if root not in sys.path:
        sys.path.append(root)
    found = getattr(importlib.import_module(module), name)
    here = importlib.import_module(__name__)
    if here._ran[0] != (module, name):
        here._ran[0] = (module, name)
        if "sextant.llm.bpe" in sys.modules:
            sys.modules["sextant.llm.bpe"].forget()
        _release()
    return found


def _release() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _task(func, args, rows: int):
    """func(*rows, *args), looked up on executors; of as many parameters as Spark asks for."""
    root, module, name, here = ROOT, func.__module__, func.__name__, __name__

    def call(*given):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return importlib.import_module(here)._found(root, module, name)(*given, *args)

    return (lambda left, right: call(left, right)) if rows == 2 else (lambda rows: call(rows))


def batches_task(func, *args):
    """mapInArrow function that runs func(batches, *args) on executors; func is looked up there by name."""
    return _task(func, args, 1)


def group_task(func, *args):
    """applyInArrow function that runs func(table, *args) on executors."""
    return _task(func, args, 1)


def cogroup_task(func, *args):
    """Cogrouped applyInArrow function that runs func(left, right, *args) on executors."""
    return _task(func, args, 2)


#: Tiles that a probe meets at once. A class of T tiles sends each T / GROUP times, and a task has T * GROUP pairs of it at most.
GROUP = 8


def tiled(rows: DataFrame, tile: int, order: Column) -> DataFrame:
    """Tiles of about `tile` rows of each class: class, tile, tiles (how many the class has), mine (list of the other columns)."""
    counts = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    cut = rows.join(F.broadcast(counts), "class").withColumn("tile", F.pmod(order, F.col("tiles")).cast("int"))  # classes are few
    return cut.groupBy("class", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct(*(c for c in rows.columns if c != "class"))).alias("mine"))


def tile_pairs(made: DataFrame, steps: list[int]) -> DataFrame:
    """Every two tiles whose classes are a step apart, once: mine, theirs, by (the step), tile, tile2, class (of theirs).

    Pairs are dealt by class and group of tiles, so that the tiles of one large class are many tasks.
    """
    counts = made.groupBy("class").agg(F.first("tiles").alias("tiles2"))
    probes = made.drop("tiles").withColumn("by", F.explode(F.array(*(F.lit(n).cast("long") for n in steps)))).withColumn("class", F.col("class") + F.col("by"))
    probes = probes.join(F.broadcast(counts), "class").withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("tiles2") - 1) / GROUP).cast("int"))))
    others = made.select("class", F.floor(F.col("tile") / GROUP).cast("int").alias("group"), F.col("tile").alias("tile2"), F.col("mine").alias("theirs"))
    wanted = (F.col("by") > 0) | (F.col("tile") <= F.col("tile2"))
    return probes.join(others, ["class", "group"]).where(wanted).select("mine", "theirs", "by", "tile", "tile2", "class")


def ranked(df: DataFrame, keys: list[str], spread: Column, order: list[Column], name: str, buckets: int) -> DataFrame:
    """Adds column `name`: 0, 1, 2, ... within equal `keys`, without bringing a key's rows together.

    Rows are numbered within (keys, bucket of `spread`), and each bucket starts where the ones
    before it end. A key with most of the rows still spreads over all buckets. `keys` must have few
    distinct values (their number times `buckets` is the size of the table of starts).
    """
    from pyspark.sql import Window

    b = f"{name}_bucket"
    df = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    starts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, b, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1
    return df.withColumn("__row", within).join(starts, [*keys, b]).withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__start", "__row", b)
