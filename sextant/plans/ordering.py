"""Numbering rows in a total order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.plans.storage import written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: 0, 1, 2, ... by `order`. Rows go to ranges of the order, and each range starts where those before it end."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    # A row per range.
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__row", within).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__range", "__row", "__start")


def placed(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df as an ordered table: adds name, from 0, by columns that may descend; ties go by what else a row holds, so reruns are equal."""
    rest = [F.to_json(F.struct(*df.columns))]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(width, *order, *rest).withColumn("__range", F.spark_partition_id()), "ordered")
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order, *rest)) - 1
    return ranged.withColumn("__row", within).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__range", "__row", "__start")
