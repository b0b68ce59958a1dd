"""Vocabulary of groups: counts, document frequency, verdicts and distinctiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import words


def group_files(files: DataFrame, group: str) -> DataFrame:
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"))


def word_counts(tags: DataFrame, group: str, name: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(group, word, cnt) over every occurrence, of the words that count as evidence."""
    each = tags.select(group, F.explode(words.split_words(F.col(name))).alias("word"))
    return each.where(words.keeps(F.col("word"), stopwords)).groupBy(group, "word").agg(F.count(F.lit(1)).alias("cnt"))


def mix(files: DataFrame, group: str, kind: str) -> DataFrame:
    return files.groupBy(group, kind).agg(F.count(F.lit(1)).alias("cnt"))


def parseable_share(files: DataFrame, group: str, parseable: Column) -> DataFrame:
    """(group, parseable, total), groups without any included."""
    return files.groupBy(group).agg(F.count_if(parseable).alias("parseable"), F.count(F.lit(1)).alias("total"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals: (group, value, agree, total)."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("best")
    return counted.groupBy(group).agg(best, F.sum("n").alias("total")).select(group, F.col("best.value").alias(value), (-F.col("best.less")).alias("agree"), "total")


def table(rows: DataFrame, cluster: str = "cluster", word: str = "word", count: str = "cnt") -> DataFrame:
    """Clean (cluster, word, cnt): no empty names, counts that are no numbers as zero, the larger of repeated pairs."""
    n = F.coalesce(F.trim(F.col(count).cast("string")).try_cast("long"), F.lit(0))
    return rows.where((F.col(cluster) != "") & (F.col(word) != "")).groupBy(F.col(cluster).alias("cluster"), F.col(word).alias("word")).agg(F.max(n).alias("cnt"))


def document_frequency(vocabulary: DataFrame) -> DataFrame:
    """Clusters that each word is in; pairs are distinct in a clean table, whose counts are never null."""
    return vocabulary.groupBy("word").agg(F.count("cnt").alias("df"))  # of cnt, so that the table's exchange is the one that top terms need


def top_terms(vocabulary: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent words of each cluster, the least of equals first, with their rank."""
    w = Window.partitionBy("cluster").orderBy(F.col("cnt").desc(), "word")
    return vocabulary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _judged(vocabulary: DataFrame, top: int) -> DataFrame:
    """Top terms with df and n, the number of clusters (all of which have top terms); the vocabulary is read once."""
    best = top_terms(vocabulary, top)
    n = best.agg(F.count_distinct("cluster").alias("n"))
    return best.join(document_frequency(vocabulary), "word").join(F.broadcast(n))  # one row


def verdicts(vocabulary: DataFrame, parseable: DataFrame | None = None, top: int = 8, all_rows: bool = True) -> DataFrame:
    """(cluster, rare, status, top): a cluster with at most one rare word among its top ones is flagged, or unparseable if no file of it is.

    parseable: (cluster, parseable, total); rows with no files say nothing.
    """
    scored = _judged(vocabulary, top)
    rare = F.count_if(F.col("df") <= words.rare_max(F.col("n"))).alias("rare")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("top")
    out = scored.groupBy("cluster").agg(rare, names)
    share = F.lit(None).cast("double")
    if parseable is not None:
        out = out.join(parseable.where("total > 0").select("cluster", (F.col("parseable") / F.col("total")).alias("share")), "cluster", "left")
        share = F.col("share")
    status = F.when(F.col("rare") > 1, "ok").when(share == 0, "unparseable").otherwise("flagged")
    out = out.select("cluster", "rare", status.alias("status"), "top")
    return out if all_rows else out.where("status <> 'ok'")


def distinctive(vocabulary: DataFrame, top: int = 8, k: int = 20) -> DataFrame:
    """(cluster, distinctive, considered): top words that score over one half."""
    scored = _judged(vocabulary, top)
    score = words.distinctiveness(F.col("df"), F.col("n"), k)
    return scored.groupBy("cluster").agg(F.count_if(score > 0.5).alias("distinctive"), F.count(F.lit(1)).alias("considered"))


def in_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (with path) of claimed paths, once for each list (group, path) that claims them; others have no group to go to."""
    return rows.join(lists.select("group", "path").distinct(), "path")


def list_files(lists: DataFrame) -> DataFrame:
    """(group, files): rows of each list, so a path in two lists counts in both."""
    return lists.groupBy("group").agg(F.count(F.lit(1)).alias("files"))
