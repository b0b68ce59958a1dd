"""Links between nodes, inferred from rare symbols with one definer or declared in notes, and questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import notes, words
from sextant.plans.storage import written


def owned(tags: DataFrame, owners: DataFrame) -> DataFrame:
    """Occurrences with each node that owns their path; others are dropped. owners: path, node."""
    return tags.join(owners.select("path", "node").distinct(), "path")


def inferred(tags: DataFrame, node_count: Column | int, top: int = 8, shown: int = 5, node: str = "node", name: str = "name", role: str = "role") -> DataFrame:
    """(src, dst, weight, symbols): nodes that refer to rare symbols which one other node alone defines.

    A symbol is rare if it is referred to by no more nodes than a rare word may be in. A node keeps its
    `top` heaviest links (0: all), ties to the lesser target; `symbols` shows the first of them (0: all).
    """
    n = node_count if isinstance(node_count, Column) else F.lit(node_count)
    each = tags.where(F.col(name).isNotNull() & F.col(node).isNotNull() & F.col(role).isin("def", "ref")).select(F.col(name).alias("name"), F.col(node).alias("node"), (F.col(role) == "def").alias("is_def")).distinct()
    # Counts and one definer, which combine map-side; the nodes of names that most nodes have are never gathered.
    per_name = each.groupBy("name").agg(F.count_if("is_def").alias("definers"), F.count_if(~F.col("is_def")).alias("readers"), F.min(F.when(F.col("is_def"), F.col("node"))).alias("dst"))
    few = per_name.where((F.col("definers") == 1) & F.col("readers").between(F.lit(1), words.rare_max(n))).select("name", "dst")
    pairs = each.where(~F.col("is_def")).join(few, "name").where(F.col("node") != F.col("dst"))
    names = F.array_sort(F.collect_list("name"))  # at most the rare symbols of one pair of nodes
    edges = pairs.groupBy(F.col("node").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"), (F.slice(names, 1, shown) if shown else names).alias("symbols"))
    edges = edges.withColumn("symbols", F.array_join("symbols", ","))
    return heaviest(edges, top) if top else edges


def heaviest(edges: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= top).drop("__nth")


def declared(docs: DataFrame, node: str = "node", text: str = "text") -> DataFrame:
    """(src, relation, target) of the links that notes declare."""
    return docs.select(F.col(node).alias("src"), F.inline(notes.edges(F.col(text))))


def inbound(edges: DataFrame, target: str, dst: str = "dst") -> DataFrame:
    return edges.where(F.col(dst) == target)


def broken(edges: DataFrame, nodes: DataFrame, dst: str = "dst", node: str = "node") -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col(node).alias(dst)).distinct(), dst, "left_anti")


def closure(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst", hops: int = 4) -> DataFrame:
    """(start, node, depth): what each start leads to, at its least distance, the start itself left out.

    Each round goes on for several steps from what was new in the last one and is written to shared storage, so plans
    stay short and lost executors cost no more than the round.
    """
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct()
    start = F.col(starts.columns[0])
    new = written(starts.select(start.alias("start"), start.alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    seen, depth = new, 0
    while True:
        at, found = new.where(F.col("depth") == depth), None
        for k in range(1, hops + 1):
            at = at.join(step, "node").select("start", F.col("next").alias("node")).distinct().withColumn("depth", F.lit(depth + k))
            found = at if found is None else found.unionByName(at)
        least = found.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        depth += hops
        new = written(least.join(seen, ["start", "node"], "left_anti"), "closure")
        if new.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(new)


def resolved_wikilinks(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Distinct (src, dst) between notes, links resolved by file stem (of equal stems the last path), self links left out."""
    from sextant.functions.paths import basename, strip_md

    stems = docs.groupBy(strip_md(basename(F.col(path))).alias("stem")).agg(F.max(path).alias("dst"))
    said = docs.select(F.col(path).alias("src"), F.explode(words.wikilinks(F.col(text))).alias("target")).withColumn("stem", strip_md(F.col("target")))
    return said.join(stems, "stem").where("src <> dst").select("src", "dst").distinct()


def blast_radius(edges: DataFrame, touched: DataFrame, shown: int = 5) -> DataFrame:
    """(path, dependents, more): nodes that link to the owners of a touched path, the owners left out; the first few and how many else.

    touched: path, node (owner). edges: src, dst.
    """
    owners = touched.select("path", F.col("node").alias("dst")).distinct()
    mine = owners.select("path", F.col("dst").alias("src"))
    reached = owners.join(edges.select("src", "dst"), "dst").select("path", "src").distinct().join(mine, ["path", "src"], "left_anti")
    w = Window.partitionBy("path").orderBy("src")
    first = reached.withColumn("nth", F.row_number().over(w)).groupBy("path")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("src")))), ",")
    return first.agg(names.alias("dependents"), F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
