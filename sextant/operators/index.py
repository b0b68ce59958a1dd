"""The reverse index from paths to nodes, selection of paths by manifests, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.plans.ordering import numbered


def reverse(claims: DataFrame) -> DataFrame:
    """(path, nodes): the ascending distinct nodes of each path; claims with an empty side or a line break are refused."""
    bad = (F.col("path") == "") | (F.col("node") == "") | F.col("path").contains("\n") | F.col("node").contains("\n")
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("refused claim on "), F.coalesce("path", F.lit("nothing"))))).otherwise(F.col("node"))
    nodes = claims.select("path", checked.alias("node")).groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return nodes.withColumn("nodes", F.when(F.size("nodes") > 255, F.raise_error(F.concat(F.lit("over 255 nodes claim "), "path"))).otherwise(F.col("nodes")))


def lookup(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("path") == path).select(F.explode("nodes").alias("node"))


def node_names(index: DataFrame) -> DataFrame:
    return index.select(F.explode("nodes").alias("node")).distinct()


def add_unassigned(unassigned: DataFrame, new: DataFrame) -> DataFrame:
    """(pos, path) with the new paths that are not there yet after the others, in order of path."""
    fresh = new.select("path").distinct().join(unassigned, "path", "left_anti")
    last = unassigned.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    placed = numbered(fresh, ["path"], "__nth").join(F.broadcast(last)).select((F.col("last") + F.col("__nth") + 1).alias("pos"), "path")  # one row
    return unassigned.select("pos", "path").unionByName(placed)


def select_paths(files: DataFrame, manifest: list[tuple[int, str, str, str]]) -> DataFrame:
    """(ord, title, path) of files that each manifest row (ord, title, include, exclude) takes; an empty exclude leaves out nothing.

    A manifest is configuration, tens of rows, so its patterns are part of the plan: files are read once and nothing is joined.
    """
    rows = []
    for order, title, include, exclude in manifest:
        takes = F.col("path").rlike(paths.posix(include))
        if exclude:
            takes &= ~F.col("path").rlike(paths.posix(exclude))
        rows.append(F.when(takes, F.struct(F.lit(order).alias("ord"), F.lit(title).alias("title"))))
    return files.select("path", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("m.ord", "m.title", "path")


def unassigned(files: DataFrame, claimed: DataFrame) -> DataFrame:
    return files.select("path").join(claimed.select("path"), "path", "left_anti")


def coverage(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """(covered, unassigned) counts of distinct paths."""
    mine = claimed.select("path").distinct().withColumn("mine", F.lit(True))
    return files.select("path").distinct().join(mine, "path", "left").agg(F.count("mine").alias("covered"), F.count_if(F.col("mine").isNull()).alias("unassigned"))


def total_files(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """How many files there are, or distinct claimed ones if files are not listed."""
    listed, other = files.agg(F.count(F.lit(1)).alias("n")), claimed.agg(F.count_distinct("path").alias("m"))
    return listed.join(F.broadcast(other)).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("m")).alias("total"))


def nearest_ancestor(rows: DataFrame, rules: DataFrame, path: str = "path", directory: str = "dir") -> DataFrame:
    """rows with the columns of the rule for the deepest directory above their path; rows without one are left out."""
    # Rows are told apart by number, so that repeated ones each stay; directories are as deep as their place among the ancestors.
    numbered_rows = rows.withColumn("__row", F.monotonically_increasing_id())
    up = numbered_rows.select(F.struct(*(f"`{c}`" for c in rows.columns)).alias("__all"), "__row", F.explode(F.array_compact(paths.ancestors(F.col(path)))).alias("__up"))
    other = [c for c in rules.columns if c != directory]
    met = up.join(rules.select(F.col(directory).alias("__up"), F.struct(F.col(directory), *other).alias("__rule")), "__up")
    best = met.groupBy("__row").agg(F.max_by(F.struct("__all", "__rule"), F.length("__up")).alias("x"))
    return best.select("x.__all.*", "x.__rule.*")


def boundaries(files: DataFrame, path: str = "path") -> DataFrame:
    """(boundary, path): the shallowest directory above each file that holds a file itself.

    Directories whose name begins with _ or . are left out with all in them, and so are files at the root.
    """
    p = F.col(path)
    usable = files.where(p.contains("/") & ~paths.dir_of(p).rlike(r"(^|/)[._]")).select(p.alias("path"))
    direct = usable.select(paths.dir_of(F.col("path")).alias("dir")).distinct()
    up = usable.select("path", F.explode(F.array_compact(paths.ancestors(F.col("path")))).alias("dir"))
    return up.join(direct, "dir").groupBy("path").agg(F.min_by("dir", F.length("dir")).alias("boundary")).select("boundary", "path")


def plan(files: DataFrame, path: str = "path") -> DataFrame:
    """(boundary, slug, path, ingested): the first path of each slug (file stem) counts, others collide with it."""
    slugged = boundaries(files, path).withColumn("slug", paths.stem(F.col("path")))
    w = Window.partitionBy("slug").orderBy("path")
    return slugged.withColumn("ingested", F.row_number().over(w) == 1)


def reconcile(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Existing nodes that are not planned."""
    return existing.select("node").distinct().join(planned.select("node"), "node", "left_anti")
