"""Staleness of nodes, drift against diffs, and whether quoted lines still are where notes say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths, words


def digests(sources: DataFrame, node: str = "node") -> DataFrame:
    """(node, digest): SHA-256 over the node's sorted `path:hash` lines, whatever the order of its rows."""
    line = F.concat_ws(":", "path", "hash")
    return sources.groupBy(node).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def staleness(nodes: DataFrame, sources: DataFrame, current: DataFrame) -> DataFrame:
    """(node, status) by the first of the questions that settles it.

    nodes: node, present, stored (digest or null). sources: node, path. current: path, hash (null: there
    but could not be hashed). Paths that current lacks are gone.
    """
    now = sources.select("node", "path").join(current.select("path", "hash", F.lit(True).alias("there")), "path", "left")
    per = now.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("path")))), " ").alias("gone"),
        F.count_if(F.col("there") & F.col("hash").isNull()).alias("unhashed"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("path"), F.lit(":"), F.col("hash")))), "\n"), 256).alias("digest"),
    )
    status = (
        F.when(~F.col("present"), "node file missing")
        .when(F.coalesce("stored", F.lit("")) == "", "no digest")
        .when(F.col("n").isNull(), "no sources listed")
        .when(F.col("gone") != "", F.concat(F.lit("source files gone: "), "gone"))
        .when(F.col("unhashed") > 0, "hashing failed")
        .when(F.col("digest") != F.col("stored"), "content changed")
        .otherwise("clean")
    )
    return nodes.join(per, "node", "left").select("node", status.alias("status"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, path, old_path) between snapshots of path and hash: M, A, D, and R for a path whose content went to a new one.

    A content that left one path and came to one path is a rename; others stay deletions and additions.
    """
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full")
    changed = both.where(~F.col("was").eqNullSafe(F.col("now")))
    gone = changed.where("now is null").groupBy("was").agg(F.min("path").alias("old_path"), F.count(F.lit(1)).alias("n")).where("n = 1").select("was", "old_path")
    come = changed.where("was is null").groupBy("now").agg(F.min("path").alias("new_path"), F.count(F.lit(1)).alias("n")).where("n = 1").select("now", "new_path")
    moved = gone.join(come, gone["was"] == come["now"]).select("old_path", F.col("new_path").alias("path"))
    rest = changed.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    status = F.when(F.col("was").isNull(), "A").when(F.col("now").isNull(), "D").otherwise("M")
    return rest.select(status.alias("status"), "path", F.lit(None).cast("string").alias("old_path")).unionByName(moved.select(F.lit("R").alias("status"), "path", "old_path"))


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(status, path, old_path) of tab-separated name-status lines; copies and other states are ignored."""
    parts = F.split(F.regexp_replace(F.col(line), r"\r$", ""), "\t")
    kind = F.substring(F.get(parts, 0), 1, 1)
    path = F.when(kind == "R", F.get(parts, 2)).otherwise(F.get(parts, 1))
    return lines.select(kind.alias("status"), path.alias("path"), F.when(kind == "R", F.get(parts, 1)).alias("old_path")).where(F.col("status").isin("M", "D", "R", "A") & F.col("path").isNotNull())


def drift(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, modified, renamed, deleted) of nodes with any: changes of claimed paths, renames by their old path."""
    known = changes.where(F.col("status").isin("M", "R", "D")).select("status", F.coalesce("old_path", "path").alias("path"))
    met = claims.select("node", "path").distinct().join(known, "path")
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return met.groupBy("node").agg(n("M", "modified"), n("R", "renamed"), n("D", "deleted"))


def added_unclaimed(changes: DataFrame, claims: DataFrame) -> DataFrame:
    return changes.where("status = 'A'").select("path").join(claims.select("path"), "path", "left_anti")


def churn(changed: DataFrame, node: str = "node") -> DataFrame:
    """(node, ratio, triage): added and deleted lines against all lines; above 15 % a rebuild pays."""
    ratio = F.sum(F.col("added") + F.col("deleted")) / F.sum("lines")
    return changed.groupBy(node).agg(words.rounded(ratio).alias("ratio")).withColumn("triage", F.when(F.col("ratio") > 0.15, "rebuild").otherwise("patch"))


def groundings(quoted: DataFrame, files: DataFrame) -> DataFrame:
    """quoted (node, path, first, last, digest) with status and where the lines are now: unchanged, moved (now), changed or gone.

    files: path, content. Lines that moved are sought in the file with a window of the quoted length; the first that fits counts.
    """
    both = quoted.join(files.select("path", "content"), "path", "left").withColumn("here", F.sha2(words.line_slice(F.col("content"), F.col("first"), F.col("last")), 256))
    # The file is split once; windows are hashed only where the quoted place no longer holds the lines.
    sought = F.col("content").isNotNull() & (F.coalesce("here", F.lit("")) != F.col("digest"))
    parts = F.split(F.when(sought, F.col("content")), "\n", -1)
    ended = lambda x, i: F.when(i < F.size("__parts") - 1, F.concat(x, F.lit("\n"))).otherwise(x)
    cut = both.withColumn("__parts", parts).withColumn("__lines", F.filter(F.transform("__parts", ended), lambda x: x != "")).withColumn("__span", F.col("last") - F.col("first") + 1)
    starts = F.when(F.size("__lines") >= F.col("__span"), F.sequence(F.lit(1), F.size("__lines") - F.col("__span") + 1))
    window = lambda i: F.array_join(F.slice("__lines", i, F.col("__span")), "")
    checked = cut.withColumn("now", F.get(F.filter(starts, lambda i: F.sha2(window(i), 256) == F.col("digest")), 0))
    status = F.when(F.col("content").isNull(), "gone").when(F.col("here") == F.col("digest"), "unchanged").when(F.col("now").isNotNull(), "moved").otherwise("changed")
    return checked.select("node", "path", "first", "last", status.alias("status"), "now")


def identity_matches(remote, branch, current_remote, current_branch):
    """Whether an index belongs to this remote and branch; what is absent matches nothing."""
    return F.coalesce((remote == current_remote) & (branch == current_branch), F.lit(False))


def drift_by_baseline(nodes: DataFrame, claims: DataFrame, changes: DataFrame) -> DataFrame:
    """drift of each node against the diff from its own baseline. nodes: node, commit. changes: commit, status, path, old_path; a diff is read once however many nodes share it."""
    known = changes.where(F.col("status").isin("M", "R", "D")).select("commit", "status", F.coalesce("old_path", "path").alias("path"))
    mine = claims.select("node", "path").distinct().join(nodes.select("node", "commit"), "node")
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return mine.join(known, ["commit", "path"]).groupBy("node", "commit").agg(n("M", "modified"), n("R", "renamed"), n("D", "deleted"))


def added_findings(changes: DataFrame, claims: DataFrame, manifest: list[tuple[str, str, str]] | None, shown: int = 5) -> DataFrame:
    """(finding, n, names): how many added paths no node claims, by whether a manifest row (title, include, exclude) takes them.

    Without a manifest there is one finding. Those that no row takes come with the first few names. Findings without paths are left out.
    """
    new = added_unclaimed(changes, claims).distinct()
    if manifest is None:
        return new.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("no manifest").alias("finding"), "n", F.lit("").alias("names"))
    takes = F.lit(False)
    for title, include, exclude in manifest:
        if title:
            takes = takes | (F.col("path").rlike(paths.posix(include)) & (~F.col("path").rlike(paths.posix(exclude)) if exclude else F.lit(True)))
    sorted_new = new.withColumn("finding", F.when(takes, "matches the manifest").otherwise("matches no pattern"))
    first = sorted_new.withColumn("__nth", F.row_number().over(Window.partitionBy("finding").orderBy("path"))).where(F.col("__nth") <= shown)  # pruned before the shuffle
    names = first.where("finding = 'matches no pattern'").groupBy("finding").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("names"))
    return sorted_new.groupBy("finding").agg(F.count(F.lit(1)).alias("n")).join(names, "finding", "left").na.fill("", ["names"])


def cited_evidence(cited: DataFrame, edited: DataFrame) -> DataFrame:
    """(node, kind, path, lines) of quotes of edited files that no longer are what was recorded.

    cited: node, kind (crux or grounding), path, lines (a-b), digest. edited: path, content. Malformed ranges say nothing, and lines past the end are empty.
    """
    span = words.line_range(F.col("lines"))
    met = cited.withColumn("__span", span).where(F.col("__span").isNotNull()).join(edited.select("path", "content"), "path")
    now = F.sha2(F.coalesce(words.line_slice(F.col("content"), F.col("__span.start"), F.col("__span.end")), F.lit("")), 256)
    return met.where(now != F.col("digest")).select("node", "kind", "path", "lines")
