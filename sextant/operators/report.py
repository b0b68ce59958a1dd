"""Verdicts, findings and the texts that are written for people: notes, indexes and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import notes
from sextant.operators import verify


def branch_verdict(branch: Column, has_remote: Column, local: Column, upstream_remote: Column, upstream_branch: Column, upstream_there: Column) -> Column:
    """keep, remove, or report and why, for a namespace by its branch's facts."""
    b = F.coalesce(branch, F.lit(""))
    tracked = (F.coalesce(upstream_remote, F.lit("")) != "") & (F.coalesce(upstream_branch, F.lit("")) != "")
    return (
        F.when(b == "", "report: no branch field")
        .when(~has_remote & local, "keep")
        .when(~has_remote, "report: gone, no remote")
        .when(tracked & upstream_there, "keep")
        .when(tracked, "remove")
        .when(local, "keep")
        .otherwise("report: gone, no upstream")
    )


def findings(rows: DataFrame) -> DataFrame:
    """(status, n) of findings; no rows mean that all is well."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def exit_code(rows: DataFrame) -> DataFrame:
    return rows.agg(F.when(F.count_if(F.col("status") == "fail") > 0, 1).otherwise(0).alias("code"))


def modules(sources: DataFrame, module: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return sources.groupBy(*by, module.alias("module")).agg(F.count(F.lit(1)).alias("files"))


def note(nodes: DataFrame, sources: DataFrame, module: Column, grounded: DataFrame | None = None) -> DataFrame:
    """(node, text): front matter, the generated region with a list of sources (by module from five on), and the preserved tail.

    nodes: node, title, summary, project, branch, built_at, commit (null: left out), crux_path and crux_lines (null: left out), body
    (already expanded; blank lines at its ends go), tail (null or empty: a fresh one). sources: node, path, hash, of which repeated
    rows count once. grounded: node, path, lines, digest, in the order of path and lines. The lists of a node
    are part of its text, so a node with all of its sources is one row.
    """
    different = sources.select("node", "path", "hash", module.alias("module")).distinct()
    listed = different.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("s"))
    rolled = modules(different, F.col("module"), ("node",)).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("module", "files"))).alias("m"))
    both = nodes.join(listed, "node", "left").join(rolled, "node", "left").join(verify.digests(different).withColumnRenamed("digest", "sources_digest"), "node", "left")
    if grounded is None:
        both = both.withColumn("g", F.array().cast("array<struct<path: string, lines: string, digest: string>>"))
    else:
        both = both.join(grounded.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("path", "lines", "digest"))).alias("g")), "node", "left")
    each = lambda c, x: F.array_join(F.transform(c, x), "")
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    given = lambda c, *x: F.when(F.col(c).isNotNull(), part(*x)).otherwise("")
    body = notes.without_blank_edges(F.col("body"))
    few = each("s", lambda x: part("- `", x["path"], "`\n"))
    many = each("m", lambda x: part("- `", x["module"], "` (", x["files"].cast("string"), ")\n"))
    text = part(
        '---\ntitle: "', F.col("title"), '"\nsummary: ', notes.quoted(F.col("summary")), "\nnode_type: sextant-node\nproject: ", F.col("project"), "\nbranch: ", F.col("branch"),
        "\nsources:\n", F.coalesce(each("s", lambda x: part("  - path: ", x["path"], "\n    hash: ", x["hash"], "\n")), F.lit("")),
        "sources_digest: ", F.coalesce("sources_digest", F.sha2(F.lit(""), 256)), '\nstale: false\nbuilt_at: "', F.col("built_at"), '"\n', given("commit", "commit: ", F.col("commit"), "\n"),
        given("crux_path", "crux_path: ", F.col("crux_path"), '\ncrux_lines: "', F.coalesce("crux_lines", F.lit("")), '"\n'),
        F.when(F.size("g") > 0, part("grounded_in:\n", each("g", lambda x: part("  - path: ", x["path"], '\n    lines: "', x["lines"], '"\n    digest: ', x["digest"], "\n")))).otherwise(""),
        "---\n\n# ", F.col("title"), f"\n{notes.START}\n\n", body, F.when(body != "", "\n").otherwise(""), "\n## Sources\n", F.coalesce(F.when(F.size("s") < 5, few).otherwise(many), F.lit("")), f"{notes.END}\n",
        F.when(F.coalesce("tail", F.lit("")) != "", F.concat("tail", F.lit("\n"))).otherwise("\n## Notes\n\n"),
    )
    return both.select("node", text.alias("text"))


def project_index(nodes: DataFrame, by: str = "namespace") -> DataFrame:
    """(namespace, text): a bullet per node with its summary, in order of the link."""
    bullet = F.concat(F.lit("- [["), "node", F.lit("]]"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" - "), "summary")).otherwise(""))
    return nodes.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(bullet)), "\n").alias("text"))


def briefs(nodes: DataFrame, sources: DataFrame, ranked: DataFrame, edges: DataFrame, shown: int = 5) -> DataFrame:
    """(node, sources, pool, links): what a writer of a node is given: its paths, its best ranked files, its links."""
    paths = sources.groupBy("node").agg(F.count(F.lit(1)).alias("sources"))
    pool = ranked.where(F.col("rank") <= shown).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), " ").alias("pool"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "dst"))), lambda x: x["dst"]), " ").alias("links"))
    return nodes.select("node").join(paths, "node", "left").join(pool, "node", "left").join(out, "node", "left").na.fill(0, ["sources"]).na.fill("", ["pool", "links"])


def push_status(lists: DataFrame, bodies: DataFrame, failed: DataFrame) -> DataFrame:
    """(number, status) of nodes to push: both a list and a body are needed; a push that failed says so."""
    both = lists.select("number", F.lit(True).alias("l")).join(bodies.select("number", F.lit(True).alias("b")), "number", "full").join(failed.select("number", F.lit(True).alias("f")), "number", "left")
    status = F.when(F.col("l").isNull(), "SKIP: no list").when(F.col("b").isNull(), "SKIP: no body").when(F.col("f"), "FAILED").otherwise("pushed")
    return both.select("number", status.alias("status"))


def compare_plan(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """(node, state) of nodes that a sync would change: new, dirty (generated text differs) or would remove."""
    both = existing.select("node", F.col("text").alias("was")).join(planned.select("node", F.col("text").alias("now")), "node", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "would remove").when(F.col("was") != F.col("now"), "dirty")
    return both.select("node", state.alias("state")).where("state is not null")


def cluster_notes(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """(node, text, dirty): a note per cluster with its sources and a link to each entity, and what people wrote after the generated region before.

    entries: node (title), slug, path, name; in the order of slug and path. existing: node, text. A note is dirty if it was not there, or up to
    the region's end was another. The entities of a cluster are part of its text, so a cluster is one row.
    """
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    each = lambda c, f: F.array_join(F.transform(c, f), "")
    listed = entries.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("slug", "path", "name"))).alias("e"))
    both = listed.join(existing.select("node", F.col("text").alias("was")), "node", "left")
    head = part('---\ntitle: "', F.col("node"), '"\nsources:\n', each("e", lambda x: part('  - slug: "', x["slug"], '"\n    path: "', x["path"], '"\n')), f"---\n\n{notes.START}\n## Entities\n")
    text = part(head, each("e", lambda x: part("- [[", x["slug"], "]] \u2014 ", x["name"], "\n")), notes.END, F.coalesce(notes.after_generated(F.col("was")), F.lit("")))
    return both.withColumn("text", text).select("node", "text", F.coalesce(notes.generated(F.col("was")) != notes.generated(F.col("text")), F.lit(True)).alias("dirty"))


def branch_facts(namespaces: DataFrame, refs: DataFrame, config: DataFrame) -> DataFrame:
    """Namespaces (namespace, branch, has_remote) with what branch_verdict asks of a repository: local, upstream_remote, upstream_branch, upstream_there.

    refs: ref (refs/heads/..., refs/remotes/...). config: key (branch.<name>.remote, branch.<name>.merge) and value; blank values count as none.
    """
    value = lambda what, name: config.where(F.col("key").startswith("branch.") & F.col("key").endswith(f".{what}") & (F.trim("value", F.lit(" \t\r\n")) != "")).groupBy(F.regexp_extract("key", rf"^branch\.(.*)\.{what}$", 1).alias("branch")).agg(F.min(F.trim("value", F.lit(" \t\r\n"))).alias(name))
    known = refs.select("ref").distinct()
    out = namespaces.join(value("remote", "upstream_remote"), "branch", "left").join(value("merge", "merge"), "branch", "left")
    out = out.withColumn("upstream_branch", F.regexp_replace("merge", "^refs/heads/", "")).drop("merge")
    out = out.withColumn("__head", F.concat(F.lit("refs/heads/"), "branch")).withColumn("__far", F.concat(F.lit("refs/remotes/"), "upstream_remote", F.lit("/"), "upstream_branch"))
    out = out.join(known.select(F.col("ref").alias("__head"), F.lit(True).alias("local")), "__head", "left").join(known.select(F.col("ref").alias("__far"), F.lit(True).alias("upstream_there")), "__far", "left")
    return out.drop("__head", "__far").na.fill(False, ["local", "upstream_there"])


def checks(facts: DataFrame, rules: list[tuple[str, str, str, str, str]], by: str = "machine") -> DataFrame:
    """(machine, check, status, detail) of preconditions over facts (machine, key, value).

    rules: check, key, pattern that the value must match, status if it does not (warn or fail), and what to do then. A fact that is
    missing does not match. Rules are configuration, tens of rows, so they are part of the plan.
    """
    keys = sorted({r[1] for r in rules})
    per = facts.where(F.col("key").isin(keys)).groupBy(by).agg(*(F.min(F.when(F.col("key") == k, F.col("value"))).alias(f"__{i}") for i, k in enumerate(keys)))
    rows = []
    for check, key, pattern, otherwise, advice in rules:
        value = F.col(f"__{keys.index(key)}")
        fits = F.coalesce(value.rlike(pattern), F.lit(False))
        rows.append(F.struct(F.lit(check).alias("check"), F.when(fits, "ok").otherwise(otherwise).alias("status"), F.when(fits, value).otherwise(F.concat(F.lit(f"{advice} ("), F.coalesce(value, F.lit("missing")), F.lit(")"))).alias("detail")))
    return facts.select(by).distinct().join(per, by, "left").select(by, F.inline(F.array(*rows)))


def drift_note(compared: DataFrame) -> DataFrame:
    """One line if a sync would change anything (compare_plan's rows), else none."""
    return compared.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.format_string("The graph is behind its sources by %d cluster(s).", "n").alias("line"))
