"""Registered queries over notes, tool output, commits and namespaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import notes, paths, words
from sextant.operators import commits, report, search, verify
from sextant.plans import tables as t
from sextant.plans.queries import query
from sextant.sources import extract
from sextant.streaming import events as ev

_PART = "p AS (SELECT p_partkey, p_name, p_brand, p_size, p_type, CASE WHEN p_size > 25 THEN 'def' WHEN p_size > 5 THEN 'ref' ELSE 'other' END AS role FROM part)"


def _role():
    return F.when(F.col("p_size") > 25, "def").when(F.col("p_size") > 5, "ref").otherwise("other")


@query(f"WITH {_PART} SELECT p_name AS name, role, lower(p_brand) AS kind, CAST(p_size AS INT) AS line, 'of ' || p_type AS expression FROM p WHERE role <> 'other'")
def tag_lines(spark, d):
    line = F.format_string("  |%s \t| %s\t%s (%d, 2) - (9, 9) `of %s`", "p_name", F.lower("p_brand"), _role(), "p_size", "p_type")
    return extract.tag_lines(t.table(spark, d, "part").select(line.alias("line")))


@query("SELECT DISTINCT o_orderpriority AS path, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS line FROM orders UNION ALL SELECT 'a.py', NULL")
def tool_output(spark, d):
    o = t.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    lines = o.where("o_orderpriority <> '5-LOW'").select(F.lit("out").alias("file"), F.concat("o_orderpriority", F.lit("2")).alias("position"), F.concat(F.lit("\t"), "o_orderstatus").alias("line"))
    heads = o.select(F.lit("out").alias("file"), F.concat("o_orderpriority", F.lit("1")).alias("position"), F.col("o_orderpriority").alias("line")).distinct()
    odd = spark.createDataFrame([("other", "1", "\tlost"), ("other", "2", "a.py"), ("other", "3", "")], heads.schema)
    return extract.attributed(heads.unionByName(lines).unionByName(odd), "file", "position")


@query("SELECT n_name || '_definition' AS type, 'function' AS kind, '(' || n_name || '_definition name: (_) @name) @definition.function' AS pattern FROM nation UNION ALL SELECT 'CONST_' || n_nationkey || '_decl', 'constant', '(CONST_' || n_nationkey || '_decl (identifier) @name) @definition.constant' FROM nation UNION ALL SELECT 'Structure_' || n_nationkey || 'Decl', 'function', '(Structure_' || n_nationkey || 'Decl (identifier) @name) @definition.function' FROM nation UNION ALL SELECT 'ParamDecl', 'parameter', '(ParamDecl (identifier) @name) @definition.parameter' FROM nation")
def node_types(spark, d):
    pattern = '[{"type": "%s_definition", "named": true, "fields": {"name": "x"}}, {"type": "CONST_%d_decl", "named": true}, {"type": "Structure_%dDecl", "named": true}, {"type": "ParamDecl", "named": true}, {"type": "struct", "named": true}, {"type": "a_def", "named": false}]'
    return extract.node_types(t.table(spark, d, "nation").select(F.format_string(pattern, "n_name", "n_nationkey", "n_nationkey").alias("json")))


@query("SELECT p_partkey, p_brand AS field FROM part")
def declared_field(spark, d):
    content = F.concat(F.lit("/* package no; */\n/*\npackage nor;\n*/\n  package "), "p_brand", F.lit(" ;\npackage later;"))
    return t.table(spark, d, "part").select("p_partkey", extract.declared_field(content, "package", ";").alias("field"))


@query(f"WITH {t.DOCS} SELECT doc_id, path FROM docs WHERE contains(path, 'en/src1')")
def path_filter(spark, d):
    return search.under(t.documents(spark, d), "en/src1").select("doc_id", "path")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'not claimed' WHEN l_linenumber < 1 OR l_quantity < l_linenumber OR l_quantity > 45 THEN 'out of range' WHEN l_quantity - l_linenumber + 1 > 20 THEN 'too long' END AS problem FROM lineitem")
def span_checks(spark, d):
    end = F.col("l_quantity").cast("int")
    problem = notes.span_problem(F.col("l_returnflag") != "R", F.col("l_linenumber"), end, F.lit(45), 20)
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", problem.alias("problem"))


@query("SELECT p_partkey, CASE WHEN p_size >= 7 THEN 7 END AS first, CASE WHEN p_size >= 7 THEN p_size END AS last FROM part")
def line_ranges(spark, d):
    spec = words.line_range(F.concat(F.lit("7-"), F.col("p_size").cast("string")))
    return t.table(spark, d, "part").select("p_partkey", spec["start"].alias("first"), spec["end"].cast("int").alias("last"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey > 3 THEN c_mktsegment END = 'BUILDING' AND c_nationkey > 9, FALSE) AS same FROM customer")
def identity_guard(spark, d):
    remote, branch = F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")), F.when(F.col("c_nationkey") > 9, "main").otherwise("dev")
    return t.table(spark, d, "customer").select("c_custkey", verify.identity_matches(remote, branch, F.lit("BUILDING"), F.lit("main")).alias("same"))


@query(f"WITH {t.SNAPSHOTS} SELECT path FROM (SELECT DISTINCT d.path FROM diff d JOIN od USING (path) WHERE d.status = 'M') ORDER BY path LIMIT 3")
def dirty_sources(spark, d):
    old, new = t.snapshots(spark, d)
    return search.dirty_sources(verify.diff(old, new).where("status = 'M'"), old)


@query(f"WITH {t.DOCS} SELECT doc_id, lang || '.py L2-L' || (doc_id + 3) || '|none|' || source || '.py 10-20-30|bad' AS said, lang || '.py:2-' || (doc_id + 3) || ',' || source || '.py:10-30' AS spans, 'code' || doc_id || chr(10) AS fenced FROM docs")
def note_directives(spark, d):
    body = F.concat(F.lit("<!-- crux: "), "lang", F.lit(".py L2-L"), (F.col("doc_id") + 3).cast("string"), F.lit(" -->\nprose <!-- crux: none --> crux: x 1-2\n<!-- cruxes are nice --><!--\tcrux:"), "source", F.lit(".py 10-20-30-->\n<!-- crux: bad -->\n<!-- crux: open 1-2"))
    shown = F.transform(notes.spans(body, "crux"), lambda x: F.concat(x["path"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    block = F.concat(F.lit("a\n```py\ncode"), F.col("doc_id").cast("string"), F.lit("\n```\nb"))
    return t.documents(spark, d).select("doc_id", F.array_join(notes.directives(body, "crux"), "|").alias("said"), F.array_join(shown, ",").alias("spans"), notes.fenced_text(block).alias("fenced"))


_CRUX = "'## Summary' || chr(10) || 'as <!-- crux: no 1-2 --> says' || chr(10) || '## Crux' || chr(10) || {0} || chr(10) || 'see  here' || chr(10) || '## Links'"
_SHOWN = "'```md' || chr(10) || first || chr(10) || '```' || chr(10) || '— `' || path || '`:1-1'"


@query(f"WITH {t.DOCS}, f AS (SELECT *, string_split(text, chr(10))[1] AS first FROM docs) SELECT doc_id, md5(CASE WHEN source = 'src1' THEN {_CRUX.format("'_No single span carries this node''s logic._'")} ELSE {_CRUX.format(_SHOWN)} END) AS body FROM f")
def note_crux(spark, d):
    """The directive under the right heading becomes the lines it names, and groundings go."""
    said = F.when(F.col("source") == "src1", "none").otherwise(F.concat("path", F.lit(" L1-L1")))
    body = F.concat(F.lit("\n\n## Summary\nas <!-- crux: no 1-2 --> says\n## Crux\n  <!-- crux: "), said, F.lit(" -->\n <!-- grounded_in: a 1-2 -->\nsee <!-- grounded_in: b 3-4 --> here\n## Links\n \n"))
    docs = t.documents(spark, d).withColumn("body", body).withColumn("crux", notes.crux(F.col("body")))
    one = F.lit(1)
    lines = notes.crux_block(F.col("crux.span"), words.line_slice(F.col("text"), one, one), F.lit("md"))
    filled = notes.with_line(F.col("body"), F.col("crux.marker"), F.when(F.col("crux.none"), notes.NO_CRUX).otherwise(lines))
    return docs.select("doc_id", F.md5(notes.without_blank_edges(notes.without_directives(filled, "grounded_in"))).alias("body"))


@query(f"WITH {t.DOCS} SELECT doc_id, '- [x] read' || chr(10) || '- [ ] ' || lang || chr(10) AS tasks, 'end' AS notes, TRUE AS missing, source <> 'src1' AS dirty FROM docs")
def note_sections(spark, d):
    text = F.col("text")
    computed = F.when(F.col("source") == "src1", notes.body(text)).otherwise("other")
    return t.notes(spark, d).select("doc_id", notes.section(text, "Tasks").alias("tasks"), notes.section(text, "Notes").alias("notes"), notes.section(text, "No").isNull().alias("missing"), (notes.body(text) != computed).alias("dirty"))


_TREE = "commits AS (SELECT n_nationkey AS sha, CASE WHEN n_nationkey > 0 THEN n_nationkey - 1 - n_nationkey % 2 END AS parent FROM nation)"
_HISTORY = f"WITH RECURSIVE {_TREE}, h AS (SELECT sha AS tip, sha FROM commits UNION SELECT tip, parent FROM h JOIN commits USING (sha) WHERE parent IS NOT NULL AND parent >= 0)"


def _commits(spark, d):
    k = F.col("n_nationkey")
    parent = k - 1 - k % 2
    return t.table(spark, d, "nation").select(k.alias("sha"), F.when((k > 0) & (parent >= 0), parent).alias("parent"))


@query(_HISTORY + " SELECT tip, sha FROM h")
def commit_history(spark, d):
    c = _commits(spark, d)
    return commits.history(c, c.select("sha"))


@query(_HISTORY + ", x AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), c AS (SELECT a, b, (SELECT count(*) FROM h WHERE tip = a AND sha NOT IN (SELECT sha FROM h WHERE tip = b)) AS ahead, (SELECT count(*) FROM h WHERE tip = b AND sha NOT IN (SELECT sha FROM h WHERE tip = a)) AS behind FROM x) SELECT *, ahead = 0 AS is_ancestor FROM c")
def commit_left_right(spark, d):
    n = t.table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return commits.left_right(_commits(spark, d), a.join(b, "n_regionkey").where("a <> b").select("a", "b"))


@query("SELECT c_nationkey AS sha, c_nationkey < 20 AS there FROM (SELECT DISTINCT c_nationkey FROM customer)")
def commit_exists(spark, d):
    return commits.exists(_commits(spark, d).where("sha < 20"), t.table(spark, d, "customer").select(F.col("c_nationkey").alias("sha")).distinct())


def _entities(spark, d):
    return t.documents(spark, d).select("path", paths.stem(F.col("path")).alias("slug"))


_LINKED = f"{t.PLACED}, first AS (SELECT path, line, role, kind, name FROM placed WHERE path IN (SELECT path FROM placed WHERE role = 'def' AND name = 'that'))"


@query(f"WITH {_LINKED} SELECT path, CAST(line AS INT) AS line, role, kind, name FROM first")
def entity_outbound(spark, d):
    return search.outbound(t.placed_tags(spark, d), "that").withColumn("line", F.col("line").cast("int"))


@query(f"WITH {t.PLACED} SELECT DISTINCT 'doc_' || regexp_extract(path, 'doc_(\\d+)', 1) AS slug, kind FROM placed WHERE role = 'ref' AND name = 'that'")
def entity_inbound(spark, d):
    return search.inbound(t.placed_tags(spark, d), _entities(spark, d), "that")


@query(f"WITH {t.DOCS} SELECT 'doc_1' AS slug, min(path) AS path FROM docs WHERE path LIKE '%/doc_1.md'")
def resolve_slug(spark, d):
    return search.resolve(_entities(spark, d), "doc_1")


@query(f"WITH {t.PLACED}, defined AS (SELECT DISTINCT name FROM placed WHERE role = 'def') SELECT path, count(*) AS n FROM (SELECT DISTINCT path, name FROM placed WHERE role = 'ref' AND name NOT IN (SELECT name FROM defined)) GROUP BY path")
def dangling_refs(spark, d):
    tags = t.placed_tags(spark, d)
    defined = tags.where("role = 'def'").select(F.col("name").alias("slug")).distinct()
    return search.dangling(tags, defined).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'This repository has ' || count(*) || ' nodes.' AS line FROM nation")
def context_line(spark, d):
    return ev.context_line(t.table(spark, d, "nation"), True)


@query("SELECT DISTINCT source || '@' || lang AS namespace FROM documents WHERE source || '@' || lang <> 'src1@en'")
def namespace_catalogue(spark, d):
    names = t.documents(spark, d).select(F.concat_ws("@", "source", "lang").alias("namespace")).distinct()
    return ev.catalogue(names, "src1@en")


@query("SELECT CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 1 ELSE 0 END AS code FROM orders")
def exit_code(spark, d):
    return report.exit_code(t.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok").alias("status")))
