"""Registered queries over lists, drift, clusters, branches, checks and syntax matches, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sextant.functions import notes, paths, words
from sextant.operators import links, rank, report, search, verify, vocab
from sextant.plans import tables as t
from sextant.plans.ordering import placed
from sextant.plans.queries import _density, query
from sextant.plans.storage import shared
from sextant.sources import extract, files
from sextant.streaming import events as ev

_LISTS = f"{t.TAGS}, lists AS (SELECT DISTINCT lang AS grp, path FROM docs WHERE lang <> 'de' UNION ALL SELECT DISTINCT source, path FROM docs WHERE source IN ('src1', 'src2'))"


def _lists(spark, d):
    docs = t.documents(spark, d)
    return docs.where("lang <> 'de'").select(F.col("lang").alias("group"), "path").distinct().union(docs.where("source in ('src1', 'src2')").select("source", "path").distinct())


@query(f"WITH {_LISTS} SELECT grp, count(*) AS files FROM lists GROUP BY grp")
def list_counts(spark, d):
    return vocab.list_files(_lists(spark, d)).withColumnRenamed("group", "grp")


@query(f"WITH {_LISTS} SELECT grp, word, count(*) AS cnt FROM (SELECT grp, unnest(list_transform(regexp_extract_all(name, '{words.WORD}'), lambda x: lower(x))) AS word FROM tags JOIN lists USING (path)) WHERE length(word) >= 4 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL")
def list_words(spark, d):
    """A file's words count in each list that claims it, and unclaimed ones nowhere."""
    claimed = vocab.in_lists(t.tags(spark, d).select("path", "name"), _lists(spark, d))
    return vocab.word_counts(claimed, "group", "name").withColumnRenamed("group", "grp")


@query(f"WITH {t.DOCS}, g AS (SELECT lang || '/' || source AS grp, count(*) AS files FROM docs GROUP BY 1) SELECT grp, files, row_number() OVER (ORDER BY files DESC, grp) - 1 AS position FROM g")
def ordered_counts(spark, d):
    counted = vocab.group_files(t.documents(spark, d).withColumn("grp", paths.group_of(F.col("path"), 2)), "grp")
    return placed(counted, [F.col("files").desc(), F.col("grp")])


@query(t.vocabulary_sql("lang").join(["WITH ", " SELECT cluster AS lang, word, cnt, row_number() OVER (ORDER BY cluster, cnt DESC, word) - 1 AS position FROM vocab"]))
def ordered_words(spark, d):
    return placed(vocab.word_counts(t.tags(spark, d), "lang", "name"), [F.col("lang"), F.col("cnt").desc(), F.col("word")])


@query(
    f"WITH {t.TAGS}, dd AS (SELECT path, count(*) FILTER (role = 'def') AS defs FROM tags GROUP BY path), sc AS (SELECT lang, path, coalesce(defs, 0) AS defs, floor(coalesce(defs, 0) * 1000 / strlen(text) * 1000 + 0.5) / 1000 AS score FROM docs LEFT JOIN dd USING (path) WHERE strlen(text) > 0),"
    " x AS (SELECT * FROM (SELECT 0 AS t, 'code' AS tier, score, path FROM sc WHERE lang = 'en' ORDER BY score DESC, path LIMIT 10) UNION ALL SELECT * FROM (SELECT 1, 'dsl', CAST(defs AS DOUBLE), path FROM sc WHERE lang <> 'en' ORDER BY defs DESC, path LIMIT 10)) SELECT tier, score, path, row_number() OVER (ORDER BY t, score DESC, path) - 1 AS position FROM x"
)
def rank_listing(spark, d):
    scored = _density(spark, d)
    english = F.col("path").startswith("en/")
    return rank.listing(scored.where(english), scored.where(~english).withColumn("score", F.col("defs")), 10)


@query(f"WITH {t.PAGES}, k AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM pg) SELECT path, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem, CASE WHEN len(p) = 1 THEN '(repo root)' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END AS module FROM k")
def path_keys(spark, d):
    return t.pages(spark, d).select("path").distinct().select("path", paths.key_of(F.col("path")).alias("k")).select("path", "k.stem", "k.module")


@query("SELECT p_partkey, CASE WHEN length(p_brand) < 10 THEN rpad(p_brand, 10, ' ') ELSE p_brand END || chr(9) || ' | ' || CASE WHEN length(p_type) < 8 THEN rpad(p_type, 8, ' ') ELSE p_type END || chr(9) || 'def (' || p_size || ', 2) - (' || p_size || ', 9) `' || rtrim(substr(repeat(p_name || ' ', 20), 1, 180), ' ') || '`' AS line FROM part")
def tag_printed(spark, d):
    size = F.col("p_size")
    span = (size, F.lit(2), size, F.lit(9))
    return t.table(spark, d, "part").select("p_partkey", words.tag_line(F.col("p_brand"), F.col("p_type"), F.lit("def"), span, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(20))).alias("line"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN n_name || '|b c' WHEN 1 THEN n_name || '|it''s' WHEN 2 THEN '' ELSE NULL END AS kinds FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, '' FROM nation WHERE n_regionkey >= 3")
def list_field(spark, d):
    name = F.col("n_name")
    flow = F.concat(F.lit('kinds: ["'), name, F.lit("\", 'b c' , ]"))
    block = F.concat(F.lit('kinds:\n  - "'), name, F.lit("\"\n  - it's"))
    field = F.when(F.col("n_regionkey") == 0, flow).when(F.col("n_regionkey") == 1, block).when(F.col("n_regionkey") == 2, "kinds: plain").otherwise("other: [x]")
    text = F.concat(F.lit("---\ntitle: x\n"), field, F.lit("\nlast: [z]\n---\n- no\n"))
    return t.table(spark, d, "nation").select("n_nationkey", F.array_join(notes.list_values(text, "kinds"), "|").alias("kinds"))


_BASELINES = f"WITH {t.SNAPSHOTS}, base AS (SELECT 'c1' AS commit_id, * FROM diff UNION ALL SELECT 'c2', * FROM diff WHERE path LIKE 'en/%'), nd AS (SELECT DISTINCT source AS node, CASE WHEN source < 'src3' THEN 'c1' ELSE 'c2' END AS commit_id FROM docs), cl AS (SELECT DISTINCT source AS node, path FROM docs)"


@query(_BASELINES + " SELECT node, commit_id, count(*) FILTER (status = 'M') AS modified, count(*) FILTER (status = 'R') AS renamed, count(*) FILTER (status = 'D') AS deleted FROM cl JOIN nd USING (node) JOIN (SELECT commit_id, status, coalesce(old_path, path) AS path FROM base WHERE status IN ('M', 'R', 'D')) b USING (commit_id, path) GROUP BY ALL")
def node_drift_by_baseline(spark, d):
    changes = verify.diff(*t.snapshots(spark, d))
    both = changes.withColumn("commit", F.lit("c1")).unionByName(changes.where("path like 'en/%'").withColumn("commit", F.lit("c2")))
    docs = t.documents(spark, d)
    nodes = docs.select("node", F.when(F.col("node") < "src3", "c1").otherwise("c2").alias("commit")).distinct()
    return verify.drift_by_baseline(nodes, docs.select("node", "path"), both).withColumnRenamed("commit", "commit_id")


@query(f"WITH {t.SNAPSHOTS}, new AS (SELECT DISTINCT path, regexp_matches(path, '^en/') AND NOT regexp_matches(path, '1[.]md$') AS fits FROM diff WHERE status = 'A' AND path NOT IN (SELECT path FROM docs WHERE lang = 'fr')) SELECT CASE WHEN fits THEN 'matches the manifest' ELSE 'matches no pattern' END AS finding, count(*) AS n, CASE WHEN fits THEN '' ELSE array_to_string(list_sort(list(path))[1:5], ' ') END AS names FROM new GROUP BY fits")
def added_findings(spark, d):
    changes = verify.diff(*t.snapshots(spark, d))
    claims = t.documents(spark, d).where("lang = 'fr'")
    return verify.added_findings(changes, claims, [("English", "^en/", "1[.]md$"), ("", ".", "")])


@query(f"WITH {t.DOCS} SELECT path, target FROM docs, (VALUES ('here'), ('no'), ('none')) v(target) UNION ALL SELECT path, source FROM docs UNION ALL SELECT path, lang FROM docs WHERE lang NOT IN ('en', 'de')")
def prose_misses(spark, d):
    known = spark.createDataFrame([("en",), ("de",)], "slug string")
    return search.prose_misses(t.notes(spark, d), known)


_MARKS = f"'{notes.START}' || chr(10)", f"'{notes.END}'"
_CLUSTERS = (
    f"WITH {t.DOCS}, e AS (SELECT DISTINCT lang AS node, source AS slug, lang || '/' || source AS path, 'the ' || source AS name FROM docs), x AS (SELECT node, string_agg('  - slug: \"' || slug || '\"' || chr(10) || '    path: \"' || path || '\"' || chr(10), '' ORDER BY slug) AS s, string_agg('- [[' || slug || ']] \u2014 ' || name || chr(10), '' ORDER BY slug) AS b FROM e GROUP BY node),"
    f" y AS (SELECT node, '---' || chr(10) || 'title: \"' || node || '\"' || chr(10) || 'sources:' || chr(10) || s || '---' || chr(10) || chr(10) || {_MARKS[0]} || '## Entities' || chr(10) || b || {_MARKS[1]} AS text, s FROM x)"
)


def _clusters(spark, d):
    docs = t.documents(spark, d)
    entries = docs.select(F.col("lang").alias("node"), F.col("source").alias("slug"), F.concat_ws("/", "lang", "source").alias("path"), F.concat(F.lit("the "), "source").alias("name")).distinct()
    first = report.cluster_notes(entries, spark.createDataFrame([], "node string, text string"))
    # English and German notes stand already; people wrote below one, and the other is of an earlier state.
    was = first.where("node in ('en', 'de')").select("node", F.when(F.col("node") == "en", F.concat("text", F.lit("\nmine"))).otherwise(F.concat(F.lit("old "), "text")).alias("text"))
    return report.cluster_notes(entries, was)


@query(_CLUSTERS + " SELECT node, md5(text || CASE WHEN node = 'en' THEN chr(10) || 'mine' ELSE '' END) AS digest, node <> 'en' AS dirty FROM y")
def cluster_notes(spark, d):
    return _clusters(spark, d).select("node", F.md5("text").alias("digest"), "dirty")


@query("SELECT DISTINCT lang AS node, source AS slug, lang || '/' || source AS path FROM documents")
def cluster_sources(spark, d):
    return _clusters(spark, d).select("node", F.inline(notes.cluster_sources(F.col("text"))))


@query("SELECT n_name AS branch, n_regionkey <> 0 AS has_remote, n_regionkey < 3 AS local, CASE WHEN n_regionkey > 0 THEN 'origin' END AS upstream_remote, CASE WHEN n_regionkey > 1 THEN n_name END AS upstream_branch, n_regionkey = 2 AS upstream_there FROM nation")
def branch_facts(spark, d):
    n = t.table(spark, d, "nation")
    refs = n.where("n_regionkey < 3").select(F.concat(F.lit("refs/heads/"), "n_name").alias("ref")).union(n.where("n_regionkey <= 2").select(F.concat(F.lit("refs/remotes/origin/"), "n_name")))
    config = n.where("n_regionkey > 0").select(F.concat(F.lit("branch."), "n_name", F.lit(".remote")).alias("key"), F.lit(" origin\n").alias("value"))
    config = config.union(n.where("n_regionkey > 1").select(F.concat(F.lit("branch."), "n_name", F.lit(".merge")), F.concat(F.lit("refs/heads/"), "n_name"))).union(n.select(F.lit("core.bare"), F.lit("false")))
    return report.branch_facts(n.select(F.col("n_name").alias("branch"), (F.col("n_regionkey") != 0).alias("has_remote")), refs, config)


@query("SELECT c_custkey AS machine, 'segment' AS \"check\", CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ok' ELSE 'warn' END AS status, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'choose one (' || c_mktsegment || ')' END AS detail FROM customer UNION ALL SELECT c_custkey, 'nation', CASE WHEN c_nationkey > 9 THEN 'ok' ELSE 'fail' END, CASE WHEN c_nationkey > 9 THEN CAST(c_nationkey AS VARCHAR) ELSE 'set it (missing)' END FROM customer")
def precondition_checks(spark, d):
    c = t.table(spark, d, "customer")
    facts = c.select(F.col("c_custkey").alias("machine"), F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")).union(c.where("c_nationkey > 9").select("c_custkey", F.lit("nation"), F.col("c_nationkey").cast("string")))
    return report.checks(facts, [("segment", "segment", "^(BUILDING|MACHINERY)$", "warn", "choose one"), ("nation", "nation", "^[0-9]+$", "fail", "set it")])


@query("SELECT 'The graph is behind its sources by ' || count(*) || ' cluster(s).' AS line FROM nation WHERE n_regionkey > 2 HAVING count(*) > 0")
def drift_note(spark, d):
    n = t.table(spark, d, "nation").select(F.col("n_name").alias("node"), "n_regionkey")
    planned = n.select("node", F.lit("a").alias("text"))
    return report.drift_note(report.compare_plan(n.select("node", F.when(F.col("n_regionkey") > 2, "b").otherwise("a").alias("text")), planned))


@query(f"WITH {t.DOCS} SELECT source AS node, 'grounding' AS kind, path, '1-1' AS lines FROM docs WHERE lang = 'de' AND string_split(text, chr(10))[1] <> '' UNION ALL SELECT source, 'crux', path, '1-999999' FROM docs WHERE lang = 'en'")
def cited_evidence(spark, d):
    docs = t.documents(spark, d)
    one = F.lit(1)
    first = F.sha2(words.line_slice(F.col("text"), one, one), 256)
    cited = docs.select("node", F.lit("grounding").alias("kind"), "path", F.lit("1-1").alias("lines"), first.alias("digest")).union(docs.where("lang = 'en'").select("node", F.lit("crux"), "path", F.lit("1-999999"), first)).union(docs.select("node", F.lit("grounding"), "path", F.lit("9-1"), first))
    edited = docs.where("lang in ('en', 'de')").select("path", F.when(F.col("lang") == "de", F.regexp_replace("text", r"\A[^\n]+", "edited")).otherwise(F.col("text")).alias("content"))
    return verify.cited_evidence(cited, edited)


_MATCHES = "m AS (SELECT p_partkey AS k, p_brand AS name, p_size % 7 AS pattern, p_type AS other FROM part)"


def _matches(spark, d):
    capture = lambda text, at: F.struct(text.alias("text"), at.cast("int").alias("start"), (at + 5).cast("int").alias("end"))
    k = F.col("p_partkey")
    part = t.table(spark, d, "part")
    captures = F.create_map(F.lit("name"), capture(F.col("p_brand"), k), F.when(F.col("p_size") % 2 == 0, "definition.class").otherwise("reference.call"), capture(F.lit("x"), k), F.lit("other"), capture(F.col("p_type"), k))
    return part.select(F.lit("f").alias("path"), (F.col("p_size") % 7).alias("pattern"), captures.alias("captures"))


PATTERNS = {0: [], 1: [("eq?", ["@name", "Brand#11"])], 2: [("not-eq?", ["@name", "Brand#11"]), ("strip!", ["@doc", "x"])], 3: [("any-of?", ["@name", "Brand#12", "Brand#13"])], 4: [("not-any-of?", ["@name", "Brand#12"])], 5: [("match?", ["@name", "^B"])], 6: [("eq?", ["@name", "@missing"])]}


@query(f"WITH {_MATCHES} SELECT 'f' AS path, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN 'def' ELSE 'ref' END AS role, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'call' END AS kind, CAST(p_partkey AS INT) AS start, CAST(p_partkey + 5 AS INT) AS \"end\" FROM part WHERE p_size % 7 = 0 OR (p_size % 7 = 1 AND p_brand = 'Brand#11') OR (p_size % 7 = 2 AND p_brand <> 'Brand#11') OR (p_size % 7 = 3 AND p_brand IN ('Brand#12', 'Brand#13')) OR (p_size % 7 = 4 AND p_brand <> 'Brand#12')")
def query_tags(spark, d):
    return extract.query_tags(_matches(spark, d), PATTERNS)


@query("SELECT 'f' AS path, p_name AS name, 'def' AS role, CASE p_size % 4 WHEN 0 THEN 'function' ELSE 'var' END AS kind, CAST(p_partkey AS INT) AS start, CAST(p_partkey + 1 AS INT) AS \"end\" FROM part WHERE p_size % 4 < 2")
def local_tags(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("local.definition.func", "definition.variable", "local.definition.odd", "local.scope"))), (F.col("p_size") % 4 + 1).cast("int"))
    captures = t.table(spark, d, "part").select(F.lit("f").alias("path"), names.alias("capture"), F.col("p_name").alias("text"), F.col("p_partkey").cast("int").alias("start"), (F.col("p_partkey") + 1).cast("int").alias("end"))
    return extract.local_tags(captures, [("func", None, "function"), ("variable", None, "var"), ("odd", "elsewhere", "x")])


@query("SELECT o_orderstatus AS path, o_orderpriority AS name, 'def' AS role, 'type' AS kind, CAST(o_orderkey * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS start, CAST(o_orderkey * 10 + 3 AS BIGINT) AS \"end\" FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 UNION ALL SELECT o_orderstatus, 'queried', 'ref', 'call', CAST(o_orderkey * 10 + 2 AS BIGINT), CAST(o_orderkey * 10 + 3 AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 1")
def generated_tags(spark, d):
    """Each order is a declaring node: of even ones the name is a field, of odd ones an identifier two levels below; a query found some of the latter before."""
    o = t.table(spark, d, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"))
    k = F.col("k") * 10
    row = lambda rows, at, parent, kind, field, start, text: rows.select("path", (k + at).alias("id"), (F.lit(None).cast("long") if parent is None else k + parent).alias("parent"), F.lit(kind).alias("type"), F.lit(field).cast("string").alias("field"), (k + start).alias("start"), (k + 3).alias("end"), text.alias("text"))
    even, odd, empty = o.where("k % 2 = 0"), o.where("k % 2 = 1"), F.lit("")
    nodes = row(o, 0, None, "declaration", None, 0, empty).union(row(even, 1, 0, "word", "name", 1, F.col("text"))).union(row(even, 2, 0, "identifier", None, 0, F.lit("no"))).union(row(odd, 1, 0, "list", None, 0, empty)).union(row(odd, 2, 1, "type_identifier", None, 2, F.col("text"))).union(row(odd, 3, 1, "identifier", None, 4, F.lit("later")))
    queried = o.where("k % 3 = 0 and k % 2 = 1").select("path", F.lit("queried").alias("name"), F.lit("ref").alias("role"), F.lit("call").alias("kind"), (k + 2).alias("start"), (k + 3).alias("end"))
    return extract.generated_tags(queried, extract.walk_tags(nodes, spark.createDataFrame([("declaration", "type")], "type string, kind string")))


@query(f"WITH {t.DOCS} SELECT path, '' AS said FROM docs WHERE source = 'src4' UNION ALL SELECT DISTINCT path, 'x' FROM docs WHERE source <> 'src4'")
def extractor_cascade(spark, d):
    """Files of one source have an extractor that finds nothing, and that is their tier."""
    docs = t.documents(spark, d).select("path", "source")
    tier = lambda said: lambda files: files.select("path", F.lit(said).alias("said"))
    return extract.cascade(docs, [(F.col("source") == "src4", tier("")), (F.lit(True), tier("x"))])


@query(f"WITH {t.TAGS}, own AS (SELECT DISTINCT path, 'x' || lang AS node FROM docs WHERE source <> 'src0' UNION SELECT DISTINCT path, 'all' FROM docs WHERE source <> 'src0') SELECT own.node, name, role, count(*) AS n FROM tags JOIN own USING (path) GROUP BY ALL")
def owned_tags(spark, d):
    docs = t.documents(spark, d).where("source <> 'src0'")
    owners = docs.select("path", F.concat(F.lit("x"), "lang").alias("node")).union(docs.select("path", F.lit("all")))
    return links.owned(t.tags(spark, d).select("path", "name", "role"), owners.union(owners)).groupBy("node", "name", "role").agg(F.count(F.lit(1)).alias("n"))


_WIKI = f"WITH {t.DOCS}, x AS (SELECT doc_id, path FROM docs), s AS (SELECT 'doc_' || doc_id AS stem, max(path) AS dst FROM x GROUP BY 1), l AS (SELECT path AS src, 'doc_' || (doc_id + 1) AS stem FROM x UNION SELECT path, 'doc_' || doc_id FROM x UNION SELECT path, 'doc_0' FROM x)"


@query(_WIKI + " SELECT DISTINCT src, dst FROM l JOIN s USING (stem) WHERE src <> dst")
def resolved_wikilinks(spark, d):
    text = F.concat(F.lit("[[doc_"), (F.col("doc_id") + 1).cast("string"), F.lit(".md|next]] [[doc_"), F.col("doc_id").cast("string"), F.lit("]] [[ doc_0 ]] [[nowhere]] [[]]"))
    return links.resolved_wikilinks(t.documents(spark, d).select("path", text.alias("text")))


@query(f"WITH {t.DOCS} SELECT DISTINCT path AS src FROM docs WHERE lang = 'en'")
def linking_notes(spark, d):
    docs = t.notes(spark, d)
    targets = spark.createDataFrame([("en",), ("de",)], "node string")
    return search.linking_notes(links.declared(docs, "path").withColumnRenamed("target", "dst"), targets, "en")


@query(f"WITH {t.DOCS} SELECT doc_id, lang || '.py' AS path, '1-' || doc_id AS lines, sha1(text) AS digest FROM docs UNION ALL SELECT doc_id, 'b.py', '2-3', NULL FROM docs")
def note_groundings(spark, d):
    text = F.concat(F.lit("---\ntitle: x\ngrounded_in:\n  - path: "), "lang", F.lit('.py\n    lines: "1-'), F.col("doc_id").cast("string"), F.lit('"\n    digest: '), F.sha1("text"), F.lit('\n  - path: b.py\n    lines: 2-3\nlast: 1\n---\ngrounded_in:\n  - path: no\n'))
    return t.documents(spark, d).select("doc_id", F.inline(notes.groundings(text)))


@query(f"WITH {t.DOCS}, e AS (SELECT path AS src, 'written in' AS relation, lang AS target FROM docs UNION ALL SELECT path, 'from:', source FROM docs UNION ALL SELECT path, 'near', 'here' FROM docs) SELECT src, relation, target, row_number() OVER (ORDER BY src, relation, target) - 1 AS position FROM e")
def edges_listed(spark, d):
    return placed(links.declared(t.notes(spark, d), "path"), [F.col("src"), F.col("relation"), F.col("target")])


@query("SELECT p_name AS name, 'def' AS dir, p_type AS kind, p_brand || ':' || p_size AS site, CASE WHEN p_size > 9 THEN p_type END AS expr FROM part")
def tsv_round_trip(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("def").alias("dir"), F.col("p_type").alias("kind"), F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("site"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("expr"))
    at = f"{shared(spark)}/refs-{uuid.uuid4().hex}"
    files.write_tsv(rows, at)
    return files.refs(spark, at)


@query("SELECT event_id, user_id AS session, nth FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth % 5 = 0")
def push_due(spark, d):
    return ev.pushes(t.events(spark, d)).select("event_id", "session", "nth")


@query("SELECT n_name AS name, CASE WHEN n_regionkey > 0 AND n_nationkey % 3 > 0 THEN 'push' ELSE 'nothing' END AS action, CASE WHEN n_regionkey > 0 AND n_nationkey % 3 > 0 AND n_regionkey = 4 THEN n_name || ': push failed: no route' END AS log FROM nation")
def push_actions(spark, d):
    n = t.table(spark, d, "nation")
    return ev.push_actions(n.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, "origin/main").alias("upstream"), F.when(F.col("n_nationkey") % 3 > 0, 2).alias("ahead"), F.when(F.col("n_regionkey") == 4, "no route").alias("error")))
