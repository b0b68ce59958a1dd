"""The test tables in the shapes that operators take, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import words
from sextant.operators import refs
from sextant.plans.storage import kept, spread
from sextant.sources import extract


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path = lang/source/doc_N.md, node = source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", "text", "lang", "source", "n_chars", path.alias("path"), F.col("source").alias("node"))


DOCS = "docs AS (SELECT doc_id, text, lang, source, n_chars, lang || '/' || source || '/doc_' || doc_id || '.md' AS path, source AS node FROM documents)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token occurrences: path, node, lang, name, role; extracted once for the documents as they are, and read from storage after."""
    return kept(table(spark, sf_dir, "documents"), "tags", lambda: extract.tokens(spread(documents(spark, sf_dir)), ["path", "node", "lang"]))


TAGS = f"""{DOCS}, tok AS (SELECT path, node, lang, unnest(regexp_extract_all(text, '{words.WORD}')) AS token FROM docs),
tags AS (SELECT path, node, lang, lower(token) AS name, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'def' ELSE 'ref' END AS role FROM tok WHERE length(token) >= 4)"""


def said(text: Column) -> Column:
    """The occurrences in a text: array of name, role and kind (call if a comma follows). White space around it changes nothing."""
    token = lambda x: F.rtrim(x, F.lit(","))
    shape = lambda x: F.struct(F.lower(token(x)).alias("name"), F.when(x.rlike("^[A-Z]"), "def").otherwise("ref").alias("role"), F.when(x.endswith(","), "call").otherwise("name").alias("kind"))
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(f"({words.WORD}),?"), F.lit(0)), lambda x: F.length(token(x)) >= 4), shape)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: path, line from 0, its trimmed text as expression."""
    each = documents(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "expression"))
    return each.select("path", "line", F.trim("expression").alias("expression"))


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line (path, node, line from 0, its trimmed text as expression) with its occurrences (name, role, kind: call if a comma follows), stored as tags are."""
    def build() -> DataFrame:
        lines = spread(documents(spark, sf_dir)).select("path", "node", F.posexplode(F.split("text", "\n", -1)).alias("line", "expression"))
        return lines.select("path", "node", "line", F.trim("expression").alias("expression"), said(F.col("expression")).alias("found"))

    return kept(table(spark, sf_dir, "documents"), "lines", build)


def placed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with their line from 0, its text, and kind: call if a comma follows."""
    return tagged_lines(spark, sf_dir).select("path", "node", "line", "expression", F.inline("found"))


def stored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference index without the lines' texts, in ranges of names: a lookup reads the row groups that can hold its name."""
    build = lambda: refs.by_name(placed_tags(spark, sf_dir))
    return kept(table(spark, sf_dir, "documents"), "sites", build)


PLACED = f"""{DOCS}, ln AS (SELECT path, node, unnest(string_split(text, chr(10))) AS expression, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs),
pt AS (SELECT path, node, line, trim(expression, ' ') AS expression, unnest(regexp_extract_all(expression, '({words.WORD}),?')) AS t FROM ln),
placed AS (SELECT path, node, line, expression, lower(rtrim(t, ',')) AS name, CASE WHEN regexp_matches(t, '^[A-Z]') THEN 'def' ELSE 'ref' END AS role,
  CASE WHEN t LIKE '%,' THEN 'call' ELSE 'name' END AS kind FROM pt WHERE length(rtrim(t, ',')) >= 4)"""


def vocabulary(spark: SparkSession, sf_dir: str, cluster: str) -> DataFrame:
    from sextant.operators import vocab

    return vocab.table(vocab.word_counts(tags(spark, sf_dir), cluster, "name"), cluster)


def vocabulary_sql(cluster: str) -> str:
    return f"""{TAGS}, vocab AS (SELECT {cluster} AS cluster, word, count(*) AS cnt FROM (SELECT {cluster}, unnest(list_transform(regexp_extract_all(name, '{words.WORD}'), lambda x: lower(x))) AS word FROM tags)
WHERE length(word) >= 4 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL),
dfs AS (SELECT word, count(*) AS df FROM vocab GROUP BY word), total AS (SELECT count(DISTINCT cluster) AS n FROM vocab),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, word) AS rank FROM vocab), tops AS (SELECT * FROM ranked WHERE rank <= 8)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path is the url without scheme and query; size in bytes; host."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return p.select("page_id", "url", "html", path.alias("path"), F.octet_length("html").cast("long").alias("size")).withColumn("host", F.substring_index("path", "/", 1))


PAGES = "pg AS (SELECT *, split_part(path, '/', 1) AS host FROM (SELECT page_id, url, html, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, CAST(strlen(html) AS BIGINT) AS size FROM pages))"


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages: src page, dst page by the href's name among urls' paths, else the href itself."""
    p = pages(spark, sf_dir)
    return p.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))


HREFS = f"{PAGES}, hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pg)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per document, with front matter, a generated region, a checklist and a link to the node of its language."""
    from sextant.functions import notes as n

    d = documents(spark, sf_dir)
    text = F.concat(
        F.lit('---\nname: "'), "path", F.lit('"\ntemplate: '), "lang", F.lit("\nstale: false\nsources:\n  - path: "), "path", F.lit("\n    hash: "), F.sha1("text"),
        F.lit("\n---\n# Note\n"), F.lit(n.START), F.lit("\n"), "text", F.lit("\n"), F.lit(n.END), F.lit("\n## Tasks\n- [x] read\n- [ ] "), "lang",
        F.lit("\n## Links\n- written in [["), "lang", F.lit("]]\n- from: [["), "source", F.lit("]]\n-near [[here]]\n - inside [[no]]\n- [[none]]\n## Notes\nend"),
    )
    return d.select("doc_id", "path", "node", "lang", "source", text.alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.col("event_type").alias("tool"), "value")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as (path, hash): later, src7 is new, src3 is gone, src5 has moved, and texts with 'und' are edited."""
    d = documents(spark, sf_dir).dropDuplicates(["path"])
    old = d.where("source <> 'src7'").select("path", words.blob_hash(F.col("text")).alias("hash"))
    moved = F.when(F.col("source") == "src5", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    edited = F.when(F.col("source") == "src5", F.col("text")).otherwise(F.replace(F.col("text"), F.lit("und"), F.lit("&")))
    new = d.where("source <> 'src3'").select(moved.alias("path"), words.blob_hash(edited).alias("hash"))
    return old, new


_HASH = "sha1('blob ' || strlen({0}) || chr(0) || {0})"
SNAPSHOTS = f"""{DOCS}, od AS (SELECT path, {_HASH.format("text")} AS hash FROM docs WHERE source <> 'src7'),
nw AS (SELECT CASE WHEN source = 'src5' THEN 'moved/' || path ELSE path END AS path, {_HASH.format("(CASE WHEN source = 'src5' THEN text ELSE replace(text, 'und', '&') END)")} AS hash FROM docs WHERE source <> 'src3'),
ch AS (SELECT coalesce(o.path, n.path) AS path, o.hash AS was, n.hash AS now FROM od o FULL JOIN nw n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash),
gone AS (SELECT was, min(path) AS old_path FROM ch WHERE now IS NULL GROUP BY was HAVING count(*) = 1), come AS (SELECT now, min(path) AS path FROM ch WHERE was IS NULL GROUP BY now HAVING count(*) = 1),
mv AS (SELECT old_path, path FROM gone JOIN come ON was = now),
diff AS (SELECT CASE WHEN was IS NULL THEN 'A' WHEN now IS NULL THEN 'D' ELSE 'M' END AS status, path, NULL::VARCHAR AS old_path FROM ch WHERE path NOT IN (SELECT path FROM mv) AND path NOT IN (SELECT old_path FROM mv)
  UNION ALL SELECT 'R', path, old_path FROM mv)"""
