"""Searches over notes: by text, by front matter field, and by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions import notes, paths, words
from sextant.operators import links


def fulltext(docs: DataFrame, term: str, key: str = "node", text: str = "text") -> DataFrame:
    """(key, score, context) of documents with a term: how often, and the first line with it."""
    t = F.lit(term)
    return docs.where(F.col(text).contains(term)).select(key, words.occurrences(F.col(text), t).alias("score"), words.first_line_with(F.col(text), t).alias("context"))


def by_field(docs: DataFrame, field: str, value: str, text: str = "text") -> DataFrame:
    return docs.where(notes.field(F.col(text), field) == value)


def by_backlinks(docs: DataFrame, edges: DataFrame, term: str, key: str = "node", text: str = "text") -> DataFrame:
    """(key, score, context) of documents with a term, by how many others link to them; the best first, then by key."""
    tally = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("score"))
    found = fulltext(docs, term, key, text).select(key, "context").join(tally, key, "left")
    return found.select(key, F.coalesce("score", F.lit(0)).alias("score"), "context").orderBy(F.col("score").desc(), key)


def linking_notes(edges: DataFrame, docs: DataFrame, target: str, key: str = "node") -> DataFrame | None:
    """Notes that link to a target; None if there is no such note."""
    if docs.where(F.col(key) == target).isEmpty():
        return None
    return links.inbound(edges, target).select("src").distinct()


def mentions(edges: DataFrame) -> DataFrame:
    """(dst, mentions): how many different sources name a target, the most first."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("mentions")).orderBy(F.col("mentions").desc(), "dst")


def unsettled(docs: DataFrame, values: str, settled: tuple[str, ...], key: str = "node") -> DataFrame:
    """(key, value) of listed values outside a settled vocabulary."""
    return docs.select(key, F.explode(values).alias("value")).where(~F.col("value").isin(*settled))


def outbound(tags: DataFrame, name: str) -> DataFrame:
    """Occurrences in the files that define an entity, the definition first and references in order of line: (path, line, role, kind, name)."""
    own = tags.where((F.col("role") == "def") & (F.col("name") == name)).select("path").distinct()
    return tags.join(own, "path", "left_semi").select("path", "line", "role", "kind", "name").orderBy("path", "role", "line", "kind", "name")


def inbound(tags: DataFrame, entities: DataFrame, slug: str) -> DataFrame:
    """(slug, kind) of entities (path, slug) whose files refer to a slug, itself left out."""
    named = tags.where((F.col("role") == "ref") & (F.col("name") == slug)).select("path", "kind")
    return named.join(entities, "path").where(F.col("slug") != slug).select("slug", "kind").distinct()


def resolve(entities: DataFrame, slug: str) -> DataFrame:
    """The first path that has a slug."""
    return entities.where(F.col("slug") == slug).groupBy("slug").agg(F.min("path").alias("path"))


def dangling(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """References to slugs that no entity has: (path, name)."""
    return tags.where("role = 'ref'").select("path", "name").distinct().join(entities.select(F.col("slug").alias("name")), "name", "left_anti").select("path", "name")


def under(files: DataFrame, part: str) -> DataFrame:
    """Files whose path holds a fixed string."""
    return files.where(F.col("path").contains(part))


def dirty_sources(changed: DataFrame, sources: DataFrame, shown: int = 3) -> DataFrame:
    """The first changed paths that a node was written from."""
    return changed.select("path").distinct().join(sources.select("path"), "path", "left_semi").orderBy("path").limit(shown)


def prose_misses(docs: DataFrame, entities: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, target) of links after the front matter to slugs that no entity has, each as often as it stands there."""
    said = docs.select(F.col(path).alias("path"), F.explode(words.wikilinks(F.regexp_replace(F.col(text), r"(?s)\A---\r?\n.*?\n---\r?(?:\n|\z)", ""))).alias("target"))
    known = entities.select("slug").distinct()
    return said.withColumn("slug", paths.strip_md(F.col("target"))).join(known, "slug", "left_anti").select("path", "target")
