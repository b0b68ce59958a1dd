"""Column expressions over notes: Markdown with a YAML front matter and a generated region between fences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<!-- sextant:generated:start -->", "<!-- sextant:generated:end -->"


def frontmatter(text: Column) -> Column:
    """What stands between the first two lines of three dashes, empty if the text does not begin with one."""
    return F.regexp_extract(text, r"(?sm)\A---\r?\n(.*?)(?:\r?\n)?^---\r?$", 1)


def raw_field(text: Column, key: str) -> Column:
    """A field's value as written; null if it is not there."""
    pattern = rf"(?m)^{re.escape(key)}:[ \t]*(.*?)[ \t\r]*$"
    block = frontmatter(text)
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, 1))


def field(text: Column, key: str) -> Column:
    """A field's value without one quote at either end, escapes as they are."""
    return F.regexp_replace(raw_field(text, key), '^"|"$', "")


def scalar(text: Column, key: str) -> Column:
    """A field's value without its quotes and with \\\\ and \\" undone."""
    raw = raw_field(text, key)
    inner = F.regexp_extract(raw, r'(?s)^"(.*)"$', 1)
    return F.when(raw.rlike(r'(?s)^".*"$'), F.regexp_replace(inner, r'\\(["\\])', "$1")).otherwise(raw)


def quoted(value: Column) -> Column:
    """A YAML double-quoted scalar."""
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def root_keys(text: Column) -> Column:
    return F.regexp_extract_all(frontmatter(text), F.lit(r"(?m)^([A-Za-z_][\w-]*):"), F.lit(1))


def body(text: Column, start: str = START, end: str = END) -> Column:
    """The generated region, else all after the front matter."""
    fenced = rf"(?s){re.escape(start)}\n?(.*?){re.escape(end)}"
    return F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---\r?(?:\n|\z)", ""))


def tail(text: Column, end: str = END) -> Column:
    """What people wrote after the generated region, from its end mark on; empty without one."""
    at = F.locate(end, text)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def section(text: Column, heading: str, end: str = END) -> Column:
    """Text under a line that is exactly `## heading`, up to the next such heading or the generated region's end; null without the heading."""
    pattern = rf"(?msd)^## {re.escape(heading)}\r*$\n?(.*?)(?=^## |^{re.escape(end)}\r*$|\z)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def block_items(text: Column, block: str) -> Column:
    """Lines of a front matter block (`block:` and what is indented or listed under it)."""
    return F.regexp_extract(frontmatter(text), rf"(?m)^{re.escape(block)}:[ \t]*\r?\n((?:(?:[ \t]+.*|- .*|\r?)(?:\n|\z))*)", 1)


def entries(text: Column, block: str, keys: tuple[str, ...]) -> Column:
    """The `- ...` entries of a block as structs of the keys' values, without quotes (null if an entry lacks one)."""
    items = F.filter(F.split(F.concat(F.lit("\n"), block_items(text, block)), r"\n[ \t]*- "), lambda x: x.rlike(r"\S"))
    value = lambda x, k: F.when(x.rlike(rf"(?m)^[ \t]*{k}:"), F.regexp_extract(x, rf'(?m)^[ \t]*{k}:[ \t]*"?(.*?)"?[ \t\r]*$', 1))
    return F.transform(items, lambda x: F.struct(*(value(x, k).alias(k) for k in keys)))


def sources(text: Column) -> Column:
    return entries(text, "sources", ("path", "hash"))


def groundings(text: Column) -> Column:
    return entries(text, "grounded_in", ("path", "lines", "digest"))


def edges(text: Column, heading: str = "Links") -> Column:
    """(relation, target) of `- relation [[target]]` lines under a heading, up to the next other one.

    The dash stands first in its line, blanks after it may be missing, the relation is what stands before the brackets as it
    is, and lines without a relation or target are none.
    """
    here = rf"(?msd)^## {re.escape(heading)}\r*$\n?(.*?)(?=^## (?!{re.escape(heading)}\r*$)|\z)"
    line = r"(?md)^-[ \t]*((?:(?!\[\[)[^\n])*?)[ \t]*\[\[((?:(?!\]\])[^\n])*)\]\]"
    lines = F.regexp_extract_all(F.regexp_extract(text, here, 1), F.lit(line), F.lit(0))
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("relation"), F.regexp_extract(x, line, 2).alias("target")))
    return F.coalesce(F.filter(found, lambda x: (x["relation"] != "") & (x["target"] != "")), F.array().cast("array<struct<relation: string, target: string>>"))


def directives(text: Column, keyword: str) -> Column:
    """What `<!-- keyword: ... -->` comments say, in their order, without blanks at either end."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<!--(?=[ \t]*{re.escape(keyword)}:(.*?)-->)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\A[ \t]+|[ \t]+\z", ""))


def span(said: Column) -> Column:
    """(path, start, end) of `path a-b`, else null. An L in the range is passed over, and a range of three bounds is from the first to the last."""
    whole = r"(?s)\A([^ \t]+)[ \t](?:.*[ \t])?([^ \t]{0,64})\z"
    bounds = F.regexp_replace(F.regexp_extract(said, whole, 2), "L", "")
    start, end = F.regexp_extract(bounds, r"\A([0-9]+)-", 1), F.regexp_extract(bounds, r"-([0-9]+)\z", 1)
    right = said.rlike(whole) & start.try_cast("int").isNotNull() & end.try_cast("int").isNotNull()
    return F.when(right, F.struct(F.regexp_extract(said, whole, 1).alias("path"), start.try_cast("int").alias("start"), end.try_cast("int").alias("end")))


def spans(text: Column, keyword: str) -> Column:
    """The well-formed spans of a keyword's directives."""
    return F.array_compact(F.transform(directives(text, keyword), span))


def crux(text: Column, heading: str = "Crux", keyword: str = "crux") -> Column:
    """(none, span, marker): what the first directive under the heading says: no span on purpose, or which; null without one. marker: the whole comment."""
    under = section(text, heading)
    marker = F.regexp_extract(under, rf"(?s)<!--[ \t]*{re.escape(keyword)}:(?:(?!-->).)*-->", 0)
    said = F.get(directives(under, keyword), 0)
    return F.when(said.isNotNull(), F.struct((said == "none").alias("none"), F.when(said != "none", span(said)).alias("span"), marker.alias("marker")))


#: What a crux of no span becomes: fixed text of notes.
NO_CRUX = "_No single span carries this node's logic._"


def crux_block(span: Column, lines: Column, language: Column) -> Column:
    """The fenced lines of a span, and where they come from."""
    ended = F.when((lines == "") | lines.endswith("\n"), lines).otherwise(F.concat(lines, F.lit("\n")))
    return F.concat(F.lit("```"), language, F.lit("\n"), ended, F.lit("```\n— `"), span["path"], F.lit("`:"), span["start"].cast("string"), F.lit("-"), span["end"].cast("string"), F.lit("\n"))


def with_line(text: Column, marker: Column, replacement: Column) -> Column:
    """The text with the whole first line that holds the marker replaced (without the replacement's last line feeds)."""
    at = F.locate(marker, text) if isinstance(marker, str) else F.instr(text, marker)
    before = F.substring(text, F.lit(1), at - 1)
    keep = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    end = F.length(text) - at + 1
    after = F.substring(text, at, end)
    tail = F.substring(after, F.length(F.substring_index(after, "\n", 1)) + 1, end)
    return F.when(at > 0, F.concat(F.substring(before, F.lit(1), keep), F.regexp_replace(replacement, r"\n+\z", ""), tail)).otherwise(text)


def span_problem(claimed: Column, start: Column, end: Column, lines: Column, most: int) -> Column:
    """What is wrong with a span of a claimed file, or null."""
    return F.when(~claimed, "not claimed").when((start < 1) | (end < start) | (end > lines), "out of range").when(end - start + 1 > most, "too long")


def set_stale(text: Column) -> Column:
    """The text with `stale: true` in its front matter, put there if it is not; texts without one stay as they are."""
    has = frontmatter(text).rlike("(?m)^stale:")
    return F.when(frontmatter(text) == "", text).when(has, F.regexp_replace(text, r"(?s)\A(---\r?\n(?:(?!\n---).)*?(?:(?<=\n)))stale:[^\n]*", "$1stale: true")).otherwise(F.regexp_replace(text, r"(?s)\A(---\r?\n.*?\n)(---)", "$1stale: true\n$2"))


def fenced_text(text: Column) -> Column:
    """The insides of code blocks, joined."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?ms)^```[^\n]*\n(.*?)^```"), F.lit(1)), "")


def without_directives(text: Column, keyword: str) -> Column:
    """The text without a keyword's directives: a line that is one goes, one within a line is cut out of it."""
    one = rf"<!--[ \t]*{re.escape(keyword)}:(?:(?!-->)[^\n])*-->"
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(rf"\A[ \t]*{one}[ \t]*\z"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, one, "")), "\n")


def without_blank_edges(text: Column) -> Column:
    """The text without blank lines at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:[ \t\r]*\n)+", ""), r"(?:(?:\n|\A)[ \t\r]*)+\z", "")


def list_values(text: Column, key: str) -> Column:
    """The values of a front matter list of plain strings, in brackets on the key's line or a dash each below it, without quotes; empty without one."""
    block = frontmatter(text)
    inline = F.regexp_extract(block, rf"(?m)^{re.escape(key)}: *([^\n]*?) *$", 1)
    below = F.regexp_extract(block, rf"(?m)^{re.escape(key)}: *\n((?: *(?:- [^\n]*|[ \t][^\n]*)?(?:\n|\z))*)", 1)
    flow = F.filter(F.transform(F.split(F.regexp_extract(inline, r"^\[ *(.*?) *\]$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.transform(F.filter(F.split(below, "\n"), lambda x: F.ltrim(x).startswith("- ")), lambda x: F.trim(F.substring(F.ltrim(x), 3, 1 << 30)))
    plain = lambda x: F.when(x.rlike(r"""(?s)\A(["']).*\1\z""") & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(F.when(inline != "", flow).otherwise(listed), plain)


def cluster_sources(text: Column) -> Column:
    """(slug, path) of a cluster note's sources: pairs of lines whose values stand in double quotes; others are left out."""
    lines = F.filter(F.split(block_items(text, "sources"), "\n"), lambda x: F.trim(x) != "")
    after = lambda x, k: F.when(x.rlike(rf'{k}: *".*" *$'), F.regexp_extract(x, rf'{k}: *"(.*)" *$', 1))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(after(F.get(lines, i), "slug").alias("slug"), after(F.get(lines, i + 1), "path").alias("path")))
    return F.filter(pairs, lambda p: p["slug"].isNotNull() & p["path"].isNotNull())


def generated(text: Column, end: str = END) -> Column:
    """The note up to its generated region's end mark; all of it without one."""
    at = F.locate(end, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at + len(end) - 1)).otherwise(text)


def after_generated(text: Column, end: str = END) -> Column:
    """What people wrote after the generated region, without its end mark."""
    at = F.locate(end, text)
    return F.when(at > 0, F.substring(text, at + len(end), F.length(text))).otherwise("")
