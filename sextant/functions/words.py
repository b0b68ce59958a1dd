"""Column expressions over symbols, lines and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a word of a symbol is.
WORD = "[A-Z]+[a-z0-9]*|[a-z0-9]+"


def symbols(text: Column) -> Column:
    """Runs of capitals with what follows in lower case or digits, or of those alone; case kept."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_words(symbol: Column) -> Column:
    return F.transform(symbols(symbol), F.lower)


def keeps(word: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Whether a word is evidence: four bytes or more, not all digits, no stopword."""
    out = (F.octet_length(word) >= 4) & ~word.rlike("^[0-9]+$")
    return out & ~word.isin(*stopwords) if stopwords else out


def rare_max(n: Column, divisor: int = 20) -> Column:
    """How many groups a rare word may be in."""
    return F.greatest(F.lit(2), F.floor(n / divisor)).cast("long")


def distinctiveness(df: Column, n: Column, k: int = 20) -> Column:
    """Falls from 1 as a word is in more groups; one half where it is in as many as a rare word may be."""
    d = rare_max(n, k)
    return d / (d + df)


def rounded(x: Column, places: int = 3) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def density(definitions: Column, size: Column) -> Column:
    """Definitions per thousand bytes, rounded; null for no bytes."""
    return F.when(size > 0, rounded(definitions * 1000 / size))


def newlines(text: Column) -> Column:
    """Terminated lines."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1) with their terminators, an unfinished last line as it is; null past the end or for no range."""
    lines = F.split(text, "\n", -1)
    body = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    return F.when((start >= 1) & (end >= start) & (end <= F.size(lines)), F.when(end < F.size(lines), F.concat(body, F.lit("\n"))).otherwise(body))


def line_range(spec: Column) -> Column:
    """'start-end' as a struct; null if malformed, from zero or backwards."""
    a, b = (F.regexp_extract(spec, r"^(\d{1,9})-(\d{1,9})$", i).try_cast("int") for i in (1, 2))
    return F.when(spec.rlike(r"^\d{1,9}-\d{1,9}$") & (a >= 1) & (b >= a), F.struct(a.alias("start"), b.alias("end")))


def blob_hash(content: Column) -> Column:
    """Git's object hash of a file's content."""
    data = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def occurrences(text: Column, term: Column) -> Column:
    """Times a term occurs, without overlaps; an empty term never does."""
    return F.when(term == "", 0).otherwise((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def first_line_with(text: Column, term: Column) -> Column:
    return F.get(F.filter(F.split(text, "\n", -1), lambda x: x.contains(term)), 0)


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] in order, without what an alias shows; empty ones are left out."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != "")


def checklist(body: Column) -> tuple[Column, Column]:
    """Items of a checklist, and those that are checked."""
    total = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*- \[[ xX]\]"), F.lit(0)))
    return total, F.size(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*- \[[xX]\]"), F.lit(0)))


def next_status(total: Column, checked: Column) -> Column:
    """What a task becomes by its checklist: only a list that is there and all checked is up for review."""
    return F.when((total > 0) & (checked == total), "REVIEW").otherwise("IN-PROGRESS")


def is_automatic(status: Column) -> Column:
    """Whether a status may be set without a person."""
    return status.isin("IN-PROGRESS", "REVIEW")


def version_newer(a: Column, b: Column) -> Column:
    """Whether dotted version a is later than b; parts that are no numbers count as zero."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^[vV]", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    x, y = parts(a), parts(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0), n - F.size(v)))
    first = F.get(F.filter(F.arrays_zip(pad(x).alias("x"), pad(y).alias("y")), lambda p: p["x"] != p["y"]), 0)
    return F.coalesce(first["x"] > first["y"], F.lit(False))


def kind_for(spelling: Column, scope: Column, rules: list[tuple[str, str | None, str]]) -> Column:
    """The kind of the first rule (spelling, scope or None, kind) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for match, within, kind in reversed(rules):
        fits = spelling == match
        out = F.when(fits if within is None else fits & (scope == within), F.lit(kind)).otherwise(out)
    return out


def tag_line(name: Column, kind: Column, role: Column, span: tuple[Column, Column, Column, Column], expression: Column, most: int = 180) -> Column:
    """An occurrence as one printed line: name and kind padded to 10 and 8, role, the span's rows and columns, and the line cut at `most` bytes in backticks."""
    cut = F.regexp_replace(F.substring(expression.cast("binary"), 1, most).cast("string"), r"[ \t]+\z", "")
    return F.format_string("%-10s\t | %-8s\t%s (%d, %d) - (%d, %d) `%s`", name, kind, role, *span, cut)
