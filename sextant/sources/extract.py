"""Symbol occurrences from texts: extractors behind one shape, and parsers of what other tools print."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths, words

Extractor = Callable[[DataFrame], DataFrame]  # files (path, text) to path, name, role, kind, line, expression

#: Declarations by language: pattern with the name as its only group, and kind.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "python": [(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"^\s*class\s+([A-Za-z_]\w*)", "class")],
    "java": [(r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", "class"), (r"^\s*(?:public|protected|private|static|final|abstract|synchronized|\s)+[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\([^;]*\{", "method")],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "function"), (r"^type\s+([A-Za-z_]\w*)", "type")],
    "rust": [(r"\bfn\s+([A-Za-z_]\w*)", "function"), (r"\b(?:struct|enum|trait|type)\s+([A-Za-z_]\w*)", "type")],
    "javascript": [(r"\bfunction\s+([A-Za-z_$][\w$]*)", "function"), (r"\bclass\s+([A-Za-z_$][\w$]*)", "class")],
    "typescript": [(r"\bfunction\s+([A-Za-z_$][\w$]*)", "function"), (r"\b(?:class|interface|enum|type)\s+([A-Za-z_$][\w$]*)", "class")],
    "ocaml": [(r"^\s*let\s+(?:rec\s+)?([a-z_][\w']*)", "function"), (r"^\s*(?:type|module)\s+([A-Za-z_][\w']*)", "type")],
    "zig": [(r"\bfn\s+([A-Za-z_]\w*)", "function"), (r"^\s*(?:pub\s+)?const\s+([A-Za-z_]\w*)\s*=\s*(?:struct|enum|union)", "type")],
    "ruby": [(r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", "method"), (r"^\s*(?:class|module)\s+([A-Z]\w*)", "class")],
}
CALL = r"([A-Za-z_$][\w$]*)\s*\("


def tokens(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Every symbol of four bytes or more as an occurrence: capitalised ones define, others refer."""
    each = files.select(*keep, F.explode(words.symbols(F.col(text))).alias("token")).where(F.octet_length("token") >= 4)
    return each.select(*keep, F.lower("token").alias("name"), F.when(F.col("token").rlike("^[A-Z]"), "def").otherwise("ref").alias("role"))


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("path", paths.language(F.col("path")).alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("line", "expression"))


def declarations(files: DataFrame, rules: dict[str, list[tuple[str, str]]] = DECLARATIONS) -> DataFrame:
    """Declarations and calls by line patterns of the path's language; lines count from 0. Files without rules give none.

    This stands in for grammars: it reads lines and not syntax trees, so it misses declarations over several lines.
    """
    found = [F.array().cast("array<struct<name: string, role: string, kind: string>>")]
    struct = lambda name, role, kind: F.struct(name.alias("name"), F.lit(role).alias("role"), F.lit(kind).alias("kind"))
    for language, patterns in rules.items():
        here = F.col("language") == language
        for pattern, kind in patterns:
            name = F.regexp_extract("expression", pattern, 1)
            found.append(F.when(here & (name != ""), F.array(struct(name, "def", kind))).otherwise(F.array()))
        calls = F.transform(F.regexp_extract_all("expression", F.lit(CALL), F.lit(1)), lambda n: struct(n, "ref", "call"))
        found.append(F.when(here, calls).otherwise(F.array()))
    every = _numbered(files).select("path", "line", F.trim("expression").alias("expression"), F.concat(*found).alias("found"))
    defined = F.transform(F.filter("found", lambda t: t["role"] == "def"), lambda t: t["name"])
    rows = every.withColumn("defined", defined).select("path", "line", "expression", F.explode(F.filter("found", lambda t: (t["role"] == "def") | ~F.array_contains(F.col("defined"), t["name"]))).alias("t"))
    return rows.select("path", "t.name", "t.role", "t.kind", "line", "expression")


def cascade(files: DataFrame, tiers: list[tuple[Column, Extractor]]) -> DataFrame:
    """Occurrences from the first tier whose condition a file meets."""
    taken, out = F.lit(False), None
    for condition, extractor in tiers:
        part = extractor(files.where(condition & ~taken))
        out = part if out is None else out.unionByName(part)
        taken = taken | condition
    return out


def tag_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Occurrences from tab-separated lines: name, kind, then role, position in brackets and an expression in backticks. Others are dropped."""
    parts = F.split(F.col(line), "\t")
    clean = lambda c: F.regexp_replace(c, r"^[ \t|]+|[ \t]+$", "")
    rest = F.get(parts, 2)
    row = F.regexp_extract(rest, r"^[^(]*\([ \t]*(\d+)[ \t]*,", 1).try_cast("int")
    expression = F.coalesce(F.nullif(F.regexp_extract(rest, "`(.*)`", 1), F.lit("")), F.regexp_extract(rest, "`([^`]*)$", 1))
    out = lines.select(clean(F.get(parts, 0)).alias("name"), F.substring_index(rest, " ", 1).alias("role"), clean(F.get(parts, 1)).alias("kind"), row.alias("line"), expression.alias("expression"))
    return out.where(F.col("role").isin("def", "ref") & F.col("line").isNotNull() & (F.col("name") != ""))


def attributed(output: DataFrame, file: str, position: str, line: str = "line") -> DataFrame:
    """(path, line): lines that begin with a tab, with the path line above them, within each output file; a path without any has one row, with null.

    So a path that a tool read and found nothing in differs from one that is not there at all. Empty lines, and tabbed ones before any path, are left out.
    """
    indented, is_path = F.col(line).startswith("\t"), (F.col(line) != "") & ~F.col(line).startswith("\t")
    w = Window.partitionBy(file).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    named = output.select(F.last(F.when(is_path, F.col(line)), ignorenulls=True).over(w).alias("path"), F.when(indented, F.substring(F.col(line), 2, 1 << 30)).alias("line"), is_path.alias("__head"))
    named = named.where(F.col("path").isNotNull() & (F.col("__head") | F.col("line").isNotNull()))
    empty = named.groupBy("path").agg(F.count("line").alias("__n")).where("__n = 0").select("path", F.lit(None).cast("string").alias("line"))
    return named.where("not __head").select("path", "line").unionByName(empty)


#: Ends of type names that declare, and beginnings that say of what kind; fixed values.
DECLARES = r"(?i)(declaration|definition|_item|_specifier|decl|def|_binding)$"
KINDS = {
    "class": "class", "struct": "struct", "enum": "enum", "interface": "interface", "trait": "trait", "module": "module", "namespace": "namespace",
    "const": "constant", "var": "var", "variable": "var", "param": "parameter", "parameter": "parameter", "package": "namespace", "import": "namespace",
    "container": "type", "error": "type", "test": "test",
}


def node_types(types: DataFrame, json: str = "json", rules: list[tuple[str, str | None, str]] | None = None, scope: str = "") -> DataFrame:
    """(type, kind, pattern) of the declaring types in lists of a grammar's node types, with the query pattern for each.

    A rule settles a type's kind; else its name must end like a declaration, and the word it begins with
    says the kind (function if none does).
    """
    kind_of = F.from_json(F.col(json), "array<struct<type: string, named: boolean, fields: map<string, string>>>")
    each = types.select(F.explode(kind_of).alias("t")).where("t.named and t.type <> ''").select("t.type", F.map_contains_key(F.coalesce("t.fields", F.create_map().cast("map<string,string>")), "name").alias("has_name"))
    settled = words.kind_for(F.col("type"), F.lit(scope), rules or [])
    kind = F.lit("function")
    for word in sorted(KINDS, key=len):  # the longest word that fits is tested last, so it is outermost
        kind = F.when(F.col("type").rlike(rf"\A(?i:{word})(?:_|[A-Z]|\z)"), KINDS[word]).otherwise(kind)
    judged = each.where(settled.isNotNull() | F.col("type").rlike(DECLARES)).withColumn("kind", F.coalesce(settled, kind))
    name = F.when(F.col("has_name"), "name: (_) @name").otherwise("(identifier) @name")
    return judged.select("type", "kind", F.format_string("(%s %s) @definition.%s", F.col("type"), name, F.col("kind")).alias("pattern"))


def declared_field(content: Column, prefix: str, terminator: str | None = None) -> Column:
    """The first value that follows a prefix at the start of a line, up to the terminator or the line's end.

    Lines with a block comment in them do not count. Null without a value.
    """
    import re

    plain = F.regexp_replace(content, r"(?s)[^\n]*/\*.*?(?:\*/[^\n]*|\z)", "")
    stop = re.escape(terminator) if terminator else r"(?:\r?$)"
    pattern = rf"(?m)^[ \t]*{re.escape(prefix)}[ \t]*(\S[^\n]*?)[ \t\r]*{stop}"
    return F.nullif(F.trim(F.regexp_extract(plain, pattern, 1)), F.lit(""))


def _holds(predicate: tuple[str, list[str]]) -> Column | None:
    """Whether a match meets a predicate (name, arguments; captures begin with @); null where it cannot be told here."""
    name, given = predicate
    if name.endswith("!"):  # rewrites, does not filter
        return F.lit(True)
    if name not in ("eq?", "not-eq?", "any-of?", "not-any-of?"):
        return None
    if len(given) < 2:
        return F.lit(True)
    if not given[0].startswith("@"):
        return F.lit(False)
    text = lambda a: F.col("captures")[a[1:]]["text"] if a.startswith("@") else F.lit(a)
    left = text(given[0])
    same = left == text(given[1]) if "eq" in name else left.isin(*(a for a in given[1:] if not a.startswith("@")))
    return F.coalesce(~same if name.startswith("not") else same, F.lit(False))


def query_tags(matches: DataFrame, patterns: dict[int, list[tuple[str, list[str]]]]) -> DataFrame:
    """Occurrences (path, name, role, kind, start, end) of a query's matches, of the patterns whose predicates all can be told and hold.

    matches: path, pattern (number), captures (map of name to text, start, end); @name is the symbol, and @definition.kind or
    @reference.kind say what it is. A pattern with a predicate that cannot be told (a regular expression, an unknown one)
    is dropped: a false occurrence is worse than a missing one. Matches without a name or a role give none.
    """
    keeps = F.lit(False)
    for number, predicates in patterns.items():
        held = [_holds(p) for p in predicates]
        if all(h is not None for h in held):
            here = F.col("pattern") == number
            for h in held:
                here = here & h
            keeps = keeps | here
    what = F.get(F.filter(F.map_keys("captures"), lambda k: k.rlike(r"^(definition|reference)\.")), 0)
    name = F.col("captures")["name"]
    tags = matches.where(keeps & what.isNotNull() & name.isNotNull())
    role = F.when(what.startswith("definition."), "def").otherwise("ref")
    return tags.select("path", name["text"].alias("name"), role.alias("role"), F.substring_index(what, ".", -1).alias("kind"), name["start"].alias("start"), name["end"].alias("end"))


def local_tags(captures: DataFrame, rules: list[tuple[str, str | None, str]], scope: str = "") -> DataFrame:
    """Definitions of captures (path, capture, text, start, end) named local.definition.kind, whose kind a rule (spelling, scope, kind) settles; others are dropped."""
    spelled = F.regexp_extract("capture", r"^(?:local\.)?definition\.(.+)$", 1)
    kind = words.kind_for(spelled, F.lit(scope), rules)
    return captures.where((spelled != "") & kind.isNotNull()).select("path", F.col("text").alias("name"), F.lit("def").alias("role"), kind.alias("kind"), "start", "end")


def walk_tags(nodes: DataFrame, kinds: DataFrame, levels: int = 3) -> DataFrame:
    """Definitions from a table of syntax nodes (path, id, parent, type, field, start, end, text): nodes of declaring types, by their name.

    kinds: type, kind. The name is the child in the field `name`, else the first identifier at most `levels` below; nodes without one give none.
    """
    declared = nodes.join(kinds.select("type", "kind").distinct(), "type").select("path", F.col("id").alias("of"), "kind", F.col("id").alias("at"))
    below = nodes.select("path", F.col("parent").alias("at"), F.col("id").alias("next"), "type", "field", "start", "end", "text")
    found = None
    for level in range(1, levels + 1):
        met = declared.join(below, ["path", "at"])
        named = (F.col("field") == "name") if level == 1 else F.lit(False)
        some = met.where(F.coalesce(named, F.lit(False)) | F.col("type").endswith("identifier"))
        some = some.select("path", "of", "kind", F.struct((~F.coalesce(named, F.lit(False))).alias("other"), "start", "end", "text").alias("n"))
        found = some if found is None else found.unionByName(some)
        declared = met.select("path", "of", "kind", F.col("next").alias("at"))
    best = found.groupBy("path", "of").agg(F.min_by(F.struct("kind", "n"), "n").alias("x"))
    return best.select("path", F.col("x.n.text").alias("name"), F.lit("def").alias("role"), F.col("x.kind").alias("kind"), F.col("x.n.start").alias("start"), F.col("x.n.end").alias("end"))


def generated_tags(queried: DataFrame, walked: DataFrame) -> DataFrame:
    """Both tiers' occurrences, one for each identifier's place; what a query found counts before what the walk found."""
    both = queried.withColumn("__from", F.lit(0)).unionByName(walked.withColumn("__from", F.lit(1)))
    one = both.groupBy("path", "start", "end").agg(F.min(F.struct("__from", "role", "kind", "name")).alias("x"))
    return one.select("path", "x.name", "x.role", "x.kind", "start", "end")
