"""Quality rules: text statistics as Spark expressions, and decision lists learned from labelled ones.

Everything that runs over documents is DataFrame functions. The rules are learned on the driver from
the statistics of a bounded sample of labelled documents and come back as one ordered conditional
expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window whose repetition counts; labelled documents that rules are learned from at most.
WINDOW, SAMPLE = 8, 20_000
#: White space, and symbols that junk is full of.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, from the statistics.
FEATURES = ("words", "word_length", "symbols_per_word", "dup_lines", "repeated", "upper", "marks")


def _doubled(hashes: str, n: Column, apart: int) -> Column:
    """Hashes of twice as many words: each with the one `apart` words on."""
    long = F.greatest(n - F.lit(apart), F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), long), F.slice(hashes, F.lit(apart + 1), long), lambda a, b: F.xxhash64(a, b))


def statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks (long) to df, with the prefix.

    Words are runs of characters other than ASCII white space; null texts have none. word_chars are
    code points in words; n_symbols are characters of SYMBOLS; n_dup_lines are \\n-split lines with a
    word that equal an earlier line; n_repeat_words are words in windows of WINDOW words that the text
    has twice or more (told apart by 64-bit hashes within a text). Columns of df with these names
    are replaced.
    """
    p = lambda name: f"{prefix}{name}"
    t, body, words, h, sorted_, same, at = (f"__q_{x}" for x in ("text", "body", "words", "hashes", "sorted", "same", "at"))
    out = df.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn(body, F.btrim(F.col(t), F.lit(SPACES)))
    out = out.withColumn(words, F.when(F.col(body) == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t-\\r]+")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumns({p("n_words"): F.size(words).cast("long"), "__q_lines": lines, h: F.transform(words, lambda w: F.xxhash64(w))})
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    out = out.withColumns(
        {
            p("word_chars"): F.length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long"),
            p("n_symbols"): gone("[#*$%&|<>]+").cast("long"),
            p("n_upper"): gone("\\p{Lu}+").cast("long"),
            p("n_marks"): (F.length(t) - F.length(F.replace(F.col(t), F.lit("!")))).cast("long"),
            p("n_lines"): F.size("__q_lines").cast("long"),
            p("n_dup_lines"): (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        }
    ).drop(words, body, t, "__q_lines")
    n = F.col(p("n_words")).cast("int")
    for apart in (1, 2, 4):
        n_left = n - F.lit(apart - 1)
        out = out.withColumn(h, _doubled(h, n_left, apart))
    none = F.lit(None)
    out = out.withColumn(sorted_, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none)).drop(h)
    m = F.size(sorted_) - 1
    out = out.withColumn(same, F.when(F.col(sorted_).isNotNull(), F.zip_with(F.slice(sorted_, F.lit(1), m), F.slice(sorted_, F.lit(2), m), lambda a, b: a["h"] == b["h"])))
    again = F.filter(sorted_, lambda x, i: F.coalesce(F.get(F.col(same), i - 1), F.lit(False)) | F.coalesce(F.get(F.col(same), i), F.lit(False)))
    out = out.withColumn(at, F.when(F.col(sorted_).isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"])))).drop(sorted_, same)
    k = F.size(at) - 1
    steps = F.zip_with(F.slice(at, F.lit(2), k), F.slice(at, F.lit(1), k), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)
    # Adds nothing, but as it isn't deterministic, a filter on the sum stays above it, with no copies of all these expressions.
    nothing = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return out.withColumn(p("n_repeat_words"), (F.when(F.col(at).isNull(), F.lit(0)).otherwise(covered) + nothing).cast("long")).drop(at)


def base_failed(prefix: str = "") -> Column:
    """Too short, or too repetitive to be learned from."""
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 20) | (100 * again > 30 * words)


def features(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    words, chars, lines = (F.greatest(c(n), F.lit(1.0)) for n in ("n_words", "word_chars", "n_lines"))
    exact = (c("n_words"), c("word_chars") / words, c("n_symbols") / words, c("n_dup_lines") / lines, c("n_repeat_words") / words, c("n_upper") / chars, c("n_marks") / words)
    return dict(zip(FEATURES, exact, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _thresholds(values: list[float], cuts: int) -> list[float]:
    distinct = sorted(set(values))
    middles = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    return middles if len(middles) <= cuts else [middles[i * len(middles) // cuts] for i in range(cuts)]


def _score(rows: list[tuple[dict, bool]], rule: Rule) -> tuple[int, int]:
    hit = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(hit), len(hit)


def _grow(rows: list[tuple[dict, bool]], longest: int, cuts: int) -> Rule:
    """Adds the condition of most information gain, until the rule covers nothing good or is long enough."""
    rule: Rule = ()
    while len(rule) < longest:
        bad, n = sum(b for _, b in rows), len(rows)
        if not bad or bad == n:
            break
        before, best = math.log2(bad / n), (0.0, None)
        for feature in FEATURES:
            order = sorted((row[feature], b) for row, b in rows)
            cut = iter(_thresholds([v for v, _ in order], cuts))
            under_n = under_bad = 0
            limit = next(cut, None)
            for value, b in order:
                while limit is not None and value >= limit:
                    for above, k, m in ((False, under_bad, under_n), (True, bad - under_bad, n - under_n)):
                        if k and (gain := k * (math.log2(k / m) - before)) > best[0] + 1e-9:
                            best = (gain, Condition(feature, above, limit))
                    limit = next(cut, None)
                under_n, under_bad = under_n + 1, under_bad + b
        if best[1] is None:
            break
        rule = (*rule, best[1])
        rows = [(row, b) for row, b in rows if best[1].holds(row)]
    return rule


def _prune(rows: list[tuple[dict, bool]], rule: Rule) -> Rule:
    """Drops conditions from the end while that does not make the rule worse on rows it was not grown on."""
    worth = lambda r: (2 * (s := _score(rows, r))[0] - s[1]) / max(1, s[1]) if r else -1.0
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(rows: list[tuple[dict, bool]], precision: float = 0.97, least: int = 5, longest: int = 3, cuts: int = 48, most: int = 12) -> list[Rule]:
    """Rules for bad rows by sequential covering: each is grown on two thirds of what is left, pruned on the rest, and taken off.

    A rule counts if it covers `least` bad rows and, over all rows left, is right in `precision` of
    cases; the first that does not ends the list. No rows, or rows of one kind, give no rules.
    """
    rules: list[Rule] = []
    while len(rules) < most:
        rule = _prune(rows[2::3], _grow([r for i, r in enumerate(rows) if i % 3 != 2], longest, cuts))
        if not rule:
            break
        bad, n = _score(rows, rule)
        if bad < least or bad < precision * n:
            break
        rules.append(rule)
        rows = [(row, b) for row, b in rows if not all(c.holds(row) for c in rule)]
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The first rule that holds, as text; null if none does."""
    columns, out = features(prefix), None
    for i, rule in enumerate(rules):
        test = rule[0].column(columns)
        for c in rule[1:]:
            test = test & c.column(columns)
        name = F.lit(f"{i + 1}: " + " and ".join(map(str, rule)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def learn_from(documents: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, **how) -> list[Rule]:
    """Learns rules from at most `sample` labelled documents, those whose doc_id has the least hashes (label quality 0 is bad, null is left out)."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = documents.select(F.col("doc_id"), F.col(f"`{text}`").alias("__body")).join(F.broadcast(some), "doc_id")  # at most `sample` rows
    counted = statistics(known, "__body", "q_").where(~base_failed("q_"))
    rows = counted.select("doc_id", "__quality", *(c.alias(n) for n, c in features("q_").items()))
    got = rows.orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample).collect()
    return learn([({n: r[n] for n in FEATURES}, r["__quality"] == 0) for r in got], **how)


def judged(documents: DataFrame, labels: DataFrame, text: str = "text", prefix: str = "", **how) -> DataFrame:
    """Adds the statistics, base_failed, rule (the learned rule that rejects, or null) and kept, each with the prefix.

    kept is false for a base failure or where a rule holds. Repeated rows are judged alike, null
    doc_ids are judged too, null and empty texts fail, and tables without usable labels give no rules. Texts of any
    length are counted whole; one is held by a task, with an entry per word.
    """
    rules = learn_from(documents, labels, text, **how)
    out = statistics(documents, text, prefix)
    out = out.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}rule": verdict(rules, prefix)})
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}rule").isNull())
