"""Where files, notes and configuration come from, and where results go."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import paths

#: Larger files are listed apart and not read; bytes.
LARGEST = 1_048_576


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files under a root, relative to it, from storage metadata only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    return found.select(F.regexp_replace("path", rf"^.*?{re.escape(base)}/", "").alias("path"), F.col("length").alias("size"))


def enumerated(files: DataFrame, ignore: list[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """files (path, size) that are neither binary nor noise nor ignored by a pattern, with `oversize`."""
    kept = files.where(~paths.is_excluded(F.col("path")) & ~paths.matches_any(F.col("path"), ignore or []))
    return kept.withColumn("oversize", F.col("size") > largest)


def oversize(files: DataFrame, shown: int = 5) -> DataFrame:
    """The largest files that are too large."""
    return files.where("oversize").orderBy(F.col("size").desc(), "path").limit(shown)


def once(df: DataFrame, path: str, again: bool = False) -> DataFrame:
    """df from where it was stored before, if it was; stored first if not, or if it is to be made again."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if again or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def texts(spark: SparkSession, root: str, glob: str = "*.md", leave_out: tuple[str, ...] = ("Index.md",)) -> DataFrame:
    """(path, node, text) of the text files under a root, each whole; the path is relative to the root."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{re.escape(base)}/", "")
    named = found.select(rel.alias("path"), F.col("value").alias("text"))
    return named.where(~paths.basename(F.col("path")).isin(*leave_out)).withColumn("node", paths.strip_md(paths.basename(F.col("path"))))


def numbered_lists(spark: SparkSession, root: str) -> DataFrame:
    """(number, title, path) from NN.title and NN.txt files (01 to 99); both are needed."""
    all_ = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.t*").text(root).select("value", F.col("_metadata.file_name").alias("name"))
    number = F.regexp_extract("name", r"^(\d\d)\.", 1)
    titles = all_.where(F.col("name").rlike(r"^(?!00)\d\d\.title$")).select(number.alias("number"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("title"))
    lines = all_.where(F.col("name").rlike(r"^(?!00)\d\d\.txt$")).select(number.alias("number"), F.explode(F.split("value", r"\r?\n")).alias("path")).where("path <> ''")
    return titles.join(lines, "number")


def manifest(spark: SparkSession, path: str) -> list[tuple[int, str, str, str]]:
    """(ord, title, include, exclude) rows of a tab-separated manifest; blank titles are left out. It is configuration, so it goes to the driver."""
    rows = spark.read.option("wholetext", "true").text(path).first()
    out = []
    for i, line in enumerate((rows[0] if rows else "").splitlines()):
        title, include, exclude = (*line.split("\t"), "", "")[:3]
        if title.strip() and include:
            out.append((i + 1, title.strip(), include, exclude))
    return out


def refs(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated reference index without header."""
    return spark.read.schema("name string, dir string, kind string, site string, expr string").option("sep", "\t").option("quote", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files without header or quotes, in the order of df within each."""
    df.select([F.col(c).cast("string") for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def stopwords(text: str) -> tuple[str, ...]:
    """Words of a list, a line each, in lower case; # begins a comment."""
    return tuple(sorted({w.lower() for x in text.splitlines() if (w := x.partition("#")[0].strip())}))


def patterns(text: str) -> list[str]:
    """Patterns of an ignore list or chains of a boilerplate list, in order."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def settings(text: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines of a shell file: quotes and `export` off, ~ and $NAME or ${NAME} filled in, \\$ for a dollar sign."""
    known = os.environ if environment is None else environment
    out: dict[str, str] = {}
    for line in text.splitlines():
        if not (m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)=(.*?)\s*$", line)):
            continue
        value = m[2]
        literal = value[:1] == "'" and value[-1:] == "'" and len(value) > 1
        if literal or (value[:1] == '"' and value[-1:] == '"' and len(value) > 1):
            value = value[1:-1]
        if not literal:
            value = re.sub(r"^~(?=/|$)", lambda _: known.get("HOME", "~"), value)
            value = re.sub(r"\\\$|\$(?:\{(\w+)\}|(\w+))", lambda x: "$" if x[0] == "\\$" else known.get(x[1] or x[2], ""), value)
        out[m[1]] = value
    return out


def rules(text: str) -> list[tuple[str, str | None, str]]:
    """(match, scope, kind) entries of a JSON rule list; entries without a match or kind are left out."""
    found = json.loads(text or "[]")
    entries = found if isinstance(found, list) else []
    return [(x["match"], x.get("scope") or None, x["kind"]) for x in entries if isinstance(x, dict) and isinstance(x.get("match"), str) and isinstance(x.get("kind"), str) and x["kind"]]
