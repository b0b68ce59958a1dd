"""Stores of notes as a Spark data source: spark.read.format("notes").load(folder), and df.write.format("notes").

A note is a row (node, text) and a file node.md. Reading plans a task per stretch of files; writing replaces notes
one by one, each by a rename, so that readers see whole notes, and a null text deletes. The folder is one that driver and executors
mount; from object stores, sources.files.texts reads the same rows.
"""

from __future__ import annotations

import contextlib
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sextant.functions import words

FILES_OF_A_TASK = 1000


@dataclass
class _Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str, leave_out: str):
        self.root, self.leave_out = root, leave_out

    def partitions(self):
        names = sorted(os.path.relpath(os.path.join(d, f), self.root) for d, _, fs in os.walk(self.root) for f in fs if f.endswith(".md") and f != self.leave_out)
        return [_Files(names[i : i + FILES_OF_A_TASK]) for i in range(0, len(names), FILES_OF_A_TASK)] or [_Files([])]

    def read(self, partition):
        for name in partition.names:
            with open(os.path.join(self.root, name), encoding="utf-8", newline="") as f:
                yield name.removesuffix(".md"), f.read()


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows):
        for row in rows:
            path = os.path.join(self.root, f"{row.node}.md")
            if row.text is None:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path)
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
                f.write(row.text)
            os.replace(f"{path}.new", path)
        return WriterCommitMessage()


class Notes(DataSource):
    """A folder of Markdown notes on storage that every executor mounts."""

    @classmethod
    def name(cls):
        return "notes"

    def schema(self):
        return "node string, text string"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("leaveout", "Index.md"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Notes)


def nodes(notes):
    """The store's notes by name, without their texts."""
    return notes.select("node").distinct()


def holding(notes, term: str):
    """(node, line) of notes that hold a term, with the first line that does."""
    return notes.where(F.col("text").contains(term)).select("node", words.first_line_with(F.col("text"), F.lit(term)).alias("line"))
