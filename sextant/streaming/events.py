"""Reactions to events, as streams and as the same functions over a batch.

Events have session, ts, event_id, tool and file. Stateful ones keep their state per session, forever
unless a time to live is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAYLOAD = "session_id string, tool_name string, tool_input struct<file_path: string>"


def payloads(lines: DataFrame, value: str = "value") -> DataFrame:
    """(session, tool, file) of JSON events; what is missing is null."""
    p = F.from_json(F.col(value), PAYLOAD)
    return lines.select(p["session_id"].alias("session"), p["tool_name"].alias("tool"), p["tool_input"]["file_path"].alias("file"))


def routed(events: DataFrame, pattern: str, tool: str = "tool") -> DataFrame:
    """Events of the tools whose whole name matches."""
    return events.where(F.col(tool).rlike(f"^(?:{pattern})$"))


def every_nth(events: DataFrame, n: int = 25, session: str = "session", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each session's n-th, 2 n-th, ... event, with its number, over a batch."""
    numbered = events.withColumn("nth", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))
    return numbered.where(F.col("nth") % n == 0)


def nudges(events: DataFrame, n: int = 25, session: str = "session", ttl_ms: int | None = None) -> DataFrame:
    """(session, total) each time a session's events reach a further multiple of n, over a stream."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        now = before + sum(len(b) for b in batches)
        state.update((now,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        due = [m * n for m in range(before // n + 1, now // n + 1)]
        yield pd.DataFrame({"session": [key[0]] * len(due), "total": due})

    kind = events.schema[session].dataType.simpleString()
    timeout = "ProcessingTimeTimeout" if ttl_ms else "NoTimeout"
    return events.select(F.col(session)).groupBy(session).applyInPandasWithState(count, f"session {kind}, total long", "total long", "append", timeout)


def flagged(events: DataFrame, index: DataFrame) -> DataFrame:
    """(file, node) of edited files' owners, whose notes go stale; a stream joined with the stored index."""
    return events.join(index.select(F.col("path").alias("file"), F.explode("nodes").alias("node")), "file").select("file", "node").distinct()


def unclaimed(events: DataFrame, index: DataFrame) -> DataFrame:
    """Edited files that no node owns."""
    return events.select("file").join(index.select(F.col("path").alias("file")), "file", "left_anti").distinct()


def once_per_session(events: DataFrame, dependents: DataFrame, session: str = "session", file: str = "file") -> DataFrame:
    """(session, file, dependents) at a session's first event on a file that others depend on; works on streams and batches."""
    met = events.select(F.col(session).alias("session"), F.col(file).alias("file")).join(dependents, "file")
    return met.dropDuplicates(["session", "file"])


def committed(change: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that acts only on batches with rows."""

    def act(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            change(batch)

    return act


def context_line(nodes: DataFrame, matches: bool) -> DataFrame:
    """One line about a namespace's nodes, if there are any and the index is this repository's."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.lit(matches) & (F.col("n") > 0)).select(F.format_string("This repository has %d nodes.", "n").alias("line"))


def catalogue(namespaces: DataFrame, own: str) -> DataFrame:
    """Other namespaces, in order of their names."""
    return namespaces.where(F.col("namespace") != own).orderBy("namespace")


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n) in tumbling windows: beyond what is rebuilt, for streams with late data."""
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def pushes(events: DataFrame, every: int = 5, session: str = "session", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each session's events at which a push is due, over a batch; `every` 0 means never."""
    return every_nth(events, every, session, order) if every else every_nth(events, 1, session, order).where(F.lit(False))


def push_actions(states: DataFrame) -> DataFrame:
    """(name, action, log) of stores (name, upstream, ahead, error): push those that are ahead of an upstream; log is the line that a failed push leaves."""
    due = F.col("upstream").isNotNull() & (F.coalesce("ahead", F.lit(0)) > 0)
    log = F.when(due & F.col("error").isNotNull(), F.concat("name", F.lit(": push failed: "), "error"))
    return states.select("name", F.when(due, "push").otherwise("nothing").alias("action"), log.alias("log"))
