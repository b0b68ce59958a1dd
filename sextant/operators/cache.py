"""The incremental cache of extracted occurrences, keyed by path and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def collisions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows after the first of their key, with the first's `order` value as `winner`."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("__nth", F.row_number().over(w)).withColumn("winner", F.first(order).over(w))
    return numbered.where("__nth > 1").drop("__nth")


def needs_tagging(requested: DataFrame, cache: DataFrame, order: str | None = None) -> DataFrame:
    """Requested (path, hash), one per path, that the cache lacks at that hash.

    Where a path is asked for at several hashes, the first request by `order` counts (without one, the least hash).
    """
    asked = requested.groupBy("path").agg((F.min_by("hash", order) if order else F.min("hash")).alias("hash"))
    return asked.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def merged(cache: DataFrame, updates: DataFrame, removals: DataFrame) -> DataFrame:
    """The cache with updates in place of their paths' rows and without removed paths, which also go if they were updated."""
    kept = cache.join(updates.select("path"), "path", "left_anti").unionByName(updates.select(cache.columns))
    return kept.join(removals.select("path"), "path", "left_anti")


def removed(cache: DataFrame, removals: DataFrame) -> DataFrame:
    """Cached paths that a removal takes away."""
    return cache.select("path").join(removals.select("path"), "path", "left_semi").distinct()


def outcomes(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, outcome): not_cached, unsupported, or the number of occurrences as `tags` with checked."""
    found = requested.select("path").join(cache.select("path", F.size("tags").alias("tags"), "unsupported"), "path", "left")
    state = F.when(F.col("unsupported").isNull(), "not_cached").when(F.col("unsupported"), "unsupported").otherwise("checked")
    return found.select("path", state.alias("outcome"), F.when(state == "checked", F.col("tags")).alias("tags"))


def commit(cache: DataFrame, updates: DataFrame, removals: DataFrame, root: str) -> str:
    """Writes the merged cache as a new version under root and then points to it; readers see the old or the new one.

    Returns the version's path. The pointer is a small file that is replaced by a rename.
    """
    import uuid

    spark = cache.sparkSession
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    merged(cache, updates, removals).repartitionByRange("path").sortWithinPartitions("path").write.parquet(version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, current = (jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}") for n in ("CURRENT.new", "CURRENT"))
    fs = current.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri() if current.toUri().getScheme() else fs.getUri(), conf)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(current), how)
    return version


def current(spark, root: str) -> DataFrame:
    """The cache's current version."""
    at = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]
    return spark.read.parquet(at)


def dumped(cache: DataFrame) -> DataFrame:
    """The cache as text lines per path: path, hash, and either U or its occurrences.

    A text that holds occurrences stands once (X), and occurrences say at which of these they are, from 0.
    """
    text = F.transform("expressions", lambda x: F.concat(F.lit("X\t"), x))
    tag = F.transform("tags", lambda t: F.concat_ws("\t", F.lit("T"), t["role"], t["line"].cast("string"), t["name"], t["kind"], t["at"].cast("string")))
    head = F.array(F.concat(F.lit("P\t"), "path"), F.concat(F.lit("H\t"), "hash"))
    return cache.select(F.array_join(F.concat(head, F.when(F.col("unsupported"), F.array(F.lit("U"))).otherwise(F.concat(text, tag))), "\n").alias("value"))


def _parsed(values):
    """What dumps (an Arrow array of strings) say: the number of each kind of line in each (array of kinds), and the lines of each kind in order.

    P, H and X are what follows the mark, T the five columns role, line, name, kind and at, U only counts.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lines = pc.split_pattern(values, "\n")
    of, lines = np.asarray(pc.list_parent_indices(lines)), lines.flatten()
    counts, said = {"U": np.bincount(of[np.asarray(pc.equal(lines, "U"))], minlength=len(values))}, {}
    for k in "PHXT":
        mine = pc.starts_with(lines, f"{k}\t")
        counts[k] = np.bincount(of[np.asarray(mine)], minlength=len(values))
        said[k] = pc.utf8_slice_codeunits(lines.filter(mine), 2)
    parts = pc.split_pattern(said["T"], "\t", max_splits=4)
    if len(parts) and pc.min(pc.list_value_length(parts)).as_py() < 5:
        raise ValueError("an occurrence in a dump lacks fields")
    parts = parts.flatten()
    role, line, name, kind, at = (parts.take(pa.array(np.arange(n, len(parts), 5))) for n in range(5))
    said["T"] = [role, line.cast(pa.int32()), name, kind, at.cast(pa.int32())]
    return counts, said


def _heads(values, counts, said) -> list:
    """path, hash and unsupported of dumps."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    first = lambda k: said[k].take(pa.array(np.cumsum(counts[k]) - counts[k], mask=counts[k] == 0))
    return [first("P"), first("H"), pc.if_else(values.is_null(), None, pa.array(counts["U"] > 0))]


def _rows(values):
    """A row of path, hash, tags, expressions and unsupported for each of the dumps."""
    import numpy as np
    import pyarrow as pa

    counts, said = _parsed(values)
    path, hash_, unsupported = _heads(values, counts, said)
    role, line, name, kind, at = said["T"]
    gone = np.append(np.asarray(values.is_null()), False)
    listed = lambda k, of: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[k])), pa.int32(), mask=gone), of)
    tags = pa.StructArray.from_arrays([name, role, kind, line, at], ["name", "role", "kind", "line", "at"])
    return [path, hash_, listed("T", tags), listed("X", said["X"]), unsupported]


def _digests(values):
    """A row of path, hash, unsupported, the number of occurrences and their digest for each of the dumps.

    Lines of name, role, kind, line and text hold a text once an occurrence, so a file's are never built whole: pieces of about a MB are.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    counts, said = _parsed(values)
    role, line, name, kind, at = said["T"]

    def ordered(x):
        """Different values in order, as bytes, and the place of each value among them."""
        x = x.dictionary_encode()
        order = np.asarray(pc.sort_indices(x.dictionary))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return x.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist(), place[np.asarray(x.indices)]

    # Every field ends in the separator, which none holds, so that the order of fields is the order of lines.
    heads, head = ordered(pc.binary_join_element_wise(name, role, kind, "", "|"))
    lines, line = ordered(pc.binary_join_element_wise(line.cast(pa.string()), "", "|"))
    texts, text = ordered(said["X"])
    n, ends = counts["T"], np.cumsum(counts["T"])
    row, at = np.repeat(np.arange(len(values)), n), np.asarray(at)
    if len(at) and (at.min() < 0 or (at >= counts["X"][row]).any()):
        raise ValueError("an occurrence in a dump is at a text that it lacks")
    text = text[(np.cumsum(counts["X"]) - counts["X"])[row] + at]
    order = np.lexsort((line * max(1, len(texts)) + text, row * max(1, len(heads)) + head))
    longest = np.fromiter(map(len, texts), np.int64, len(texts))[text]
    ended, found = [x + b"\n" for x in texts], []
    for end, many in zip(ends.tolist(), n.tolist(), strict=True):
        out = hashlib.md5()
        step = max(1, (1 << 20) // (64 + int(longest[end - many : end].max(initial=0))))
        for start in range(end - many, end, step):
            mine = order[start : min(start + step, end)]
            pieces = [b""] * (3 * len(mine))
            pieces[0::3], pieces[1::3], pieces[2::3] = ([x[i] for i in of[mine].tolist()] for x, of in ((heads, head), (lines, line), (ended, text)))
            if start + step >= end:
                pieces[-1] = texts[text[mine[-1]]]
            out.update(b"".join(pieces))
        found.append(out.hexdigest())
    gone = np.asarray(values.is_null())
    path, hash_, unsupported = _heads(values, counts, said)
    return [path, hash_, unsupported, pa.array(n, pa.int32(), mask=gone), pa.array(found, pa.string(), mask=gone)]


#: Bytes of dumps that are read at once; a file's dump is not cut.
PIECE = 4 << 20


def _read(blocks: DataFrame, value: str, how: str, **columns: str) -> DataFrame:
    """The rows that this module's function `how` makes of dumps, a piece of a batch at a time."""
    import os

    root, module, size = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), __name__, PIECE
    names = [*columns]

    def run(batches):
        import importlib
        import sys

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if root not in sys.path:  # workers that were started elsewhere
            sys.path.append(root)
        made = getattr(importlib.import_module(module), how)
        for batch in batches:
            values = batch.column(0)
            piece = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64)) // size
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(values)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start < end:
                    yield pa.record_batch(made(values.slice(start, end - start)), names=names)

    return blocks.select(value).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in columns.items()))


def loaded(blocks: DataFrame, value: str = "value") -> DataFrame:
    """The inverse of dumped, from a block of lines per row: path, hash, tags (name, role, kind, line, at), expressions, unsupported."""
    tag = "struct<name: string, role: string, kind: string, line: int, at: int>"
    return _read(blocks, value, "_rows", path="string", hash="string", tags=f"array<{tag}>", expressions="array<string>", unsupported="boolean")


def loaded_digests(blocks: DataFrame, value: str = "value") -> DataFrame:
    """As loaded, with the number n of a file's occurrences and their digest `tags` in place of the occurrences: MD5 of sorted lines of
    name, role, kind, line and text, separated by bars."""
    return _read(blocks, value, "_digests", path="string", hash="string", unsupported="boolean", n="int", tags="string")
