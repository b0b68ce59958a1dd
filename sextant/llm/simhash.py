"""SimHash near-duplicates: exact comparison of fingerprints in tiles, by exclusive-or and bit counts.

Distinct fingerprints are put into tiles by the population counts of their quarters. Two
fingerprints differ in at least as many bits as their quarters' counts do in sum, so tile pairs whose
counts differ by more than the radius are skipped, and every pair within the radius is in a tile pair
that is compared. A tile pair sends on a spanning forest of its links only.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batches_task, tile_pairs, tiled, written
from sextant.llm.components import components

#: Fingerprints in a tile, about.
TILE = 4096
#: Parts of a fingerprint whose population counts tiles go by, and the bits of each.
QUARTERS, BITS = 4, 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of lower-cased (A-Z) words, repeats included; fewer words than `width` are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist(), strict=True)], np.uint64)


def votes(hashes: np.ndarray) -> np.uint64:
    """Bit i is set if it is in over half of the hashes; of none, zero."""
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        tally += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * tally > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text's shingles; zero without words."""
    return int(votes(shingle_hashes(text, width)))


def _fingerprinted(batches, width: int):
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), width) for t in batch.column("__text")], np.uint64).view(np.int64)
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, pa.int64())], names=[*keep, "fp"])


def fingerprints(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """Replaces `text` by fp, the fingerprint as a signed long. Fewer words than `width` are one shingle; none give 0."""
    keep = [c for c in df.columns if c.lower() not in (text.lower(), "fp", "__text")]
    data = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    return data.mapInArrow(batches_task(_fingerprinted, width), data.drop("__text").schema.add("fp", "long"))


def _forest(close: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Links (side, row, side, row) that connect what the matrix of links between two tiles connects."""
    rows, columns = close.any(1), close.any(0)
    if close.sum() <= rows.sum() + columns.sum():
        return [(0, i, 1, j) for i, j in np.argwhere(close).tolist()]
    none = len(rows)
    left = np.where(rows, np.arange(none), none)
    right = np.full(len(columns), none)
    i, j = np.nonzero(close)
    while True:
        before = left.copy()
        np.minimum.at(right, j, left[i])
        np.minimum.at(left, i, right[j])
        if (left == before).all():
            break
    return [(0, int(left[k]), 0, int(k)) for k in np.flatnonzero(rows) if left[k] != k] + [(0, int(right[k]), 1, int(k)) for k in np.flatnonzero(columns)]


def _compared(batches, radius: int):
    for batch in batches:
        out: list = [[], []]
        for a, b in zip(batch.column("mine"), batch.column("theirs"), strict=True):
            x, y = (v.values.to_numpy().view(np.uint64) for v in (a, b))
            for at in range(0, len(x), 1024):
                part = x[at : at + 1024]
                close = np.bitwise_count(part[:, None] ^ y[None, :]) <= radius
                if close.any():
                    sides = part.view(np.int64), y.view(np.int64)
                    for s, i, t, j in _forest(close):
                        u, v = int(sides[s][i]), int(sides[t][j])
                        if u != v:
                            out[0].append(u)
                            out[1].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["a", "b"])


def near_links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, such that they connect exactly what pairs within `radius` bits connect."""
    counts = [F.bit_count(F.shiftrightunsigned(F.col("fp"), BITS * q).bitwiseAND(F.lit((1 << BITS) - 1))) for q in range(QUARTERS)]
    base = BITS + 2 * radius + 1  # so that a neighbour's class has a number of its own
    number = lambda v: sum(((x + radius) * base**q for q, x in enumerate(v)), F.lit(0).cast("long"))
    classed = distinct.select("fp", number(counts).cast("long").alias("class"))
    made = written(tiled(classed, tile, F.xxhash64("fp")), "tiles")  # at most 17 ** 4 classes
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    offsets = sorted({n for d in steps if (n := sum(x * base**q for q, x in enumerate(d))) >= 0})  # each pair of classes once
    pairs = tile_pairs(made, offsets).select(F.col("mine.fp").alias("mine"), F.col("theirs.fp").alias("theirs"))
    return pairs.mapInArrow(batches_task(_compared, radius), "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 5, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links lead to).

    Fingerprints of shingles of `width` words link within `radius` differing bits; equal ones always do.
    Null and empty texts have fingerprint zero, which links like any other. Texts of any length are hashed
    whole. Rows repeated whole are kept; other columns are left out; a null doc_id is kept, and a component of nulls only has a null component_id.
    """
    data = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = written(fingerprints(data, width), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct, radius), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
