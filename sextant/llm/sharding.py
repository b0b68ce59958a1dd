"""Sharding by minimax contiguous partition over ordered atomic groups.

Groups (equal texts) are ordered by a 63-bit hash of the text, and a shard is a stretch of that order.
The smallest capacity for which greedy filling needs no more than the wanted shards is found by
binary search. The sizes come to the driver by stretches of the order, at first 2 ** 16 of them; those in
which a cut may fall are then told apart further, a bounded number at a time, until they are single groups. So the
capacity is the least that the groups allow, however many there are, and the driver never has a table of all.
Of the cuts that keep to that capacity, those are taken that leave the shards most even.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import partitions, ranked, written

#: Bits of the order, of the first stretches, and of the parts that a stretch is told apart into.
BITS, COARSE, FINER = 63, 16, 8
#: Stretches that are told apart in a round, largest first (bounds what a round brings, not what is found).
AT_ONCE = 256


class Unit(NamedTuple):
    """A stretch of the order: its first place, bits by which places in it differ (0: a single group), and its size."""

    first: int
    bits: int
    size: int


def _fill(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Where greedy filling begins the shards after the first; None if they do not hold all."""
    out, at = [], 0
    for _ in range(shards):
        at = bisect_right(ends, ends[at] + capacity, lo=at) - 1
        out.append(at)
    return out[:-1] if at == len(ends) - 1 else None


def _least(low: int, high: int, enough) -> int:
    while low < high:
        middle = (low + high) // 2
        if enough(middle):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that greedy filling makes do with, and where each next shard begins (`shards` - 1 places).

    Binary search over capacities, from the largest size to the sum. Within that capacity each cut is as near as can be to
    an even share of what is left; so a shard is empty only where there are fewer sizes than shards.
    """
    ends = list(accumulate(sizes, initial=0))
    n = len(sizes)
    capacity = _least(max(sizes, default=0), ends[-1], lambda c: _fill(ends, shards, c) is not None)
    # From the end: where the last shards, 1, 2, ... of them, may begin at the earliest.
    earliest = [n]
    for _ in range(shards - 1):
        earliest.append(bisect_left(ends, ends[earliest[-1]] - capacity))
    out, at = [], 0
    for left in range(shards - 1, 0, -1):
        low, high = max(at, earliest[left]), bisect_right(ends, ends[at] + capacity) - 1
        low = min(max(low, min(at + 1, n)), high)
        share = ends[at] + (ends[-1] - ends[at]) / (left + 1)
        k = min(max(bisect_left(ends, share), low), high)
        if k > low and share - ends[k - 1] <= ends[k] - share:
            k -= 1
        if n - k < left:  # leave a size for each of the others
            k = max(low, min(k, n - left))
        out.append(k)
        at = k
    return capacity, out


def open_units(units: list[Unit], shards: int) -> list[Unit]:
    """The stretches of several groups in which a cut of greedy filling may fall, at whatever capacity may be the least."""
    sizes = [u.size for u in units]
    ends = list(accumulate(sizes, initial=0))

    def reach(at: int, capacity: int) -> int:
        """How far a shard may get at best: into a stretch of several groups, but to the start of a single one."""
        to = min(at + capacity, ends[-1])
        k = bisect_right(ends, to) - 1
        return ends[k] if k < len(units) and not units[k].bits else to

    def furthest(capacity: int) -> int:
        at = 0
        for _ in range(shards):
            at = reach(at, capacity)
        return at

    high = _least(max(sizes), ends[-1], lambda c: _fill(ends, shards, c) is not None)
    low = _least(max([-(-ends[-1] // shards), *(u.size for u in units if not u.bits)]), high, lambda c: furthest(c) >= ends[-1])
    nearest = most = 0
    found: set[int] = set()
    for _ in range(shards - 1):
        nearest, most = ends[bisect_right(ends, nearest + low) - 1], reach(most, high)
        found.update(range(bisect_right(ends, nearest) - 1, bisect_left(ends, most)))
    return [units[i] for i in sorted(found) if i < len(units) and units[i].bits]


def _stretches(sized: DataFrame, bits: int) -> list[Unit]:
    """The stretches of places that are equal but for the last `bits`."""
    name = F.shiftright("__order", bits)
    rows = sized.groupBy(name.alias("k")).agg(F.sum("size").alias("n"), F.min("__order").alias("a"), F.max("__order").alias("z")).collect()
    return [Unit(r["a"], 0, r["n"]) if r["a"] == r["z"] else Unit(r["k"] << bits, bits, r["n"]) for r in rows]


def boundaries(sized: DataFrame, shards: int, coarse: int = COARSE, finer: int = FINER, at_once: int = AT_ONCE) -> list[int]:
    """First places of shards 1, 2, ... in the order; sized has __order (0 to 2 ** 63 - 1) and size. None of an empty table."""
    units = sorted(_stretches(sized, BITS - coarse))  # at most 2 ** coarse
    while units and (some := open_units(units, shards)):
        some = sorted(some, key=lambda u: -u.size)[:at_once]
        width = max(u.bits for u in some)
        some = [u for u in some if u.bits == width]
        here = sized.where(F.shiftright("__order", width).isin([u.first >> width for u in some]))
        units = sorted([*(set(units) - set(some)), *_stretches(here, max(0, width - finer))])
    _, at = cuts([u.size for u in units], shards)
    return [units[i].first if i < len(units) else 2**BITS - 1 for i in at] if units else []


def shard_documents(documents: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null).

    Size is the UTF-8 bytes of the text (null: none) and one more. Equal texts, so also rows repeated
    whole, share a shard; the largest shard is as small as the order of the groups allows. Null and empty texts are
    one group; null doc_ids are kept. A shard is empty only where there are fewer groups than shards, and an empty table
    gives an empty one. A text of any length is only measured and hashed; other columns are left out.
    """
    spark = documents.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    data = documents.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - BITS).alias("__order"),
    )
    data = written(data, "sized")
    shard = sum((F.when(F.col("__order") >= b, 1).otherwise(0) for b in boundaries(data, shards)), F.lit(0)).cast("int")
    placed = ranked(data.withColumn("shard", shard), ["shard"], F.xxhash64("doc_id", "__order"), [F.col("doc_id"), F.col("__order")], "slot", 4 * partitions(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
