"""Near-duplicate removal by similarity: SimHash tiles find candidates, shingle sets decide.

Texts of few shingles link by equal subsets of them, exactly, as a fingerprint of few votes says too little.

Texts within a similarity of each other have shingle sets whose sizes differ by no more than that
factor, so only tiles of equal or neighbouring size classes are compared; in a tile pair, fingerprints of
256 bits are compared exactly, unless the tiles' population counts are further apart than the radius.
A tile pair first sends on the closest links that connect what it found, and those hold if the Jaccard
similarity of the texts' shingles is enough. As a closer link may fail where one that was left out holds, texts
with candidates then meet again: every candidate whose ends the links that hold have not joined is verified, in
blocks of a tile pair to which each text's shingles come once.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import batches_task, cogroup_task, tile_pairs, tiled, written
from sextant.llm.components import components
from sextant.llm.simhash import shingle_hashes, votes

WORDS = 4  # of 64 bits, in a fingerprint
TILE = 4096
#: Shingles of texts that are compared by subsets.
SHORT = 9
#: Texts on each side of a block, and shingles of the longest text times texts.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21


def _differs(both: int, a: int, b: int) -> float:
    """The chance that a fingerprint bit differs between sets that share `both` shingles and have a and b of their own."""
    shared = np.arange(both + 1)
    chance = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    more = lambda own: 1 - np.concatenate([[0], np.cumsum(chance(own))])[np.clip((both + own) // 2 + 1 - shared, 0, own + 1)]
    x, y = more(a), more(b)
    return float((chance(both) * (x + y - 2 * x * y)).sum())


@lru_cache
def radius(similarity: float, bits: int = 64 * WORDS, lost: float = 1e-9) -> int:
    """Bits in which pairs of this Jaccard similarity, at least one of over SHORT shingles, stay but for a chance of `lost`.

    By the worst sets, ties of even numbers of votes included; large sets near a limit.
    """
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for both in range(1, 97):
        most = 0
        while both >= similarity * (both + most + 1):
            most += 1
        worst = max([worst, *(_differs(both, a, n - a) for n in {most, max(0, most - 1)} for a in range(n // 2 + 1) if both + n - a > SHORT)])
    stays, k = 0.0, -1
    while 1 - stays > lost and k < bits:
        k += 1
        stays = math.fsum(math.comb(bits, i) * worst**i * (1 - worst) ** (bits - i) for i in range(k + 1))
    return k


def wide(hashes: np.ndarray) -> np.ndarray:
    """Four fingerprint words of distinct shingle hashes; the further words' hashes are the first's, mixed."""
    out, h = [], hashes
    for _ in range(WORDS):
        out.append(votes(h))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.array(out, np.uint64)


def text_key(text: str) -> Column:
    """16 bytes that stand for a text; null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 32))


def _signed(batches, width: int):
    for batch in batches:
        rows: list = [[] for _ in range(WORDS + 1)]
        few: list = []
        for t in batch.column("__text"):
            h = np.unique(shingle_hashes(t.as_py(), width))
            for o, v in zip(rows, (*wide(h).view(np.int64).tolist(), len(h)), strict=True):
                o.append(v)
            few.append(h.astype("<u8").tobytes() if len(h) <= SHORT else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(r, pa.int64()) for r in rows), pa.array(few, pa.binary())], names=["doc_id", "key", *(f"w{i}" for i in range(WORDS)), "n", "few"])


def _subsets(batches, similarity: float):
    for batch in batches:
        out: list = [[], [], [], []]
        for key, few in zip(batch.column("key").to_pylist(), batch.column("few").to_pylist(), strict=True):
            h = [few[at : at + 8] for at in range(0, len(few), 8)]
            for size in range(1, len(h) + 1):
                if size >= similarity * len(h):
                    for part in combinations(h, size):
                        for o, v in zip(out, (hashlib.blake2b(b"".join(part), digest_size=16).digest(), size, len(h) - size, key), strict=True):
                            o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "size", "without", "key"])


def links_short(distinct: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the texts of at most SHORT shingles that are similar.

    Texts that share a subset link if it is enough of both; as they then both link to the one with the least besides it, these links do.
    """
    parts = distinct.where(F.col("n").between(1, SHORT)).select("key", "few").mapInArrow(batches_task(_subsets, similarity), "part binary, size int, without int, key binary")
    parts = written(parts, "subsets")
    least = parts.groupBy("part").agg(F.min(F.struct("without", "key")).alias("x")).select("part", F.col("x.without").alias("other"), F.col("x.key").alias("a"))
    enough = F.col("size") >= F.lit(similarity) * (F.col("size") + F.col("without") + F.col("other"))
    return parts.join(least, "part").where(enough & (F.col("key") != F.col("a"))).select("a", F.col("key").alias("b"))


def _closest(distance: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Links (row, column) of a spanning forest of least distances."""
    i, j = np.nonzero(distance <= reach)
    d = distance[i, j]
    parent = list(range(sum(distance.shape)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for level in np.unique(d).tolist():
        here = d == level
        a, b = i[here], j[here] + distance.shape[0]
        if len(a) > 64:  # one link for each two trees is enough
            trees = np.array([root(x) for x in range(len(parent))])
            ta, tb = trees[a], trees[b]
            apart = np.flatnonzero(ta != tb)
            _, first = np.unique(np.minimum(ta, tb)[apart] * len(parent) + np.maximum(ta, tb)[apart], return_index=True)
            a, b = a[apart[first]], b[apart[first]]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (p := root(x)) != (q := root(y)):
                parent[p] = q
                out.append((x, y - distance.shape[0]))
    return out


def _side(value: pa.Scalar):
    v = value.values
    words = np.stack([v.field(f"w{i}").to_numpy().view(np.uint64) for i in range(WORDS)])
    return v.field("key"), words, v.field("n").to_numpy(), np.bitwise_count(words).sum(0, dtype=np.int64)


def _distances(left: pa.Scalar, right: pa.Scalar, same: bool, reach: int, similarity: float):
    """(first row, distances of up to 512 rows to all columns) of a tile pair; 999 where it cannot be a link."""
    _, wa, na, pa_ = _side(left)
    _, wb, nb, pb = _side(right)
    if pa_.min() - pb.max() > reach or pb.min() - pa_.max() > reach:
        return
    for at in range(0, len(na), 512):
        part = slice(at, at + 512)
        distance = np.zeros((len(na[part]), len(nb)), np.uint16)
        for x, y in zip(wa, wb, strict=True):
            distance += np.bitwise_count(x[part, None] ^ y[None, :])
        distance[np.minimum(na[part, None], nb[None, :]) < similarity * np.maximum(na[part, None], nb[None, :])] = 999
        distance[np.maximum(na[part, None], nb[None, :]) <= SHORT] = 999
        if same:
            rows = np.arange(len(na[part]))
            distance[rows, rows + at] = 999
        yield at, distance


def _compared(batches, reach: int, similarity: float):
    for batch in batches:
        out: list = [[], []]
        for left, right, same in zip(batch.column("mine"), batch.column("theirs"), batch.column("same").to_pylist(), strict=True):
            ka, kb = left.values.field("key"), right.values.field("key")
            for at, distance in _distances(left, right, same, reach, similarity):
                for i, j in _closest(distance, reach):
                    out[0].append(ka[at + i].as_py())
                    out[1].append(kb[j].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary()) for o in out], names=["a", "b"])


def _apart(batches, reach: int, similarity: float):
    """Blocks of a tile pair with the candidates between texts of different roots: their texts, and pairs of numbers in these."""
    for batch in batches:
        for left, right, same, name in zip(batch.column("mine"), batch.column("theirs"), batch.column("same").to_pylist(), batch.column("name").to_pylist(), strict=True):
            ka, kb = left.values.field("key"), right.values.field("key")
            ra, rb = (v.values.field("root").to_numpy() for v in (left, right))
            longest = max(v.values.field("n").to_numpy().max() for v in (left, right))
            side = int(max(16, min(BLOCK, BLOCK_SHINGLES // longest)))
            for at, distance in _distances(left, right, same, reach, similarity):
                maybe = (distance <= reach) & (ra[at : at + len(distance), None] != rb[None, :])
                if same:  # each pair once
                    maybe &= at + np.arange(len(distance))[:, None] < np.arange(len(rb))[None, :]
                for top in range(0, len(distance), side):
                    for first in range(0, len(rb), side):
                        i, j = np.nonzero(maybe[top : top + side, first : first + side])
                        if len(i):
                            rows, i = np.unique(i, return_inverse=True)
                            columns, j = np.unique(j, return_inverse=True)
                            texts = [*ka.take(pa.array(rows + top + at)).to_pylist(), *kb.take(pa.array(columns + first)).to_pylist()]
                            pairs = np.stack([i, j + len(rows)]).astype("<u2").tobytes()
                            yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{at + top}/{first}"]), pa.array([texts], pa.list_(pa.binary())), pa.array([pairs], pa.binary())], names=["block", "texts", "pairs"])


def size_tiles(distinct: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Tiles (mine, theirs: lists of distinct's rows) whose texts' sizes may be that similar; same: a tile with itself; name: of the pair."""
    size = F.floor(F.log("n") / F.lit(-math.log(similarity)) + 1e-9).cast("long")
    classed = distinct.where(F.col("n") >= similarity * (SHORT + 1) - 1e-9).withColumn("class", size)  # a class for each factor 1 / similarity
    pairs = tile_pairs(written(tiled(classed, tile, F.xxhash64("key")), "tiles"), [0, 1])
    return pairs.select("mine", "theirs", ((F.col("by") == 0) & (F.col("tile") == F.col("tile2"))).alias("same"), F.concat_ws("/", "class", "by", "tile", "tile2").alias("name"))


def candidates(distinct: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the texts (key, w0 ..., n) that may be that similar."""
    pairs = size_tiles(distinct, similarity, tile).select("mine", "theirs", "same")
    return pairs.mapInArrow(batches_task(_compared, radius(similarity), similarity), "a binary, b binary").distinct()


def links_apart(rooted: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) that hold and that, with those that made root, connect all that are similar of the texts (key, w0 ..., n, root)."""
    blocks = size_tiles(rooted, similarity, tile).mapInArrow(batches_task(_apart, radius(similarity), similarity), "block string, texts array<binary>, pairs binary")
    blocks = written(blocks, "blocks")
    needed = blocks.select(F.col("block").alias("of"), F.explode(F.array_distinct("texts")).alias("key")).join(sets, "key").select("of", "key", "shingles")
    return blocks.groupBy("block").cogroup(needed.groupBy("of")).applyInArrow(cogroup_task(_verified, similarity), "a binary, b binary")


def _sets(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [np.unique(shingle_hashes(t.as_py(), width)).astype("<u8").tobytes() for t in part.column("__text")]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])


def _similar(batches, similarity: float):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            a, b = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= similarity * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(block: pa.Table, needed: pa.Table, similarity: float) -> pa.Table:
    """The links of a block that hold, but for those whose ends others of the block join."""
    out: list = [[], []]
    sets = {k: np.frombuffer(v, "<u8") for k, v in zip(needed.column("key").to_pylist(), needed.column("shingles").to_pylist(), strict=True)}
    root = {k: k for k in sets}

    def top(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for texts, packed in zip(block.column("texts").to_pylist(), block.column("pairs").to_pylist(), strict=True):
        i, j = np.frombuffer(packed, "<u2").reshape(2, -1)
        others = np.unique(j).tolist()
        known, numbers = np.unique(np.concatenate([sets[texts[x]] for x in others]), return_inverse=True)
        of = dict(zip(others, np.split(numbers, np.cumsum([len(sets[texts[x]]) for x in others])[:-1]), strict=True))
        for x in np.unique(i).tolist():
            a, mine = texts[x], sets[texts[x]]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            here = np.zeros(len(known), bool)
            here[at[known[at] == mine]] = True
            for y in j[i == x].tolist():
                b = texts[y]
                if (p := top(a)) == (q := top(b)):
                    continue
                both = int(np.count_nonzero(here[of[y]]))
                if both >= similarity * (len(mine) + len(sets[b]) - both):
                    root[p] = q
                    out[0].append(a)
                    out[1].append(b)
    return pa.table([pa.array(o, pa.binary()) for o in out], names=["a", "b"])


def without_near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """documents with one row of each group of near-duplicates: the one with the least doc_id (null last), then of the least text key.

    Groups are connected by texts that are equal or whose sets of `width`-word shingles (lower-cased A-Z)
    have at least this Jaccard similarity. Fewer words than `width` are one shingle; texts without words are
    only copies of their equals (null equals empty). Of rows with equal doc_id and text, one stays, by a hash of
    its other columns.
    """
    columns = documents.columns
    ids = F.col(f"`{key}`").cast("long")
    data = documents.select(ids.alias("doc_id"), text_key(f"`{text}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = "doc_id long, key binary, " + ", ".join(f"w{i} long" for i in range(WORDS)) + ", n long, few binary"
    found = written(data.mapInArrow(batches_task(_signed, width), schema), "signed")
    signs = [F.first(c).alias(c) for c in (*(f"w{i}" for i in range(WORDS)), "n", "few")]
    distinct = found.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), *signs)
    maybe = written(candidates(distinct.drop("least", "few"), similarity), "candidates")
    ends = maybe.select(F.col("a").alias("key")).union(maybe.select("b")).distinct()
    # One row of each text: copies have other ids, so they do not meet it.
    shown = distinct.join(ends, "key").select("key", "least.doc_id")
    bodies = data.alias("d").join(shown.alias("s"), (F.col("d.key") == F.col("s.key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")))
    bodies = bodies.select("d.key", "d.__text").withColumn("__nth", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).where("__nth = 1").drop("__nth")
    sets = written(bodies.mapInArrow(batches_task(_sets, width), "key binary, shingles binary"), "shingles")
    sides = maybe.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    links = sides.mapInArrow(batches_task(_similar, similarity), "a binary, b binary").union(links_short(distinct, similarity))
    links = written(links, "similar")
    joined = components(links, "a", "b").withColumnRenamed("node", "key")
    # Every text with a candidate is an end, so the others need not meet again.
    met = distinct.drop("least", "few").join(ends, "key").join(joined, "key", "left").withColumn("root", F.xxhash64(F.coalesce("root", "key")))
    more = links_apart(met, sets, similarity)
    roots = components(links.union(more), "a", "b")
    rooted = distinct.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = F.min(F.struct("least.none", "least.doc_id", "key")).alias("x")
    stays = rooted.groupBy("root").agg(least).select(F.coalesce("x.doc_id", F.lit(-(2**63))).alias("__id"), F.col("x.none").alias("__none"), F.col("x.key").alias("__key"))
    marked = documents.withColumns({"__id": F.coalesce(ids, F.lit(-(2**63))), "__none": ids.isNull(), "__key": text_key(f"`{text}`")})
    others = [F.col(f"`{c}`") for c in columns if c.lower() not in (key.lower(), text.lower())]
    one = Window.partitionBy("__id", "__none", "__key").orderBy(F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0))
    kept = marked.join(stays, ["__id", "__none", "__key"]).withColumn("__nth", F.row_number().over(one)).where("__nth = 1")
    return kept.select(*(F.col(f"`{c}`") for c in columns))
