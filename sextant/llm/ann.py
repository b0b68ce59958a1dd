"""Nearest neighbours from randomly rotated one-bit codes, reranked by exact cosine where error bounds allow.

A unit vector o is rotated at random, and only the signs of its coordinates are kept, packed into
bits, as the unit vector s, with the scalar <s, Ro>. For a unit query q, <s, Rq> / <s, Ro> estimates <q, o>
without bias, and its error is below `sure` * sqrt(1 - <s, Ro> ** 2) / <s, Ro> / sqrt(d - 1) but for a chance
that falls as exp(-c * sure ** 2). Candidates whose estimate plus error reaches the k-th best estimate
less error are reranked on the original vectors.

Rq is kept in PLANES bits a coordinate, so that <s, Rq> is bit counts of a code's words and those of each plane; what
rounding can change at most is part of the error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import batches_task, group_task, partitions, written

#: Vectors of a block of candidates, queries of a block, and queries that are compared at a time.
BLOCK, QUERIES, AT_ONCE = 8_192, 8_192, 16
#: Blocks of queries that a task holds while blocks of vectors pass by, and parts that the vectors are dealt to at most. Vectors move once
#: for each TOGETHER blocks of queries, queries once for each part.
TOGETHER, PARTS = 32, 48
#: Standard deviations of the estimate that error bounds allow for. A neighbour is lost only if its estimate is wrong by that
#: much and by what the k-th best is above its own lower bound.
SURE = 1.9
#: Bits of a rotated query's coordinates.
PLANES = 6
#: What single precision may change of an estimate.
ROUNDING = 1e-5

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix, the same for a seed everywhere."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into words of 64, the last filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (words of 64) of rotated vectors, and how long each unit vector is along its signs."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rotated = unit @ rotation(vectors.shape[1], seed).T
    return _words(rotated >= 0), np.abs(rotated).sum(1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, along: np.ndarray, queries: np.ndarray, seed: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x vectors) from the codes' bits, and the error of each that is allowed for."""
    n, dim = queries.shape
    rotated = queries / np.linalg.norm(queries, axis=1, keepdims=True) @ rotation(dim, seed).T
    least = rotated.min(1, keepdims=True)
    step = np.maximum((rotated.max(1, keepdims=True) - least) / (2**PLANES - 1), 1e-300)
    levels = np.rint((rotated - least) / step).astype(np.uint8)
    rounded = least + step * levels
    on = np.bitwise_count(codes).sum(1, dtype=np.int32)  # of a code's bits
    kind = np.uint16 if dim << PLANES < 1 << 16 else np.int32
    weighed = np.zeros((n, len(codes)), kind)
    for plane in range(PLANES):
        words = _words((levels >> plane) & 1)
        for w in range(codes.shape[1]):
            weighed += np.left_shift(np.bitwise_count(codes[None, :, w] & words[:, None, w]), plane, dtype=kind)
    along = along.astype(np.float32)
    least, step, whole = (x.astype(np.float32) for x in (least, step, rounded.sum(1, keepdims=True)))
    inner = (2 * (least * on.astype(np.float32) + step * weighed) - whole) / np.float32(np.sqrt(dim))
    spread = np.sqrt(np.maximum(0, 1 - along**2)) / np.float32(np.sqrt(max(1, dim - 1)))
    lost = np.linalg.norm(rotated - rounded, axis=1, keepdims=True).astype(np.float32)
    return inner / along, (sure * spread + lost) / along


def _kept(vectors: np.ndarray) -> bytes:
    """Vectors as single precision where that loses nothing, else as double."""
    single = vectors.astype("<f4")
    return (single if (single == vectors).all() else vectors.astype("<f8")).tobytes()


def _given(blob: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<f4" if len(blob) == 4 * rows * dim else "<f8").reshape(rows, dim)


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False).reshape(-1, dim)


_BLOBS = ("ids", "codes", "along", "vectors")
_ROW = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("nth", pa.int64()), *((n, pa.binary()) for n in _BLOBS)])
ROW = "dim int, part int, nth long, ids binary, codes binary, along binary, vectors binary"


def _block(table: pa.Table, dim: int, part: int, nth: int, seed: int) -> pa.RecordBatch:
    """A block of vectors as one row: ids that ascend, codes, lengths along them, and the vectors for reranking."""
    table = table.sort_by("vec_id")
    vectors = _matrix(table, dim)
    codes, along = encode(vectors, seed)
    row = {"dim": dim, "part": part, "nth": nth, "ids": table.column("vec_id").to_numpy().astype("<i8").tobytes(), "codes": codes.tobytes(), "along": along.tobytes(), "vectors": _kept(vectors)}
    return pa.RecordBatch.from_pylist([row], schema=_ROW)


def _blocks(batches, block: int, parts: int, seed: int):
    """Blocks of a task's vectors, by dimension; where they stand is where they are encoded. They are dealt to `parts` in turn."""
    from pyspark import TaskContext

    began, made, held = TaskContext.get().partitionId(), 0, {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dim in pc.unique(table.column("dim")).to_pylist():
            held[dim] = pa.concat_tables([*([held[dim]] if dim in held else []), table.filter(pc.equal(table.column("dim"), dim))])
            while len(held[dim]) >= block:
                yield _block(held[dim].slice(0, block), dim, (began + made) % parts, began << 32 | made, seed)
                held[dim], made = held[dim].slice(block), made + 1
    for dim, table in held.items():
        if len(table):
            yield _block(table, dim, (began + made) % parts, began << 32 | made, seed)
            made += 1


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, each by its best score, ties to the smaller id."""
    order = np.lexsort([-score, ids])
    order = order[np.concatenate([[True], np.diff(ids[order]) != 0])[: len(order)]]
    order = order[np.lexsort([ids[order], -score[order]])[:k]]
    return ids[order], score[order]


class _Asked:
    """Queries of a group, and the k best that each has met so far."""

    def __init__(self, k: int, sure: float, seed: int):
        self.k, self.sure, self.seed, self.blocks = k, sure, seed, []

    def add(self, first: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.blocks.append((first, ids, vectors, np.full(len(ids), -np.inf), [None] * len(ids)))

    def meet(self, ids: np.ndarray, codes: np.ndarray, along: np.ndarray, vectors: np.ndarray) -> None:
        """Reranks the vectors of a block whose estimate plus error reaches the k-th best of the block less error and the k-th best so far."""
        k = self.k
        vectors = vectors.astype(float)
        norms = np.sqrt((vectors * vectors).sum(1))
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # ids ascend; one may have several vectors
        for _, q_ids, asked, kth, best in self.blocks:
            for at in range(0, len(q_ids), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                queries = asked[part].astype(float)
                guess, error = estimate(codes, along, queries, self.seed, self.sure)
                for i, own in enumerate(q_ids[part]):  # a query's own rows take no part
                    guess[i, np.searchsorted(ids, own) : np.searchsorted(ids, own, "right")] = -np.inf
                least = kth[part].copy()
                if len(first) > k and (fresh := np.flatnonzero(least == -np.inf)).size:
                    low = np.maximum.reduceat(guess[fresh] - error[fresh], first, axis=1)
                    least[fresh] = np.partition(low, -k, axis=1)[:, -k]
                guess += error
                hit, some = np.nonzero((guess >= (least - ROUNDING)[:, None].astype(guess.dtype)) & (guess > -np.inf))
                cut = np.searchsorted(hit, np.arange(len(queries) + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    q, found = queries[i], some[cut[i] : cut[i + 1]]
                    if kth[at + i] > -np.inf:  # only what is near enough is summed in the order that makes equal vectors equal
                        found = found[vectors[found] @ q >= (kth[at + i] - 1e-9) * norms[found] * np.sqrt((q * q).sum()) - 1e-300]
                        if not len(found):
                            continue
                    score = (vectors[found] * q).sum(1) / (norms[found] * np.sqrt((q * q).sum()))
                    had = best[at + i]
                    now = _best(ids[found], score, k) if had is None else _best(np.concatenate([had[0], ids[found]]), np.concatenate([had[1], score]), k)
                    best[at + i] = now
                    if len(now[0]) == k:
                        kth[at + i] = now[1][-1]

    def found(self):
        for first, q_ids, _, _, best in self.blocks:
            some = [i for i, x in enumerate(best) if x is not None]
            if some:
                times = np.array([len(best[i][0]) for i in some])
                query = np.repeat(np.array(some), times)
                yield pa.record_batch([pa.array(q_ids[query]), pa.array(query + first), pa.array(np.concatenate([best[i][0] for i in some])), pa.array(np.concatenate([best[i][1] for i in some]))], names=["query_id", "__query", "vec_id", "score"])


def _searched(batches, k: int, sure: float, seed: int):
    """Rows come by group, its queries before its blocks of vectors; one block is held at a time."""
    group = asked = None
    for batch in batches:
        for n in range(len(batch)):
            r = {c: batch.column(c)[n] for c in batch.schema.names}
            if group != (now := tuple(r[c].as_py() for c in ("dim", "q_group", "part"))):
                if asked:
                    yield from asked.found()
                group, asked = now, _Asked(k, sure, seed)
            blob = lambda c: r[c].as_buffer()  # noqa: B023, E731
            ids = np.frombuffer(blob("ids"), "<i8")
            vectors = _given(blob("vectors"), len(ids), now[0])
            if r["codes"].is_valid:
                asked.meet(ids, np.frombuffer(blob("codes"), np.uint64).reshape(len(ids), -1), np.frombuffer(blob("along"), "<f8"), vectors)
            else:
                asked.add(r["nth"].as_py() << 32, ids.copy(), vectors.copy())
    if asked:
        yield from asked.found()


def _queries(table: pa.Table) -> pa.Table:
    """A block of queries as one row."""
    dim = table.column("dim")[0].as_py()
    row = {"dim": dim, "nth": table.column("nth")[0].as_py(), "ids": table.column("vec_id").to_numpy().astype("<i8").tobytes(), "vectors": _kept(_matrix(table, dim))}
    return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, vector (doubles) and dim of the rows that take part.

    Left out are null ids and vectors that are null, empty, zero or hold a null or a value that is not finite.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    data = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    data = data.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    return data.withColumn("dim", F.size("vector"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", key: str = "vec_id", sure: float = SURE, seed: int = 1, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """For each row whose id is divisible by `every`: its k nearest other ids by cosine (query_id, rank from 1, vec_id, score).

    Every usable row is indexed and every query meets every block of vectors of its dimension; a block keeps its
    k best, and ties go to the smaller id. Rows repeated whole count once; rows with the query's own
    id are its own; an id with several vectors is found once, by its best. A query id with several vectors is a query by
    each. Fewer than k others give them all; an empty table gives an empty one; other columns are left out.
    """
    spark = vectors.sparkSession
    data = usable(vectors, vector, key)
    total = data.count()
    n_queries = max(1, -(-total // (every * queries)))
    mine = data.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    asked = mine.withColumn("nth", F.pmod(F.xxhash64("vec_id", F.hash("vector")), F.lit(n_queries)))
    asked = written(asked.groupBy("dim", "nth").applyInArrow(group_task(_queries), "dim int, nth long, ids binary, vectors binary"), "queries")
    # Small tables are cut finer, so that all cores have a block.
    rows = min(block, max(1024, -(-total // partitions(spark))))
    parts, n_groups = max(1, min(PARTS, -(-total // rows))), -(-n_queries // TOGETHER)
    index = data.mapInArrow(batches_task(_blocks, rows, parts, seed), ROW)
    every_part, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (parts, n_groups))
    none = F.lit(None).cast("binary")
    asked = asked.select("dim", every_part.alias("part"), "nth", "ids", none.alias("codes"), none.alias("along"), "vectors", F.pmod("nth", F.lit(n_groups)).cast("int").alias("q_group"))
    pairs = asked.unionByName(index.withColumn("q_group", every_group))
    # Rows are few and large; a task has the queries of a group and the vectors of a part.
    pairs = pairs.repartition(max(partitions(spark), parts * n_groups), "dim", "q_group", "part").sortWithinPartitions("dim", "q_group", "part", F.col("codes").isNotNull(), "nth")
    near = pairs.mapInArrow(batches_task(_searched, k, sure, seed), "query_id long, __query long, vec_id long, score double")
    near = near.groupBy("query_id", "__query", "vec_id").agg(F.max("score").alias("score"))  # an id may have vectors in several blocks
    w = Window.partitionBy("query_id", "__query").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
