"""Best-two-fit packing of token sequences into bins of fixed capacity.

The plan depends on how many pieces there are of each length, not on which: a table of at most
`capacity` counts. Bins of the same make-up are planned together, and pieces of a length are then
dealt to the plan's places by their number within that length. So one plan covers all documents,
however many there are, and no task holds more than its share of them.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bpe
from sextant.llm.common import batches_task, partitions, ranked, written

#: Above this many rows, the plan is joined by a shuffle and not broadcast.
BROADCAST_ROWS = 200_000

#: Words whose matches are plain to see: no apostrophe (contractions), and nothing that special strings begin with.
_PLAIN = r"\A[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]+\z"
_MATCH = r"([a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: What the vocabulary file must say for words to be encoded apart: fixed values of such files.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def _matches(path: str):
    """The merges of a vocabulary that lower-cases and drops white space, for matches in bytes' characters with spaces between; None for others."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    removes = (split.get("behavior"), split.get("invert")) == ("Removed", True)
    if (spec.get("normalizer") or {}).get("normalizers") != _NORMALIZER or split.get("pattern") != {"Regex": _PATTERN} or not removes:
        return None
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
    coder = Tokenizer.from_str(json.dumps(spec))
    ends = np.zeros(coder.get_vocab_size(), bool)
    suffix = spec["model"]["end_of_word_suffix"]
    ends[[i for t, i in coder.get_vocab().items() if suffix and t.endswith(suffix)]] = True
    return (coder, ends) if suffix else None


bpe.CACHES.append(_matches)


def _encode_matches(path: str, parts: list[str]) -> list[bytes]:
    """Ids of matches, many at a time."""
    coder, ends = _matches(path)
    byte = bpe.byte_chars()
    latin = {b: ord(byte[b]) for b in range(256)}
    out = []
    for a in range(0, len(parts), 1024):
        text = "\x00".join(parts[a : a + 1024]).encode().decode("latin-1").translate(latin | {0: " "})
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cut = [0, *(4 * np.flatnonzero(ends[ids]) + 4).tolist()]  # after the last id of each match
        packed = ids.tobytes()
        out += [packed[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _encode_whole(path: str, texts: list[str]) -> list[bytes]:
    return [np.array(x.ids, "<u4").tobytes() for x in bpe.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _encode_words(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in a row, and where each word's end. Words of Latin letters, digits and signs are cut into matches here; others go as they are."""
    plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
    mask = pa.array(plain)
    marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(mask)), _MATCH, "\x00\\1")
    codes, ends, different = bpe.coded(pc.utf8_slice_codeunits(marked, 1), lambda x: pc.split_pattern(x, "\x00"))
    values = bpe.memo("matches", path).values(different, lambda new: _encode_matches(path, new))
    rest = words.filter(pc.invert(mask))
    values += bpe.memo("words", path).values(rest, lambda new: _encode_whole(path, new))
    many = np.ones(len(words), np.int64)
    many[plain] = np.diff(ends, prepend=0)
    at = np.cumsum(many)
    both = np.empty(int(many.sum()), np.int64)
    both[np.repeat(plain, many)] = codes
    both[np.repeat(~plain, many)] = len(different) + np.arange(len(rest))
    return bpe.gathered(values, both, at)


def encode_texts(path: str, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each followed by `end`, and where each text's end; null counts as empty.

    By words where the vocabulary file lower-cases, drops white space and marks the ends of words; else each text whole.
    """
    if not _matches(path):
        values = [*_encode_whole(path, [t or "" for t in texts.to_pylist()]), np.array([end], "<u4").tobytes()]
        codes = np.stack([np.arange(len(texts)), np.full(len(texts), len(texts))], 1).ravel()
        return bpe.gathered(values, codes, np.arange(2, len(codes) + 1, 2))
    codes, ends, different = bpe.coded(texts, bpe.words)
    flat, last = _encode_words(path, different)
    flat, last = np.append(flat, np.uint32(end)), np.append(last, len(flat) + 1)
    return bpe.taken(flat, last, np.insert(codes, ends, len(different)), ends + np.arange(1, len(ends) + 1))


def _pieces(batches, path: str, capacity: int, end: int):
    for batch in bpe.few(batches):
        ids, ends = encode_texts(path, batch.column("__text"), end)
        size = np.diff(ends, prepend=0)
        many = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        first = (ends - size)[row] + start
        view = memoryview(ids.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
        columns = (piece.astype(np.int32), start, length, pa.array(crc, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(row)), *(pa.array(c) for c in columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(documents: DataFrame, path: str, capacity: int, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32. Each text is its ids and then `end`."""
    data = documents.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return data.mapInArrow(batches_task(_pieces, path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins to make, as (lengths, how many such bins).

    Each bin is filled greedily, the longest piece that fits first. Then, while there is a gap, its
    shortest piece is exchanged for the two unpacked pieces that fill the widened gap most, if they
    fill more of it.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    index = np.arange(capacity + 1)
    plan: list[tuple[list[int], int]] = []
    while left.any():
        before = left.copy()
        fits = np.maximum.accumulate(np.where(left > 0, index, 0))  # the longest there is, up to each length
        made: list[int] = []
        gap = capacity

        def put(size: int, by: int) -> None:
            nonlocal gap, fits
            left[size] -= by
            gap -= by * size
            if left[size] in (0, 1):
                fits = np.maximum.accumulate(np.where(left > 0, index, 0))

        while gap and (size := int(fits[gap])):
            n = min(gap // size, int(left[size]))
            made += [size] * n
            put(size, n)
        while gap and made and (least := min(made)) + gap >= 2:
            room = gap + least
            first = index[1:room][left[1:room] > 0]
            second = fits[room - first]
            twice = (second == first) & (left[first] < 2)
            second = np.where(twice, fits[first - 1], second)
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= least:
                break
            best = int(total.argmax())
            made.remove(least)
            put(least, -1)
            for size in (int(first[best]), int(second[best])):
                made.append(size)
                put(size, 1)
        made.sort(reverse=True)
        sizes, uses = np.unique(made, return_counts=True)
        times = int((before[sizes] // uses).min())
        left = before
        left[sizes] -= uses * times
        plan.append((made, times))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> pa.Table:
    """Rows (length, lo, hi, uses, bin, at): pieces lo to hi - 1 of a length go to bins from `bin`, `uses` in each, from offset `at`."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for made, times in plan:
        at = 0
        for size in dict.fromkeys(made):
            uses = made.count(size)
            lo = taken.get(size, 0)
            taken[size] = lo + uses * times
            rows.append((size, lo, lo + uses * times, uses, base, at))
            at += uses * size
        base += times
    names = ["length", "__lo", "__hi", "__uses", "__bin", "__at"]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id (from 0) and offset to rows with doc_id, piece and length (1 to capacity); sequences have no gaps.

    Rows that are repeated whole are packed each; which of them gets which place is not defined,
    and does not matter. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = _places(best_two_fit(counts, capacity))
    plan = spark.createDataFrame(places)
    if places.num_rows <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    numbered = ranked(pieces, ["length"], F.xxhash64("doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "__nth", partitions(spark))
    nth = F.col("__nth") - F.col("__lo")
    return (
        numbered.join(plan, ["length"])
        .where((F.col("__nth") >= F.col("__lo")) & (F.col("__nth") < F.col("__hi")))
        .withColumn("sequence_id", F.col("__bin") + F.floor(nth / F.col("__uses")))
        .withColumn("offset", F.col("__at") + nth % F.col("__uses") * F.col("length"))
        .drop("__nth", "__lo", "__hi", "__uses", "__bin", "__at")
    )


def packed_documents(documents: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Packs all documents: a row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end`, so an empty or null text is one token; only longer
    documents than `capacity` are cut. Null doc_ids are kept, and rows repeated whole are packed each.
    """
    pieces = written(token_pieces(documents, path, capacity, end), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
