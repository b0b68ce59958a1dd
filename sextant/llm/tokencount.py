"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where they surely agree.

A chunk begins at a token of the one before. Where both have the same two tokens next to each other, the text is
spliced between them: byte-pair merges give a row of tokens exactly if they give each two neighbours in it, when
encoded alone (the first merge across a boundary would happen in the two neighbours alone as well, as until then nothing
else reaches into them). Left of the splice all neighbours are those of one right encoding, right of it those
of the other, and the two at the splice are in both. So texts without spaces splice as well as others.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bpe
from sextant.llm.common import batches_task

#: Bytes of a chunk of a huge text, and of its overlap with the one before.
CHUNK, OVERLAP = 65_536, 512


@lru_cache(maxsize=4)
def splices(path: str) -> bool:
    """Whether a vocabulary file's ids are of the text's own bytes (no normalizer), merged by pairs, so that chunks can be spliced."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(n) for n in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    plain &= not any(t.get(n) for t in spec.get("added_tokens", []) for n in ("single_word", "lstrip", "rstrip"))
    return model.get("type") == "BPE" and plain and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")


@lru_cache(maxsize=4)
def _least_overlap(path: str) -> int:
    """More than the end of a chunk in which cut special strings, contractions or single spaces may show other tokens."""
    return 16 + 2 * max((len(t.content.encode()) for t in bpe.tokenizer(path).get_added_tokens_decoder().values()), default=0)


def _tokens(path: str, data: bytes, begin: int, stop: int) -> np.ndarray:
    """First bytes of the tokens of data[begin:stop], and stop."""
    ids = bpe.tokenizer(path).encode_batch_fast([data[begin:stop].decode()], add_special_tokens=False)[0].ids
    return begin + np.concatenate([[0], np.cumsum(bpe.id_sizes(path)[np.array(ids, np.int64)])])


def _character(data: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _splice(left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """Tokens of left before, and of right before, a boundary on both sides of which they have the same token; the one nearest the middle."""
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if len(i) < 3:
        return None
    near = (np.diff(i)[:-1] == 1) & (np.diff(i)[1:] == 1) & (np.diff(j)[:-1] == 1) & (np.diff(j)[1:] == 1)
    at = np.flatnonzero(near) + 1
    if not len(at):
        return None
    k = at[len(at) // 2]
    return int(i[k]), int(j[k])


def count_huge(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; where two chunks share no such boundary, the overlap is doubled, and the chunk with it.

    An overlap that reaches back to the start of what is not yet counted is the text from there, encoded
    whole. As what is encoded doubles each time, no text takes more than a few times its length.
    """
    data = text.encode()
    overlap = max(overlap, _least_overlap(path))
    total, start = 0, 0  # tokens before byte `start`, a boundary, are counted
    end = _character(data, chunk)
    left = _tokens(path, data, 0, end)
    while end < len(data):
        wide = overlap
        while True:
            begin = start
            some = left[(left > start) & (left <= end - wide)]
            for at in some[::-1][:64].tolist():
                if data[at] & 0xC0 != 0x80:
                    begin = at
                    break
            stop = _character(data, end + max(chunk, wide))
            right = _tokens(path, data, begin, stop)
            if begin == start:
                left, end = right, stop
                break
            if found := _splice(left[left >= begin], right):
                i, j = found
                total += int(np.searchsorted(left, begin)) + i
                left, start, end = right[j:], int(right[j]), stop
                break
            wide *= 2
    return total + len(left) - 1


@lru_cache(maxsize=2)
def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


bpe.CACHES.append(_processor)


def _count_new(path: str, parts: list[str]) -> list[bytes]:
    if path.endswith(".model"):
        found = _processor(path).encode(parts, num_threads=1)
    else:
        found = bpe.tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)
    return [len(x).to_bytes(8, "little") for x in found]


def count_column(path: str, texts: pa.Array, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    encode = lambda new: _count_new(path, new)
    counts = np.zeros(len(texts), np.int64)
    texts = texts.fill_null("")
    if not splices(path):
        if len(texts):
            counts[:] = np.frombuffer(b"".join(encode(texts.to_pylist())), "<i8")
        return counts
    huge = pc.binary_length(texts).to_numpy(zero_copy_only=False) > chunk
    for i in np.flatnonzero(huge).tolist():
        counts[i] = count_huge(path, texts[i].as_py(), chunk, overlap)
    codes, ends, different = bpe.coded(texts.filter(pa.array(~huge)), bpe.segments)
    each = np.frombuffer(b"".join(bpe.memo("count", path).values(different, encode)), "<i8")
    counts[~huge] = np.diff(np.concatenate([[0], np.cumsum(each[codes])])[ends], prepend=0)
    return counts


def count_texts(path: str, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    return count_column(path, pa.array(texts, pa.string()), chunk, overlap).tolist()


def _counted(batches, path: str, chunk: int, overlap: int):
    for batch in bpe.few(batches):
        counts = count_column(path, batch.column("__text"), chunk, overlap)
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, keep_text: bool = True) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to df.

    path: a .json file for the tokenizers library, or a .model file for sentencepiece. Null texts
    count as empty (0, 0, false). Texts of any length are counted whole: over `chunk` bytes, in
    chunks that overlap, where the vocabulary is byte-level BPE; others are encoded in one piece, by the
    library. Repeated rows are kept; columns of df named like an output are replaced.
    Without keep_text the text is left out, and is not sent back from Python.
    """
    new = ("n_bytes", "n_tokens", "over_limit", "__text", *([] if keep_text else [text.lower()]))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    data = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in new), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("__text"))
    out = data.mapInArrow(batches_task(_counted, path, chunk, overlap), data.drop("__text").schema.add("n_tokens", "long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
