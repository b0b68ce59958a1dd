"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sextant.llm import bpe
from sextant.llm.common import batches_task

#: GPT-2's splitting pattern, a fixed value of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encode_new(path: str, parts: list[str]) -> list[bytes]:
    return [np.array(x.ids, "<u4").tobytes() for x in bpe.tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)]


def encode_column(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, as little-endian unsigned 32-bit integers, and where each text's end; null counts as empty."""
    codes, ends, different = bpe.coded(texts, bpe.segments)
    return bpe.gathered(bpe.memo("bytes", path).values(different, lambda new: _encode_new(path, new)), codes, ends)


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Packed ids of each text."""
    ids, ends = encode_column(path, pa.array(texts, pa.string()))
    return [x.tobytes() for x in np.split(ids, ends)[: len(texts)]]


def decode_ids(path: str, packed: bytes) -> bytes:
    """The bytes that ids stand for, by the byte table reversed; a character split over ids is whole again."""
    return bpe.bytes_of(path, np.frombuffer(packed, "<u4"))


def char_offsets(path: str, text: str, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last.

    Bytes map to characters by counting the bytes that start one. Tokens that share a split
    character all cover that character.
    """
    ids = np.frombuffer(packed, "<u4")
    lengths = bpe.id_sizes(path)[ids]
    ends = np.cumsum(lengths)
    of_byte = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    if not len(ids):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return of_byte[ends - lengths].astype(np.int32), (of_byte[ends - 1] + 1).astype(np.int32)


def _encoded(batches, path: str, with_offsets: bool):
    for batch in bpe.few(batches):
        texts = batch.column("__text").to_pylist()
        packed = encode_texts(path, texts)
        arrays = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in packed], pa.list_(pa.int32()))]
        if with_offsets:
            spans = [char_offsets(path, t or "", x) for t, x in zip(texts, packed, strict=True)]
            arrays += [pa.array([s[i] for s in spans], pa.list_(pa.int32())) for i in (0, 1)]
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *arrays], names=[*keep, "ids", "starts", "ends"][: len(keep) + len(arrays)])


def _checked(path: str, pattern: str) -> str:
    if not path.endswith(".json") and pattern != PATTERN:
        raise ValueError("ranks are encoded by the pattern of byte-level vocabularies only")
    return path


def encode(df: DataFrame, path: str, text: str = "text", pattern: str = PATTERN, offsets: bool = False) -> DataFrame:
    """Adds `ids` (array of int), and with `offsets` the characters `starts` and `ends` of each token.

    path: a tokenizers .json file, or ranks as tiktoken reads them; for ranks, the tokenizer that is built
    of them gives the ids of the tiktoken library (bpe.tokenizer says why). Null and empty texts give empty arrays,
    any length of text is encoded whole, repeated rows are kept, and columns of df named like an
    output are replaced; an empty table gives an empty one.
    """
    out = [c for c in df.columns if c.lower() not in ("ids", "starts", "ends", "__text")]
    data = df.select(*(F.col(f"`{c}`") for c in out), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = data.drop("__text").schema.add("ids", ArrayType(IntegerType()))
    if offsets:
        schema = schema.add("starts", ArrayType(IntegerType())).add("ends", ArrayType(IntegerType()))
    return data.mapInArrow(batches_task(_encoded, _checked(path, pattern), offsets), schema)


def _decoded(batches, path: str):
    for batch in bpe.few(batches):
        ids = batch.column("ids").to_pylist()
        data = [decode_ids(path, np.array(x or [], "<u4").tobytes()) for x in ids]
        keep = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())], names=[*keep, "bytes", "decoded"])


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replaces the array of ids by `bytes` and `decoded` (text; bytes that are no UTF-8 become U+FFFD). Null: empty."""
    out = [c for c in df.columns if c.lower() not in ("bytes", "decoded", ids.lower())]
    data = df.select(*(F.col(f"`{c}`") for c in out), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return data.mapInArrow(batches_task(_decoded, path), data.drop("ids").schema.add("bytes", "binary").add("decoded", "string"))


def _digested(batches, path: str):
    for batch in bpe.few(batches):
        ids, ends = encode_column(path, batch.column("text"))
        text_ends = np.concatenate([[0], np.cumsum(bpe.id_sizes(path)[ids])])[ends]
        size = np.fromiter((0 if n is None else n for n in pc.binary_length(batch.column("text")).to_pylist()), np.int64, batch.num_rows)
        inside = _split_characters(path, ids)
        split = np.concatenate([[0], np.cumsum(inside)])[ends]
        packed, said = memoryview(ids.tobytes()), memoryview(bpe.bytes_of(path, ids))
        cuts = lambda e, width: zip((width * np.diff(e, prepend=0)).tolist(), (width * e).tolist(), strict=True)
        digests = lambda data, e, width: pa.array([hashlib.sha256(data[b - n : b]).hexdigest() for n, b in cuts(e, width)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(ends, prepend=0)),
                digests(packed, ends, 4),
                digests(said, text_ends, 1),
                pa.array(np.diff(split, prepend=0)),
                pa.array(np.diff(text_ends, prepend=0) == size),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "whole"],
        )


def _split_characters(path: str, ids: np.ndarray) -> np.ndarray:
    """Whether each token begins inside a character, which it then shares with the token before."""
    return bpe.id_inside(path)[ids]


def round_trip(documents: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """Per document: n_tokens, SHA-256 of its packed ids and of the bytes they decode to (null text: empty).

    n_split: tokens that begin inside a character; whole: whether as many bytes are decoded as the text has.
    Null doc_ids and repeated rows are kept, texts of any length are encoded whole, other columns are left
    out, and an empty table gives an empty one.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        batches_task(_digested, _checked(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, whole boolean"
    )
