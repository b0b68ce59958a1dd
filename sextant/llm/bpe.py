"""Tokenizer access for executors: pieces of texts that tokenize independently are encoded once and remembered.

A text is cut only where every tokenizer here is certain to start a new match: before a space or
line feed that follows a character that is no white space (no alternative of the patterns crosses
from a non-space to a white-space character, special strings contain no white space, and
canonical composition does not reach across a space). So the ids of a text are the ids of its
segments, in order, whatever the segments' neighbours are. Cutting, and telling the different
pieces of a batch apart, is done by Arrow on whole columns.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of pieces and values that a worker remembers for an encoder (bounds memory, not results).
REMEMBER = 64 << 20

_SPACES = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"[\x00{_SPACES}]|[ \n][ \n]"
_CUT = rf"([^ \n{_SPACES}])([ \n])"


def _split_odd(texts: pa.Array) -> pa.Array:
    """Segments of texts with other white space, with zero characters or with several spaces in a row."""
    out = pc.split_pattern(pc.replace_substring_regex(texts, _CUT, "\\1\x00\\2"), "\x00")
    if not pc.any(zero := pc.match_substring(texts, "\x00")).as_py():
        return out
    at = np.flatnonzero(zero.to_numpy(zero_copy_only=False))
    whole = pa.array([[t] for t in texts.take(pa.array(at)).to_pylist()], out.type)  # a text may be one segment
    order = np.arange(len(texts))
    order[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([out, whole]).take(pa.array(order))


def segments(texts: pa.Array) -> pa.Array:
    """Lists of segments, cut before each space or line feed that follows a non-space; joined, they are the texts."""
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    plain = lambda x: pc.split_pattern(pc.replace_substring(pc.replace_substring(x, " ", "\x00 "), "\n", "\x00\n"), "\x00")
    if not odd.any():
        return plain(texts)
    both = [plain(texts.filter(pa.array(~odd))), _split_odd(texts.filter(pa.array(odd)))]
    return pa.concat_arrays(both).take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))


def words(texts: pa.Array) -> pa.Array:
    """Lists of what is between spaces and line feeds: for tokenizers that drop white space."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def coded(column: pa.Array, cut) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts as numbers of their pieces, where the pieces of each text end among them, and the different pieces. Null: empty."""
    lists = cut(pc.fill_null(column, ""))
    different = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return different.indices.to_numpy(), offsets[1:] - offsets[0], different.dictionary


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)


def gathered(values: list[bytes], codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and where each text's end; values: packed ids of the pieces that codes number."""
    return taken(np.frombuffer(b"".join(values), "<u4"), np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4), codes, ends)


def taken(flat: np.ndarray, last: np.ndarray, codes: np.ndarray, ends: np.ndarray, at_once: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """As gathered; flat: ids of all pieces in a row, which end at `last`."""
    size = np.diff(last, prepend=0)
    total = np.concatenate([[0], np.cumsum(size[codes])])
    out = np.empty(int(total[-1]), "<u4")
    for a in range(0, len(codes), at_once):
        some = codes[a : a + at_once]
        out[total[a] : total[a + len(some)]] = flat[ragged(last[some] - size[some], size[some])]
    return out, total[ends]


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merge(token: bytes, order: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that a token is made of last, when pairs merge in the order of the ranks; None if they never make it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min(((order[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in order), default=(0, -1))
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizers.Tokenizer from a .json file, or built from a file of byte-level ranks.

    Encoding by ranks merges the neighbours whose concatenation has the least rank, the first of equals. Inside
    a token it merges as in the token alone, as nothing that crosses its ends is ever merged; so each token
    has one last merge, and a tokenizer with these merges, in the order of the ranks, has the same choice
    of least rank at each step, and gives the same ids.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    if path.endswith(".json"):
        return Tokenizer.from_file(path)
    table, order = byte_chars(), ranks(path)
    name = {t: "".join(table[b] for b in t) for t in order}
    made = (last_merge(t, order) for t in sorted(order, key=order.get) if len(t) > 1)
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in order.items()}, merges=[(name[m[0]], name[m[1]]) for m in made if m]))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out.decoder = decoders.ByteLevel()
    return out


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the byte table reversed; added tokens are their text."""
    back = {c: b for b, c in byte_chars().items()}
    coder = tokenizer(path)
    vocab = coder.get_vocab(with_added_tokens=False)
    added = coder.get_added_tokens_decoder()
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    for i, token in added.items():
        out[i] = token.content.encode()
    return out


@lru_cache(maxsize=4)
def id_sizes(path: str) -> np.ndarray:
    return np.fromiter(map(len, id_bytes(path)), np.int64)


@lru_cache(maxsize=4)
def id_inside(path: str) -> np.ndarray:
    """Whether each id's bytes begin inside a character."""
    return np.fromiter((bool(x) and x[0] & 0xC0 == 0x80 for x in id_bytes(path)), bool)


@lru_cache(maxsize=4)
def _id_text(path: str) -> tuple[np.ndarray, np.ndarray]:
    size = id_sizes(path)
    return np.frombuffer(b"".join(id_bytes(path)), np.uint8), np.cumsum(size) - size


def bytes_of(path: str, ids: np.ndarray, at_once: int = 1 << 19) -> bytes:
    """The bytes that ids stand for."""
    text, first = _id_text(path)
    size = id_sizes(path)
    steps = (ids[a : a + at_once].astype(np.int64) for a in range(0, len(ids), at_once))
    return b"".join(text[ragged(first[some], size[some])].tobytes() for some in steps)


class Memo:
    """Values by piece. When the younger half of its room is full, the older half is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.room = REMEMBER // 2

    def values(self, parts, encode) -> list:
        """Values (bytes) of different parts; encode(list of parts) gives those not known."""
        parts = parts.to_numpy(zero_copy_only=False).tolist() if isinstance(parts, pa.Array) else parts
        found = list(map(self.young.get, parts))
        at = [i for i, v in enumerate(found) if v is None]
        known = {i: v for i in at if (v := self.old.get(parts[i])) is not None}
        new = [i for i in at if i not in known]
        known |= zip(new, encode([parts[i] for i in new]), strict=True) if new else ()
        for i, v in known.items():
            found[i] = v
        self.young |= zip([parts[i] for i in known], known.values(), strict=True)
        self.room -= sum(200 + len(parts[i]) + len(v) for i, v in known.items())
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, REMEMBER // 2
        return found


_MEMOS: dict[tuple, Memo] = {}
#: What else a worker holds for an encoder.
CACHES = [ranks, tokenizer, id_bytes, id_sizes, id_inside, _id_text]


def memo(*key) -> Memo:
    return _MEMOS.setdefault(key, Memo())


def forget() -> None:
    """Drops what a worker remembers, vocabularies too: before it does other work."""
    _MEMOS.clear()
    for f in CACHES:
        f.cache_clear()


def few(batches, rows: int = 512, size: int = 4 << 20):
    """Batches of few rows and bytes, or one row, as the pieces of a text take many times its memory."""
    for batch in batches:
        at, most = 0, rows
        while at < batch.num_rows:
            part = batch.slice(at, most)
            if part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > size:
                most = max(1, part.num_rows // 2)
                continue
            yield part
            at, most = at + part.num_rows, min(rows, 2 * most)
