"""Repeated byte strings across a corpus, by prefix-free parsing over blocks of documents.

Every window of `length` bytes holds a trigger: of its K-grams (K = length // 2), the one whose
rolling hash is least, the first of equals. Equal windows hold the same trigger at the same place. A
phrase is the text between the first window start of a trigger and the end of its last window. The
dictionary is the different phrases; the parse says at which places of the corpus each of them stands.

1. Equal texts are taken together: each goes once from a task to its block, with whether it has copies. A block sends the
   distinct hashes of its triggers to the hash's partition, which says which occur twice or more. Only those can
   begin a repeated window.
2. A block's phrases of repeated triggers make its dictionary and its parse: every different phrase is sent once,
   to its trigger's partition, with the places where it stands. There the dictionaries of all blocks become one.
   A phrase that stands in two places is repeated whole. For the others, the dictionary's suffixes up to the trigger
   and what the parse goes on with after it are each sorted, with the bytes that neighbours share: windows
   with the same dictionary suffix form one stretch of the corpus order, and within it are ordered by
   their continuation; windows that share `length` bytes are neighbours there, and are repeats.
3. Their places go back to the blocks by the parse, and the bytes that they cover are removed.

A trigger with more than `hot` places in the corpus, of which the texts around may all differ, would bring too much to one
task. Its phrases are split by position, down to single windows: these meet by their BLAKE2 digest, one entry for
each different window of a block, so no task gets more of one than there are blocks. The result is the same, as equal
digests are equal windows. Texts move once, to their blocks; what else moves is hashes, places, and the
different phrases around repeated triggers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import batches_task, cogroup_task, group_task, partitions

LENGTH = 200
#: Places of one trigger whose phrases may meet in a task (changes what is moved, not what is found).
HOT = 20_000

#: Blocks for each shuffle partition: what a task holds of a partition's texts at a time.
BLOCKS = 4

_STEP = 1 << 18  # window starts that are worked on at a time
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PHRASE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("before", "<u2"), ("after", "<u2"), ("weight", "u1"), ("places", "<u4")])
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("pos", "<u4"), ("n", "u1")])
_RANGE = np.dtype([("start", "<u4"), ("end", "<u4")])
_NOWHERE = 0xFFFFFFFF
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n - 1 and their inverses, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def rolling(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each `width` bytes of data."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up, out=sums[1:])
    h = (sums[width:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def triggers(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of the windows of concatenated texts, which end at `ends`: place, first and last window start, hash."""
    k = length // 2
    span = length - k + 1
    total = len(data)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    change = np.zeros(total + 2, np.int32)
    np.add.at(change, np.maximum(starts, ends - length + 1), 1)
    np.add.at(change, ends, -1)
    valid = np.cumsum(change[:total], dtype=np.int32) == 0
    del change
    found = [[], [], [], []]
    for s in range(0, max(0, total - length + 1), _STEP):
        e = min(s + _STEP, total - length + 1)
        h = rolling(data[s : e + length - 1], k, _BASES[0])
        packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(packed, span)[: e - s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        j = np.flatnonzero(valid[s:e])
        if not len(j):
            continue
        x = at[j]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        last = np.concatenate([first[1:], [len(x)]]) - 1
        for out, v in zip(found, (x[first] + s, j[first] + s, j[last] + s, h[x[first]]), strict=True):
            out.append(v)
    if not found[0]:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    x, lo, hi, h = (np.concatenate(v) for v in found)
    new = np.concatenate([[True], x[1:] != x[:-1]])  # a trigger whose windows two steps share counts once
    last = np.concatenate([np.flatnonzero(new)[1:], [len(x)]]) - 1
    return x[new], lo[new], hi[last], h[new]


def _once(batches, blocks: int):
    """Each different text of a task once, with its key and block; if it comes again, one row more without the text."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        keys, at, texts = [], [], []
        for i, t in enumerate(batch.column("__text")):
            key = hashlib.sha256(t.as_buffer() or b"").digest()[:16]
            if (n := seen.get(key, 0)) < 2:
                seen[key] = n + 1
                keys.append(key)
                at.append(i)
                texts.append(None if n else i)
        block = pa.array([int.from_bytes(k[:4], "little") % blocks for k in keys], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), block, batch.column("__text").take(pa.array(texts, pa.int64()))], names=["__key", "__block", "__text"])


def _block(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A block's different texts, in the order of their keys: keys, concatenated bytes, ends, and weights (2: with copies)."""
    rows: dict[bytes, int] = {}
    weight: dict[bytes, int] = {}
    null = table.column("__text").is_null().to_pylist()
    for i, k in enumerate(table.column("__key").to_pylist()):
        weight[k] = min(2, weight.get(k, 0) + 1)
        if not null[i]:
            rows.setdefault(k, i)
    keys = sorted(rows)
    text = table.column("__text").take(pa.array([rows[k] for k in keys], pa.int64())).combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    wide = text.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(wide) and wide.buffers()[2] else np.empty(0, np.uint8)
    return keys, data, offsets[1:] - offsets[0], np.array([weight[k] for k in keys], np.int64)


def _by_part(h: np.ndarray, parts: int):
    """Order of entries by partition, and (partition, first, after last)."""
    p = (h >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(p, kind="stable")
    p = p[order]
    if not len(p):
        return order, []
    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return order, [(int(p[a]), a, b) for a, b in zip(cut, [*cut[1:], len(p)], strict=True)]


def _ask(table: pa.Table, length: int, parts: int) -> pa.Table:
    """A block's distinct triggers and how often it has them."""
    rows: list = [[], [], [], []]
    if table.num_rows:
        _, data, ends, weight = _block(table)
        x, _, _, h = triggers(data, ends, length)
        h, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, weight[np.searchsorted(ends, x, side="right")], len(h))
        order, runs = _by_part(h, parts)
        h, n = h[order], n[order].astype("<u4")
        block = table.column("__block")[0].as_py()
        for p, a, b in runs:
            for out, v in zip(rows, (p, block, h[a:b].tobytes(), n[a:b].tobytes()), strict=True):
                out.append(v)
    return pa.table([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "counts"])


def _totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry, the sum of counts of its key."""
    _, which = np.unique(keys, return_inverse=True)
    return np.bincount(which, counts)[which]


def _answer(table: pa.Table, hot: int) -> pa.Table:
    """The triggers of each block that the corpus has twice or more, and whether too often to meet."""
    blocks, rows = table.column("block").to_pylist(), [[], [], []]
    keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
    if keys:
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        total = _totals(np.concatenate(keys), counts)
        at = 0
        for block, k in zip(blocks, keys, strict=True):
            n = total[at : at + len(k)]
            at += len(k)
            if (twice := n > 1).any():
                for out, v in zip(rows, (block, k[twice].tobytes(), (n[twice] > hot).tobytes()), strict=True):
                    out.append(v)
    return pa.table([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["__block", "keys", "hot"])


def _runs(dup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and after-last column of each run of true values in a row."""
    edge = np.zeros((len(dup), dup.shape[1] + 2), np.int8)
    edge[:, 1:-1] = dup
    edge = np.diff(edge, axis=1)
    row, a = np.nonzero(edge == 1)
    return row, a, np.nonzero(edge == -1)[1]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)


def _dictionary(data: np.ndarray, lo: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Different phrases (a trigger's hash and its text), and for each phrase of the parse its number among them."""
    whole, ranks = data.tobytes(), {}
    parse = [ranks.setdefault((t, whole[a:b]), len(ranks)) for t, a, b in zip(h.tolist(), lo.tolist(), end.tolist(), strict=True)]
    return [t for _, t in ranks], np.array(parse, np.int64)


def _send(docs: pa.Table, flags: pa.Table, length: int, parts: int) -> pa.Table:
    """A block's dictionary and parse, as far as its triggers are repeated, and digests of the windows of hot ones."""
    rows: list = [[] for _ in range(6)]

    def put(*values):
        for out, v in zip(rows, values, strict=True):
            out.append(v)

    if docs.num_rows and flags.num_rows:
        block = docs.column("__block")[0].as_py()
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in flags.column("keys").to_pylist()])
        hot = np.concatenate([np.frombuffer(x, bool) for x in flags.column("hot").to_pylist()])
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        _, data, ends, weight = _block(docs)
        x, lo, hi, h = triggers(data, ends, length)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        x, lo, hi, h, hot = x[known], lo[known], hi[known], h[known], hot[at[known]]
        weight = weight[np.searchsorted(ends, x, side="right")]
        k = length // 2
        if len(cold := np.flatnonzero(~hot)):
            x1, lo1, hi1, h1 = (v[cold] for v in (x, lo, hi, h))
            texts, parse = _dictionary(data, lo1, hi1 + length, h1)
            order = np.argsort(parse, kind="stable")  # the places of each phrase together
            first = order[np.flatnonzero(np.diff(parse[order], prepend=-1))]
            t = np.empty(len(texts), _PHRASE)
            up, _ = _power(_BASES[1], k)
            second = np.zeros(len(first), np.uint64)
            for i in range(k):
                second += data[x1[first] + i] * up[i]
            t["h1"], t["h2"], t["before"], t["after"] = h1[first], second, (x1 - lo1)[first], (hi1 + length - x1 - k)[first]
            t["places"] = np.bincount(parse)
            t["weight"] = np.minimum(2, np.bincount(parse, weight[cold]))
            places = x1[order].astype("<u4")
            last = np.cumsum(t["places"].astype(np.int64))
            order, runs = _by_part(t["h1"], parts)
            for p, a, b in runs:
                some = order[a:b]
                size = t["places"][some].astype(np.int64)
                sides = zip(some.tolist(), t["before"][some].tolist(), strict=True)  # without the trigger, which its hashes stand for
                put(p, block, 1, t[some].tobytes(), b"".join([y for i, n in sides for y in (texts[i][:n], texts[i][n + k :])]), places[_ragged(last[some] - size, size)].tobytes())
        if len(warm := np.flatnonzero(hot)):
            _put_windows(put, data, lo[warm], hi[warm], weight[warm], block, length, parts)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["part", "block", "kind", "meta", "text", "places"])


def _put_windows(put, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, block: int, length: int, parts: int) -> None:
    """Sends the different windows of a block's hot triggers, and the places of those that it has twice itself."""
    size = hi - lo + 1
    pos, weight = _ragged(lo, size), np.repeat(weight, size)
    by = np.argsort(pos, kind="stable")
    pos, weight = pos[by], weight[by]
    h = np.empty((2, len(pos)), np.uint64)
    for row, base in zip(h, _BASES, strict=True):
        for s in range(0, len(data), _STEP):  # windows of a step at a time, as positions ascend
            a, b = np.searchsorted(pos, [s, s + _STEP])
            if a < b:
                row[a:b] = rolling(data[s : s + _STEP + length - 1], length, base)[pos[a:b] - s]
    order = np.lexsort(h[::-1])
    pos, weight, h = pos[order], weight[order], h[:, order]
    new = np.concatenate([[True], (h[:, 1:] != h[:, :-1]).any(0)])
    which = np.cumsum(new) - 1
    like = pos[np.flatnonzero(new)][which]
    for a in range(0, len(pos), 1 << 14):  # equal hashes must be equal bytes
        i = np.arange(length)
        if not (data[pos[a : a + (1 << 14), None] + i] == data[like[a : a + (1 << 14), None] + i]).all():
            raise ArithmeticError("two windows of a block have the same 128-bit hash")
    total = np.bincount(which, weight)
    again = np.sort(pos[total[which] > 1])
    if len(again):
        put(block % parts, block, 3, _ranges(again).tobytes(), b"", b"")
    first = np.flatnonzero(new)
    one = np.empty(len(first), _WINDOW)
    whole = data.tobytes()
    digests = np.frombuffer(b"".join([hashlib.blake2b(whole[p : p + length], digest_size=16).digest() for p in pos[first].tolist()]), "<u8").reshape(-1, 2)
    one["h1"], one["h2"], one["n"] = digests[:, 0], digests[:, 1], np.minimum(2, total)
    one["pos"] = np.where(total > 1, _NOWHERE, pos[first])
    order, runs = _by_part(one["h1"], parts)
    one = one[order]
    for p, a, b in runs:
        put(p, block, 2, one[a:b].tobytes(), b"", b"")


def _ranges(pos: np.ndarray) -> np.ndarray:
    """Ascending places as ranges."""
    cut = np.flatnonzero(np.concatenate([[True], np.diff(pos.astype(np.int64)) != 1]))
    out = np.empty(len(cut), _RANGE)
    out["start"], out["end"] = pos[cut], pos[np.concatenate([cut[1:], [len(pos)]]) - 1].astype(np.int64) + 1
    return out


def _sorted_strings(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of padded byte strings within groups, and the bytes each shares with the one before it (-1: another group)."""
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, -text.shape[1] % 8)))).view(">u8")
    order = np.lexsort([*words.T[::-1], group])
    a, b = text[order[:-1]], text[order[1:]]
    differ = a != b
    shared = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    shared[group[order[:-1]] != group[order[1:]]] = -1
    return order, np.concatenate([[-1], shared])


def repeats(t: np.ndarray, text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each phrase of a dictionary and each a, whether its window from a bytes before the trigger is repeated."""
    k = length // 2
    reach = length - k
    n = len(t)
    before, after = (t[c].astype(np.int64) for c in ("before", "after"))
    _, group = np.unique(t[["h1", "h2"]], return_inverse=True)
    size = before + after
    at = np.cumsum(size) - size
    left, right = np.zeros((n, reach), np.uint8), np.zeros((n, reach), np.uint8)
    i = _ragged(np.zeros(n, np.int64), before)
    who = np.repeat(np.arange(n), before)
    left[who, before[who] - 1 - i] = text[at[who] + i]  # backwards from the trigger
    i = _ragged(np.zeros(n, np.int64), after)
    who = np.repeat(np.arange(n), after)
    right[who, i] = text[at[who] + before[who] + i]
    dictionary, parse = _sorted_strings(group, left), _sorted_strings(group, right)
    suffix, goes_on = np.empty(n, np.int64), np.empty(n, np.int64)
    dup = np.zeros((n, reach + 1), bool)
    for a in range(reach + 1):
        here = np.flatnonzero((before >= a) & (reach - after <= a))
        if not len(here):
            continue
        suffix[dictionary[0]] = np.cumsum(dictionary[1] < a)
        goes_on[parse[0]] = np.cumsum(parse[1] < reach - a)
        place = suffix[here] * (n + 1) + goes_on[here]  # in the corpus order of these windows
        order = np.argsort(place)
        same = place[order[1:]] == place[order[:-1]]
        dup[here[order[1:][same]], a] = True
        dup[here[order[:-1][same]], a] = True
        dup[here[t["weight"][here] > 1], a] = True
    return dup


def _merged(t: np.ndarray, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionaries of all blocks as one: its phrases, their text, and for each phrase of a block its number in it."""
    last = np.cumsum(t["before"].astype(np.int64) + t["after"])
    ranks: dict = {}
    first, at = [], 0
    number = np.empty(len(t), np.int64)
    for i, (h1, h2, before, end) in enumerate(zip(t["h1"].tolist(), t["h2"].tolist(), t["before"].tolist(), last.tolist(), strict=True)):
        number[i] = r = ranks.setdefault((h1, h2, before, texts[at:end]), len(ranks))
        at = end
        if r == len(first):
            first.append(i)
    out = t[first]
    out["weight"] = np.minimum(2, np.bincount(number, t["weight"]))
    return out, np.frombuffer(b"".join([phrase[3] for phrase in ranks]), np.uint8), number


def _meet(table: pa.Table, length: int) -> pa.Table:
    """Repeated windows of each block, as ranges of window starts."""
    out: list = [[], []]

    def put(blocks: np.ndarray, ranges: np.ndarray):
        if not len(blocks):
            return
        order = np.argsort(blocks, kind="stable")
        blocks = blocks[order]
        cut = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        for a, b in zip(cut, [*cut[1:], len(blocks)], strict=True):
            out[0].append(int(blocks[a]))
            out[1].append(ranges[order[a:b]].tobytes())

    for kind in (1, 2, 3):
        some = table.filter(pc.equal(table.column("kind"), kind))
        if not some.num_rows:
            continue
        meta = some.column("meta").to_pylist()
        block = np.array(some.column("block").to_pylist())
        if kind == 3:
            out[0] += block.tolist()
            out[1] += meta
            continue
        parts = [np.frombuffer(m, _PHRASE if kind == 1 else _WINDOW) for m in meta]
        t, block = np.concatenate(parts), np.repeat(block, [len(p) for p in parts])
        if kind == 1:
            phrases, text, number = _merged(t, b"".join(some.column("text").to_pylist()))
            places = np.frombuffer(b"".join(some.column("places").to_pylist()), "<u4").astype(np.int64)
            row, a, b = _runs(repeats(phrases, text, length))
            per = np.bincount(row, minlength=len(phrases))  # repeated stretches of each phrase of the dictionary
            first_run = np.cumsum(per) - per
            size = t["places"].astype(np.int64)
            runs = np.repeat(per[number], size)  # of each place, by the parse
            which = _ragged(np.repeat(first_run[number], size), runs)
            x = np.repeat(places, runs)
            r = np.empty(len(which), _RANGE)
            r["start"], r["end"] = x - (b[which] - 1), x - a[which] + 1
            put(np.repeat(np.repeat(block, size), runs), r)
        else:
            order = np.lexsort([t["h2"], t["h1"]])
            t, block = t[order], block[order]
            new = np.concatenate([[True], (t["h1"][1:] != t["h1"][:-1]) | (t["h2"][1:] != t["h2"][:-1])])
            which = np.cumsum(new) - 1
            twice = (np.bincount(which, t["n"])[which] > 1) & (t["pos"] != _NOWHERE)
            r = np.empty(int(twice.sum()), _RANGE)
            r["start"], r["end"] = t["pos"][twice], t["pos"][twice] + 1
            put(block[twice], r)
    return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["__block", "ranges"])


def _removed(docs: pa.Table, found: pa.Table, length: int, keep_text: bool) -> pa.Table:
    """A row per different text of a block: what stays of it."""
    keys, data, ends, _ = _block(docs) if docs.num_rows else ([], np.empty(0, np.uint8), np.empty(0, np.int64), None)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    change = np.zeros(len(data) + 1, np.int32)
    for x in found.column("ranges") if found.num_rows else ():
        r = np.frombuffer(x.as_buffer(), _RANGE)
        np.add.at(change, r["start"], 1)
        np.add.at(change, r["end"].astype(np.int64) - 1 + length, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = starts[(starts < ends)]
    begins[first] = gone[first]
    tally = lambda v: np.concatenate([[0], np.cumsum(v, dtype=np.int32)])
    lost, spans = tally(gone), tally(begins)
    kept = data[~gone].tobytes()
    at = np.concatenate([starts, ends[-1:]]) - lost[np.concatenate([starts, ends[-1:]])] if len(ends) else np.zeros(1, np.int64)
    bodies = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = {
        "__key": pa.array(keys, pa.binary()),
        "n_bytes": pa.array(ends - starts, pa.int64()),
        "n_removed": pa.array((lost[ends] - lost[starts]).astype(np.int64)),
        "n_spans": pa.array((spans[ends] - spans[starts]).astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
    }
    if keep_text:
        columns["kept"] = pa.array([x.decode("utf-8", "ignore") for x in bodies], pa.string())
    return pa.table(columns)


def remove_repeats(documents: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", keep_text: bool = False, carry: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that starts in two places or more of the corpus.

    Texts are UTF-8 bytes (null: empty), matches stay within a document, and strings are judged on
    the input. Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256, with keep_text `kept` (what stays as text, without characters that were cut
    into), and with carry `row` (a struct of those columns of the row). Rows repeated whole are copies of
    each other; null keys are kept; texts shorter than `length` stay as they are; a text of any length is in one
    block, of which a task holds one. An empty table gives an empty one.
    """
    spark = documents.sparkSession
    parts = partitions(spark)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    once = documents.select(body.alias("__text")).mapInArrow(batches_task(_once, BLOCKS * parts), "__key binary, __block int, __text string")
    docs = once.repartition(parts, "__block")
    asked = docs.groupBy("__block").applyInArrow(group_task(_ask, length, parts), "part int, block int, keys binary, counts binary")
    flags = asked.groupBy("part").applyInArrow(group_task(_answer, hot), "__block int, keys binary, hot binary")
    sent = docs.groupBy("__block").cogroup(flags.groupBy("__block")).applyInArrow(cogroup_task(_send, length, parts), "part int, block int, kind int, meta binary, text binary, places binary")
    found = sent.groupBy("part").applyInArrow(group_task(_meet, length), "__block int, ranges binary")
    out = "__key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    judged = docs.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(cogroup_task(_removed, length, keep_text), out)
    # A text that very many rows have is one row of `judged`; the many are on the side that a skewed join splits.
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("__key"), *row)
    return rows.join(judged, "__key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text, *["row"] * bool(carry))
