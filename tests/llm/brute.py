"""Plain versions of the operators, for small data."""

import base64
import hashlib
import html
import json
import re
import uuid
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def removed(rows, length):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(t, width):
    w = WORD.findall(lower(t))
    return [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def fingerprint(t, width):
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(t, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(rows, width, radius):
    f = [fingerprint(t, width) for _, t in rows]
    of = groups(len(rows), lambda i, j: (f[i] ^ f[j]).bit_count() <= radius)
    least = {}
    for (d, _), g in zip(rows, of, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return [(d, f"{x:016x}", least[g]) for (d, _), x, g in zip(rows, f, of, strict=True)]


def near_duplicates_kept(rows, width, similarity):
    sets = [set(shingles(t, width)) for _, t in rows]

    def like(i, j):
        if (rows[i][1] or "") == (rows[j][1] or ""):
            return True
        both = len(sets[i] & sets[j])
        return both > 0 and both >= similarity * (len(sets[i]) + len(sets[j]) - both)

    of = groups(len(rows), like)
    best = {}
    for (d, _), g in zip(rows, of, strict=True):
        best[g] = min((x for x in (best.get(g), d) if x is not None), default=None)
    return sorted(best.values(), key=str)


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = np.zeros(len(w), bool)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            again[i : i + 8] = True
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, int(again.sum())


def best_two_fit(sizes, capacity):
    """Bins, one after the other: filled with the longest that fits, then the shortest goes for two that fill more."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        made, gap = [], capacity
        while x := next((x for x in left if x <= gap), 0):
            made.append(x)
            left.remove(x)
            gap -= x
        while gap:
            least = min(made)
            pairs = [(left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if least < left[i] + left[j] <= gap + least]
            if not pairs:
                break
            total = max(map(sum, pairs))
            # Of the pairs that fill most, the one with the least piece.
            two = min((min(p), p) for p in pairs if sum(p) == total)[1]
            made.remove(least)
            left.append(least)
            for x in two:
                made.append(x)
                left.remove(x)
            left.sort(reverse=True)
            gap += least - total
        bins.append(sorted(made, reverse=True))
    return bins


_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<head\b[^>]*>.*?</head\s*>")
_BREAK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul)\b[^>]*>")


def visible(page):
    page = re.sub(r"\s+", " ", _HIDDEN.sub(" ", page))
    page = re.sub(r"<[!/?a-zA-Z][^>]*>", "", _BREAK.sub("\n", page))
    return "\n".join(y for x in html.unescape(page).split("\n") if (y := " ".join(x.split())))


def warc(key, url, page, date):
    """The two derived records of a page, made by regular expressions, as (key, type, id, refers to, uri, payload digest, block digest, length, record)."""
    url, page = url or "", page or ""
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    x = hashlib.sha1("\n".join([str(key), url, page]).encode()).hexdigest()
    refers = f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:32]}>"
    sent = [["Content-Type", "text/html; charset=utf-8"]]
    size = len(page.encode()) + len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    source = [["WARC-Type", "response"], ["WARC-Record-ID", refers], ["WARC-Target-URI", url], ["WARC-Date", date], ["Content-Type", "application/http; msgtype=response"], ["Content-Length", str(size)]]
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", page)
    lang = re.search(r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([\w-]+)""", page)
    links = [next(v for v in m if v) for m in re.findall(r"""(?is)<a\b[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.sub(r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->", "", page)) if any(m)]
    fields = [("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("languages", lang[1] if lang else ""), ("source-headers", json.dumps(source, ensure_ascii=False)), ("source-http-headers", json.dumps(sent))]
    fields += [("outlink", html.unescape(v)) for v in links]
    about = "".join(f"{n}: {re.sub('[\r\n]+', ' ', v)}\r\n" for n, v in fields if v).encode()
    out = []
    for kind, block, mime in (("metadata", about, "application/warc-fields"), ("conversion", visible(page).encode(), "text/plain; charset=utf-8")):
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers} {kind}')}>"
        heads = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Refers-To": refers, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": sha(page.encode()), "WARC-Block-Digest": sha(block), "Content-Type": mime, "Content-Length": str(len(block))}
        record = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in heads.items() if v) + "\r\n"
        out.append((key, kind, name, refers, url, sha(page.encode()), sha(block), len(block), record.encode() + block + b"\r\n\r\n"))
    return out
