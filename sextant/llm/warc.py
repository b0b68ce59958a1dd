"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import batches_task

Headers = list[tuple[str, str]]

#: Derived record ids are name-based, so that a rebuild gives the same records.
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_HIDDEN = {"script", "style", "noscript", "template", "svg"}
_BREAKS = set(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
_LANG = re.compile(r"""(?is)\slang\s*=\s*["']?([\w-]+)""")
_HREF = re.compile(r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_LONG_REFERENCE = re.compile(r"(?i)&#(?:x[0-9a-f]{9,}|[0-9]{9,});?")  # no character has such a number

SCHEMA = "key long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(parts))}>"


def unescaped(text: str) -> str:
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", text))


def read_page(page: str) -> tuple[str, str, list[str], str]:
    """Title, language, link targets and visible text of HTML (a line per block, white space runs as one space, entities resolved).

    One pass, in time linear in the page: where an element ends is looked up once for all that are
    opened before. Unclosed hidden elements and comments hide the rest; an unclosed head hides nothing.
    """
    closing: dict[str, tuple[int, int]] = {}

    def closed(name: str, at: int) -> tuple[int, int]:
        """Where the next end tag of a name begins and ends; -1 if there is none."""
        if name not in closing or 0 <= closing[name][0] < at:
            found = re.compile(rf"(?i)</{name}\s*>").search(page, at)
            closing[name] = found.span() if found else (-1, -1)
        return closing[name]

    out: list[str] = []
    title, lang, links = "", "", []
    titled, at, shown = False, 0, 0  # shown: text before it is not
    while (tag := page.find("<", at)) >= 0 and tag + 1 < len(page):
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            out += [page[max(at, shown) : tag].replace("\n", " "), " "]
            at = len(page) if end < 0 else end + 3
            continue
        if not (page[tag + 1] in "!/?" or page[tag + 1].isascii() and page[tag + 1].isalpha()):
            out.append(page[max(at, shown) : tag + 1].replace("\n", " "))
            at = tag + 1
            continue
        end = page.find(">", tag)
        if end < 0:
            break
        out.append(page[max(at, shown) : tag].replace("\n", " "))
        at = end + 1
        name = _NAME.match(page, tag, at)
        name = name[1].lower() if name else ""
        if page[tag + 1] != "/":
            if name in _HIDDEN:
                _, stop = closed(name, at)
                out.append(" ")
                at = len(page) if stop < 0 else stop
            elif name == "head":
                shown = max(shown, closed(name, at)[1])
                out.append(" ")
            elif name == "title" and not titled and (stop := closed(name, at)[0]) >= 0:
                title, titled = " ".join(unescaped(page[at:stop]).split()), True
            elif name == "html" and not lang and (found := _LANG.search(page, tag, at)):
                lang = found[1]
            elif name == "a" and (found := _HREF.search(page, tag, at)) and (to := next((x for x in found.groups() if x), "")):
                links.append(unescaped(to))
        if name in _BREAKS and tag >= shown:
            out.append("\n")
    out.append(page[max(at, shown) :].replace("\n", " "))
    lines = (" ".join(x.split()) for x in unescaped("".join(out)).split("\n"))
    return title, lang, links, "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    """Visible text of HTML."""
    return read_page(page)[3]


_BREAK = re.compile(r"[\r\n]+")


def _flat(value: str) -> str:
    return _BREAK.sub(" ", value) if "\n" in value or "\r" in value else value


def serialise(headers: Headers, block: bytes) -> bytes:
    """A WARC/1.1 record; line breaks in header values become spaces."""
    head = "".join(f"{name}: {_flat(value)}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> Headers:
    """Names and values in their order, repeated ones each; a line that begins with a space goes on with the one before."""
    out: Headers = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif ":" in x:
            name, _, value = x.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value_of(headers: Headers, name: str, default: str = "") -> str:
    """The first value of a header, whatever its case."""
    return next((v for n, v in headers if n.lower() == name), default)


def opened(data: bytes) -> bytes:
    """The content of a file of gzip members, up to where one is cut off or damaged; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest) + member.flush())
        except zlib.error:
            break
        rest = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record; gzip members are opened. A record that is cut off ends the file.

    A record without a length that is a number is left out; the next one is looked for behind its headers.
    """
    data = opened(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _headers(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = value_of(headers, "content-length")
        at = end + 4
        if not (size.isascii() and size.isdigit() and len(size) < 19):
            continue
        if at + int(size) > len(data):
            return
        yield headers, data[at : at + int(size)]
        at += int(size)


def http(block: bytes) -> tuple[Headers, bytes]:
    """Headers and payload of an HTTP response; a block that is none is a payload without headers."""
    if block[:5] != b"HTTP/":
        return [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    return _headers(head.decode("latin-1").split("\r\n")[1:]), payload


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


def page_of(headers: Headers, payload: bytes) -> str:
    """The text of a payload, by the HTTP headers that say how it is sent, packed and encoded; what cannot be read so is read as it is."""
    if "chunked" in value_of(headers, "transfer-encoding").lower():
        payload = _unchunked(payload)
    packed = value_of(headers, "content-encoding").lower()
    for name, bits in (("gzip", (31,)), ("deflate", (15, -15))):
        for b in bits if name in packed else ():
            try:
                payload = zlib.decompressobj(b).decompress(payload)
                break
            except zlib.error:
                continue
    charset = re.search(r"""(?i)charset\s*=\s*["']?([\w.:-]+)""", value_of(headers, "content-type"))
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def derive(source: Headers, payload: bytes, sent: Headers = ()) -> list[dict]:
    """The metadata and the conversion record of a response, from its headers, its payload and its HTTP headers.

    Both refer to the response, keep its target and date, and give the digest of the payload they
    come from; all source headers, in order and with repeats, go into the metadata block. A response without an
    id is referred to by none, and its records' ids come from its target and payload.
    """
    refers, uri, date = (value_of(source, n) for n in ("warc-record-id", "warc-target-uri", "warc-date"))
    whole = value_of(source, "warc-payload-digest") or digest(payload)
    title, lang, links, text = read_page(page_of(list(sent), payload))
    listed = lambda h: json.dumps([list(x) for x in h], ensure_ascii=False)
    fields = [("title", title), ("languages", lang), ("source-headers", listed(source)), ("source-http-headers", listed(sent) if sent else "")]
    fields += [("outlink", x) for x in links]
    about = "".join(f"{n}: {_flat(v)}\r\n" for n, v in fields if v).encode("utf-8", "replace")
    out = []
    for kind, block, mime in (("metadata", about, "application/warc-fields"), ("conversion", text.encode("utf-8", "replace"), "text/plain; charset=utf-8")):
        name = record_id(refers or f"{uri} {whole}", kind)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", whole), ("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
        out.append({"record_type": kind, "record_id": name, "refers_to": refers or None, "target_uri": uri, "payload_digest": whole, "block_digest": digest(block), "content_length": len(block), "record": serialise([h for h in headers if h[1]], block)})
    return out


def _derived(batches):
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
    for batch in batches:
        for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for headers, block in parse(content.as_py() or b""):
                if value_of(headers, "warc-type").lower() == "response":
                    sent, payload = http(block)
                    rows += [{"key": key, **x} for x in derive(headers, payload, sent)]
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def archived(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as WARC response records: key and content (binary). Null urls and bodies count as empty."""
    uri, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (url, body))
    name = F.sha1(F.concat_ws("\n", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), uri, text))
    urn = F.concat(F.lit("<urn:uuid:"), *(p for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for p in ([F.lit("-")] if i else []) + [F.substring(name, a, n)]), F.lit(">"))
    sent = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: ", urn, "\r\nWARC-Target-URI: ", F.regexp_replace(uri, "[\r\n]+", " "), f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", (F.octet_length(text) + len(sent)).cast("string"), "\r\n\r\n", sent, text, "\r\n\r\n"]
    record = F.encode(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines)), "UTF-8")
    return pages.select(F.col(f"`{key}`").cast("long").alias("key"), record.alias("content"))


def derivatives(archives: DataFrame) -> DataFrame:
    """Two rows for each response record of the archives (key, content: one record or more, or a whole file): its metadata and its conversion.

    Ids are name-based on the response's id, so equal responses give equal records, and repeated rows
    are kept. Empty payloads give empty conversion blocks; null contents, records of other types and damaged records
    give none. Responses of any length are converted whole; a content is held by one task. Other columns are left out.
    """
    return archives.select("key", "content").mapInArrow(batches_task(_derived), SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """WARC files, which may be gzipped, as archives: a row per file of up to 2 GB, as Spark reads them."""
    return spark.read.format("binaryFile").load(path).select(F.lit(None).cast("long").alias("key"), "content")
