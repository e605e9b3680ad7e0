"""WARC 1.1 records: reading, writing, and a builder of derivative records.

A derivative of an HTTP response is two records that point back to it by
WARC-Refers-To: a metadata record (a JSON account of the response: its WARC and
HTTP headers, title, links) and a conversion record (its plain text).  Both keep
the target URI, date and payload digest of their source and have digests of
their own.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.html import BLOCK, attributes, events

VERSION = "WARC/1.1"
#: Elements and the attributes of theirs that hold links.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "video": "src", "audio": "src", "source": "src"}
_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
_SPACE_OF_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:corvid:warc")


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that follows from what the record is about, so that a task run twice writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, chr(0).join(parts))}>"


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for k, v in self.headers if k.lower() == name), None)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers if k.lower() != "content-length")
        return f"{VERSION}\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def read_records(raw: bytes) -> Iterator[Record]:
    """The records of a WARC file or part of one, gzipped by record or plain.  A record cut short or without a version raises ValueError."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":  # tolerated between records
            at += 2
            continue
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the record at byte {at} has no end of its headers")
        headers: list[tuple[str, str]] = []
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and headers:  # a folded header
                headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
            else:
                k, _, v = line.partition(":")
                headers.append((k.strip(), v.strip()))
        said = next((v for k, v in headers if k.lower() == "content-length"), None)
        if said is None or not said.isdigit() or end + 4 + int(said) > len(raw):
            raise ValueError(f"the record at byte {at} is cut short or has no length")
        at = end + 4 + int(said)
        yield Record(headers, raw[end + 4 : at])


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        head, payload = b"", block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def _grouped(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; one that is repeated has a list of its values, in order."""
    found: dict[str, list[str]] = {}
    for k, v in headers:
        found.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in found.items()}


def _header(headers: list[tuple[str, str]], name: str) -> str:
    return ", ".join(v for k, v in headers if k.lower() == name)


def _unchunked(payload: bytes) -> bytes:
    """A payload without the marks of chunked transfer; as it is if they don't hold from end to end."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return payload
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if at + n > len(payload):
            return payload
        out.append(payload[at : at + n])
        at += n + 2


def _inflated(payload: bytes, coding: str) -> bytes:
    """A gzip or deflate payload unpacked, of one cut short what there is; as it is if it isn't one."""
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in kinds:
        try:
            return zlib.decompressobj(bits).decompress(payload)
        except zlib.error:
            pass
    return payload


def entity(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """What a payload is once transfer and content codings are undone."""
    if "chunked" in _header(http, "transfer-encoding").lower():
        payload = _unchunked(payload)
    for coding in reversed(_header(http, "content-encoding").lower().split(",")):
        payload = _inflated(payload, coding.strip())
    return payload


def decoded(http: list[tuple[str, str]], body: bytes) -> str:
    """A body as text: by its byte order mark, the charset of its Content-Type, a charset named in its first 1024 bytes, or UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said = _CHARSET.search(_header(http, "content-type").encode("latin-1", "replace")) or _CHARSET.search(body[:1024])
    try:
        return body.decode(said[1].decode() if said else "utf-8", "replace")
    except LookupError:  # no codec of that name
        return body.decode("utf-8", "replace")


def response(url: str, payload: bytes, key: str, date: str, content_type: str = "text/html; charset=utf-8") -> Record:
    """A response record for a page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", key, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", sha1_base32(payload)),
        ("WARC-Block-Digest", sha1_base32(block)),
    ]
    return Record(headers, block)


def _one_line(text: str) -> str:
    return "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in text)


def plain_text(page: str) -> tuple[str, str, list[dict[str, str]]]:
    """Visible text (a line a block), title, and links of a page."""
    lines: list[str] = []
    said: list[str] = []
    title, links, hidden = "", [], ""

    def flush() -> None:
        if text := " ".join("".join(said).split()):
            lines.append(text)
        said.clear()

    for what, name, value in events(page):
        if what == "text":
            said.append(value)
        elif what == "raw":
            if name == "title" and not title:
                title = " ".join(_unescaped(value).split())
        elif name in BLOCK or name == "br":
            flush()
        if what == "open" and name in LINKS and value:
            if target := attributes(value).get(LINKS[name]):
                links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": target})
    flush()
    return "\n".join(lines), title, links


def _unescaped(text: str) -> str:
    from html import unescape

    return unescape(text)


def derive(source: Record) -> tuple[Record, Record, dict]:
    """The metadata and the conversion record of a response, and a few facts about them."""
    status, http, payload = split_http(source.block)
    page = decoded(http, entity(http, payload))
    text, title, links = plain_text(page)
    origin = source.get("WARC-Record-ID") or ""
    payload_digest = source.get("WARC-Payload-Digest") or sha1_base32(payload)
    names = [n.lower() for n in ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID")]
    kept = sorted(((k, v) for k, v in source.headers if k.lower() in names), key=lambda h: names.index(h[0].lower()))
    account = {
        "Envelope": {
            "WARC-Header-Metadata": _grouped(source.headers),
            "Actual-Content-Length": len(source.block),
            "Block-Digest": sha1_base32(source.block),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": _grouped(http),
                    "Entity-Length": len(payload),
                    "Entity-Digest": sha1_base32(payload),
                    "HTML-Metadata": {"Head": {"Title": title}, "Links": links},
                }
            },
        }
    }

    def derived(kind: str, content_type: str, block: bytes) -> Record:
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, origin)), *kept, ("WARC-Refers-To", origin), ("WARC-Payload-Digest", payload_digest)]
        return Record([*own, ("Content-Type", content_type), ("WARC-Block-Digest", sha1_base32(block))], block)

    metadata = derived("metadata", "application/json", json.dumps(account, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace"))
    conversion = derived("conversion", "text/plain", text.encode("utf-8", "replace"))
    metadata.headers.append(("WARC-Concurrent-To", conversion.get("WARC-Record-ID")))
    conversion.headers.append(("WARC-Concurrent-To", metadata.get("WARC-Record-ID")))
    return metadata, conversion, {"n_links": len(links), "title": title, "payload_digest": payload_digest, "payload_ok": payload_digest == sha1_base32(payload)}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(key, url, record): a response record for each page.  Null html counts as an empty payload, a null url as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                bodies = [h or b"" for h in part.column(2).to_pylist()]
                made = [response(u or "", h, str(k), date).to_bytes() for k, u, h in zip(keys, urls, bodies)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["key", "url", "record"])

    return pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("html")).mapInArrow(run, "key long, url string, record binary")


RESULT = T.StructType([T.StructField("key", T.LongType()), T.StructField("record_type", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("source_id", "target_uri", "metadata_id", "conversion_id", "payload_digest", "metadata_digest", "conversion_digest", "title", "metadata", "conversion", "error")] + [T.StructField("payload_ok", T.BooleanType()), T.StructField("n_links", T.LongType()), T.StructField("text_bytes", T.LongType())])
_ARROW = [pa.int64(), *[pa.string()] * 12, pa.bool_(), pa.int64(), pa.int64()]


def derivatives(records: DataFrame, key_col: str = "key", record_col: str = "record", with_records: bool = True) -> DataFrame:
    """Metadata and conversion records of response records.

    ``records`` has a key and the bytes of one or more records a row; a row comes out for each record in them, of any
    type: other types than response have ids and no derivatives.  Bytes that aren't WARC give one row with ``error``;
    null and empty bytes give one with error "empty".  ``with_records=False`` leaves the derivative records' own text null.
    A payload that doesn't match the digest its source states has payload_ok false and is converted all the same.
    Digests are of the payload as it came; its text is made after transfer and content codings are undone, in the charset
    that it names.  Headers that are repeated are all kept.  Repeated rows give repeated records.  Other columns aren't
    read.  No shuffle; a record is worked off alone.
    """

    def rows(key: int, raw: bytes | None) -> Iterator[tuple]:
        nothing = (None,) * 12
        if not raw:
            yield (key, None, *nothing[:10], "empty", None, None, None)
            return
        try:
            for source in read_records(raw):
                kind = source.get("WARC-Type")
                if kind != "response":
                    yield (key, kind, source.get("WARC-Record-ID"), source.get("WARC-Target-URI"), *nothing[:9], None, None, None)
                    continue
                meta, conv, facts = derive(source)
                own = (meta.to_bytes().decode(), conv.to_bytes().decode()) if with_records else (None, None)
                yield (key, kind, source.get("WARC-Record-ID"), source.get("WARC-Target-URI"), meta.get("WARC-Record-ID"), conv.get("WARC-Record-ID"), facts["payload_digest"], meta.get("WARC-Block-Digest"), conv.get("WARC-Block-Digest"), facts["title"], *own, None, facts["payload_ok"], facts["n_links"], len(conv.block))
        except (ValueError, EOFError, OSError) as e:
            yield (key, None, *nothing[:10], str(e), None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [r for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(key, raw)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _ARROW)], RESULT.names)

    return records.select(F.col(key_col).cast("long").alias("key"), F.col(record_col).alias("record")).mapInArrow(run, RESULT)


def save(derived: DataFrame, path: str, column: str) -> None:
    """Write the derivative records in ``column`` ("metadata" or "conversion") as gzipped WARC files, one a partition."""
    derived.where(F.col(column).isNotNull()).select(F.regexp_replace(column, r"\r\n\r\n\z", "").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
