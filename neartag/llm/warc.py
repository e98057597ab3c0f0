"""WARC derivatives: metadata and plain-text records made from responses (operator 8).

A response record (WARC/1.0 header, HTTP header, payload) gives two linked records: a
``conversion`` with the plain text of the page and a ``metadata`` record with a JSON body.
Both name the response in WARC-Refers-To and keep its target and date.  The JSON holds the
source headers of the response, its HTTP headers, title, links and digests, and names the
conversion.  Record ids are derived from the source's id, so a repeated or retried run makes
equal records.

Records are rows with their bytes in a binary column; every row is independent, and any
Spark source or sink can hold them.  Digests are ``sha1:`` and base 32.

A null html is an empty payload and a null url leaves the target out; both still give all
records.  Repeated rows give equal records with equal ids.  A response without a record id
gets one from its bytes.  Bytes that are no response record give ``error`` and no records.

Transfer encodings (chunked, gzip, deflate) and content encodings (gzip, deflate) are undone
before the text is taken; digests and lengths of the payload are those of the stored bytes.
Unknown or broken encodings give ``error``.  The charset is that of the byte order mark, the HTTP
header or the page's meta element, else UTF-8.
Empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import slices

VERSION = "WARC/1.0"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs (RFC 4122)
DATE = "1970-01-01T00:00:00Z"  # for sources that carry no date
# Elements that begin and end a line of text.
BLOCKS = frozenset("""address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section table tbody td tfoot th thead title tr ul""".split())
# Each alternative takes its first way and never goes back, so a page is read in linear time.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>", re.S | re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^>]*+>", re.I), re.compile(r"</title", re.I)
HREF = re.compile(r"\shref\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
META_CHARSET = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w.:-]+)", re.I)
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def open_at_end(head: str) -> bool:
    """Whether a comment, script or the like has no end."""
    last = None
    for last in MARKUP.finditer(head):
        pass
    if last is None or last.end() < len(head):
        return False
    text = last[0]
    return text.startswith("<!--") and not text.endswith("-->") or bool(last[1]) and not re.search(r"</" + last[1] + r"\s*>\Z", text, re.I)


def read_page(page: str) -> tuple[str, str, list[str]]:
    """Plain text, title and link targets of a page.

    The text has a line per block; white space is folded, scripts and comments are left out.
    """
    links: list[str] = []

    def gap(found: re.Match) -> str:
        name = (found[3] or "").lower()
        if name == "a" and not found[2]:
            target = HREF.search(found[0])
            if target:
                links.append(html.unescape(target[1] or target[2] or target[3] or ""))
        return "\n" if name in BLOCKS else ""

    # Line ends of the source are white space; only blocks begin a line.
    folded = " ".join(page.split())
    # Behind the last ">" no tag can end, so what is there is text, or an open comment or script.
    last = folded.rfind(">") + 1
    head, tail = folded[:last], folded[last:]
    marked = MARKUP.sub(gap, head)
    if tail.strip() and open_at_end(head):
        tail = ""
    lines = (" ".join(line.split()) for line in html.unescape(marked + tail).split("\n"))
    begin = TITLE.search(head)
    end = TITLE_END.search(head, begin.end()) if begin else None
    title = " ".join(html.unescape(MARKUP.sub("", head[begin.end():end.start()])).split()) if end else ""
    return "\n".join(line for line in lines if line), title, links


def plain_text(page: str) -> str:
    return read_page(page)[0]


@dataclass
class Record:
    """Headers in their order, and the block."""

    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"{VERSION}\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def headers_of(lines: list[bytes]) -> list[tuple[str, str]]:
    """Name and value of header lines; a line that begins with white space goes on with the last."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def parse(data: bytes) -> Record:
    """A record from its bytes; raises ValueError if they are none."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or not first.startswith(b"WARC/"):
        raise ValueError("no record header")
    record = Record(headers_of(lines))
    length = record.get("Content-Length") or ""
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("wrong Content-Length")
    record.block = rest[:int(length)]
    record.headers = [(k, v) for k, v in record.headers if k.lower() != "content-length"]
    return record


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; trailers are left out."""
    parts, at = [], 0
    while True:
        size = CHUNK_SIZE.match(data, at)
        if not size:
            raise ValueError("broken chunk")
        at = size.end()
        length = int(size[1], 16)
        if not length:
            return b"".join(parts)
        if at + length > len(data):
            raise ValueError("broken chunk")
        parts.append(data[at:at + length])
        at += length
        at += 2 if data[at:at + 2] == b"\r\n" else data[at:at + 1] == b"\n"


def inflated(data: bytes, kind: str) -> bytes:
    """gzip (of one or more members) or deflate (with or without the zlib header) undone."""
    if kind == "deflate":
        try:
            return whole(zlib.decompressobj(), data)
        except ValueError:
            return whole(zlib.decompressobj(-zlib.MAX_WBITS), data)
    parts, rest = [], data
    while rest.startswith(b"\x1f\x8b") or not parts:
        member = zlib.decompressobj(16 + zlib.MAX_WBITS)
        parts.append(whole(member, rest))
        rest = member.unused_data
    return b"".join(parts)


def whole(stream, data: bytes) -> bytes:
    try:
        out = stream.decompress(data) + stream.flush()
    except zlib.error as error:
        raise ValueError("broken compression") from error
    if not stream.eof:
        raise ValueError("broken compression")
    return out


def decoded(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings, the last applied undone first."""
    for header in ("transfer-encoding", "content-encoding"):
        kinds = [kind.strip().lower() for k, v in http if k.lower() == header for kind in v.split(",")]
        for kind in reversed(kinds):
            if kind == "chunked":
                payload = unchunked(payload)
            elif kind in ("gzip", "x-gzip", "deflate"):
                payload = inflated(payload, kind) if payload else payload
            elif kind not in ("identity", ""):
                raise ValueError(f"unknown encoding {kind}")
    return payload


def page_of(payload: bytes, named: str | None) -> str:
    """Characters of a page: by its byte order mark, the charset of the HTTP header, or its own meta element."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark):].decode(charset, "replace")
    if named is None and (found := META_CHARSET.search(payload[:1024])):
        named = found[1].decode()
        if named.lower().startswith("utf-16"):
            named = "utf-8"  # the element could not have been read otherwise
    try:
        return payload.decode(named or "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def response_of(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a fetched page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", urn(f"{page_id}\n{url or ''}\n{hashlib.sha1(payload).hexdigest()}")), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(url.split())))
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                ("Content-Type", "application/http; msgtype=response")]
    return Record(headers, block).to_bytes()


@dataclass
class Derived:
    response_id: str
    target: str | None
    payload_digest: str
    title: str
    links: list[str]
    text: str
    conversion_id: str
    text_digest: str
    conversion: bytes
    metadata_id: str
    metadata: bytes


def derive(data: bytes) -> Derived:
    """The conversion and metadata records of a response record."""
    source = parse(data)
    if (source.get("WARC-Type") or "").lower() != "response":
        raise ValueError("no response")
    head, blank, payload = source.block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP header")
    status, *lines = head.split(b"\r\n")
    http = headers_of(lines)
    named = CHARSET.search(head)
    page = page_of(decoded(payload, http), named[1].decode() if named else None)
    response_id = source.get("WARC-Record-ID") or urn(hashlib.sha1(data).hexdigest())
    target = source.get("WARC-Target-URI")
    kept = [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := source.get(k)) is not None]
    text, title, references = read_page(page)
    body = text.encode("utf-8", "surrogatepass")
    links = []
    for reference in references:
        try:
            links.append(urljoin(target or "", reference))
        except ValueError:
            links.append(reference)
    payload_digest, text_digest = source.get("WARC-Payload-Digest") or digest(payload), digest(body)
    conversion_id, metadata_id = urn(f"{response_id} conversion"), urn(f"{response_id} metadata")
    conversion = Record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), ("WARC-Refers-To", response_id), *kept,
                         ("WARC-Block-Digest", text_digest), ("Content-Type", "text/plain; charset=utf-8")], body)
    about = json.dumps({
        "source": {"headers": source.headers, "payload-digest": payload_digest, "payload-length": len(payload)},
        "http": {"status": status.decode("utf-8", "replace"), "headers": http},
        "html": {"title": title, "links": links}, "conversion": {"id": conversion_id, "digest": text_digest, "length": len(body)},
    }, ensure_ascii=False).encode("utf-8", "surrogatepass")
    metadata = Record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), ("WARC-Refers-To", response_id), *kept,
                       ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/json")], about)
    return Derived(response_id, target, payload_digest, title, links, text, conversion_id, text_digest, conversion.to_bytes(), metadata_id, metadata.to_bytes())


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record: response records of pages (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [response_of(i, u.as_py(), h.as_py(), date) for i, u, h in zip(batch["page_id"].to_pylist(), batch["url"], batch["html"])]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


FIELDS = {"response_id": pa.string(), "target": pa.string(), "payload_digest": pa.string(), "title": pa.string(), "links": pa.list_(pa.string()),
          "text": pa.string(), "conversion_id": pa.string(), "text_digest": pa.string(), "conversion": pa.binary(),
          "metadata_id": pa.string(), "metadata": pa.binary(), "error": pa.string()}


def derivatives(records: DataFrame, key: str = "page_id", columns: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The key and the fields of the derived records of each response record (key, record).

    ``conversion`` and ``metadata`` are whole records; ``columns`` leaves out what is not needed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch["record"]:
                try:
                    rows.append(vars(derive(data.as_py() or b"")) | {"error": None})
                except ValueError as error:
                    rows.append(dict.fromkeys(FIELDS) | {"error": str(error)})
            yield pa.RecordBatch.from_arrays([batch[key], *[pa.array([r[c] for r in rows], FIELDS[c]) for c in columns]], [key, *columns])

    kinds = {pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{c} {kinds.get(FIELDS[c], 'array<string>')}" for c in columns)
    return records.select(F.col(key).cast("bigint").alias(key), "record").mapInArrow(run, f"{key} long, {schema}")
