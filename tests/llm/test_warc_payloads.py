import base64
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import urljoin

import pytest

from neartag.llm import queries, warc
from tests.llm.test_models_and_files import SMALL, Reader


def response(http: bytes, payload: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def chunked(data: bytes, size: int = 5) -> bytes:
    parts = [data[i:i + size] for i in range(0, len(data), size)]
    return b"".join(b"%X;note=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def raw_deflate(data: bytes) -> bytes:
    made = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    return made.compress(data) + made.flush()


PAGE = "<title>Käse</title><p>größe straße".encode()


@pytest.mark.parametrize("http, payload", [
    (b"Content-Encoding: gzip", gzip.compress(PAGE)),
    (b"Content-Encoding: X-GZIP", gzip.compress(PAGE[:10]) + gzip.compress(PAGE[10:])),
    (b"Content-Encoding: deflate", zlib.compress(PAGE)),
    (b"Content-Encoding: deflate", raw_deflate(PAGE)),
    (b"Transfer-Encoding: chunked", chunked(PAGE)),
    (b"Transfer-Encoding: gzip, chunked", chunked(gzip.compress(PAGE), 7)),
    (b"Content-Encoding: deflate, gzip\r\nTransfer-Encoding: chunked", chunked(gzip.compress(zlib.compress(PAGE)))),
    (b"Content-Encoding: identity", PAGE),
])
def test_encoded_payloads(http, payload):
    made = warc.derive(response(http, payload))
    assert made.text == "Käse\ngröße straße" and made.title == "Käse"
    # Digest and length are those of the stored payload.
    assert made.payload_digest == warc.digest(payload)
    assert json.loads(warc.parse(made.metadata).block)["source"]["payload-length"] == len(payload)


@pytest.mark.parametrize("http, payload", [
    (b"Content-Encoding: br", b"x"), (b"Content-Encoding: gzip", b"no gzip"), (b"Content-Encoding: gzip", gzip.compress(PAGE)[:-9]),
    (b"Content-Encoding: deflate", b"\xff\xff"), (b"Transfer-Encoding: chunked", b"zz\r\n"), (b"Transfer-Encoding: chunked", b"9\r\nshort"),
])
def test_broken_or_unknown_encodings(spark, http, payload):
    with pytest.raises(ValueError):
        warc.derive(response(http, payload))
    rows = spark.createDataFrame([(1, bytearray(response(http, payload))), (2, bytearray(response(b"A: b", PAGE)))], "page_id long, record binary")
    got = {r.page_id: r for r in warc.derivatives(rows).collect()}
    assert got[1].error and got[1].conversion is None and got[2].error is None


@pytest.mark.parametrize("http, payload", [
    (b"Content-Type: text/html", '<meta charset="windows-1252"><p>größe'.encode("cp1252")),
    (b"Content-Type: text/html", b"<meta http-equiv=Content-Type content='text/html; charset=latin-1'><p>" + "größe".encode("latin-1")),
    (b"Content-Type: text/html; charset=utf-8", '<meta charset="latin-1"><p>größe'.encode()),
    (b"Content-Type: text/html; charset=latin-1", "﻿<p>größe".encode()),
    (b"Content-Type: text/html", "﻿<p>größe".encode("utf-16-le")),
    (b"Content-Type: text/html; charset=none-such", "<p>größe".encode()),
    (b"Content-Type: text/html", '<meta charset="utf-16"><p>größe'.encode()),
    (b"Content-Type: text/html; charset=hex", "<p>größe".encode()),
])
def test_charsets(http, payload):
    assert warc.derive(response(http, payload)).text == "größe"


class Full(Reader):
    """Title and links besides the text."""

    def __init__(self):
        super().__init__()
        self.titles, self.links, self.title = [], [], 0

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        self.title += tag == "title"
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.title -= tag == "title"

    def handle_data(self, data):
        super().handle_data(data)
        if self.title:
            self.titles.append(data)


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_query_equals_records_made_by_hand(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_warc(spark, SMALL).collect()}
    assert len(got) == len(pages) and all(r.error is None for r in got.values())
    for page in pages:
        reader = Full()
        reader.feed(page.html)
        reader.close()
        r, payload, body = got[page.page_id], page.html.encode(), reader.text().encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        source, target = urn(f"{page.page_id}\n{page.url}\n{hashlib.sha1(payload).hexdigest()}"), "".join(page.url.split())
        conversion, metadata, date = urn(f"{source} conversion"), urn(f"{source} metadata"), "1970-01-01T00:00:00Z"
        title = " ".join("".join(reader.titles).split())
        assert (r.response_id, r.target, r.payload_digest, r.title, r.n_links) == (source, target, sha1(payload), title, len(reader.links))
        assert (r.conversion_id, r.metadata_id, r.text_digest) == (conversion, metadata, sha1(body))
        linked = [("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date)]
        made = record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion), *linked, ("WARC-Block-Digest", sha1(body)),
                       ("Content-Type", "text/plain; charset=utf-8")], body)
        assert r.conversion_sha256 == hashlib.sha256(made).hexdigest()
        headers = [["WARC-Type", "response"], ["WARC-Record-ID", source], ["WARC-Date", date], ["WARC-Target-URI", target],
                   ["WARC-Payload-Digest", sha1(payload)], ["WARC-Block-Digest", sha1(http + payload)], ["Content-Type", "application/http; msgtype=response"]]
        about = json.dumps({
            "source": {"headers": headers, "payload-digest": sha1(payload), "payload-length": len(payload)},
            "http": {"status": "HTTP/1.1 200 OK", "headers": [["Content-Type", "text/html; charset=utf-8"], ["Content-Length", str(len(payload))]]},
            "html": {"title": title, "links": [urljoin(target, x) for x in reader.links]},
            "conversion": {"id": conversion, "digest": sha1(body), "length": len(body)}}, ensure_ascii=False).encode()
        made = record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata), *linked, ("WARC-Block-Digest", sha1(about)),
                       ("Content-Type", "application/json")], about)
        assert r.metadata_sha256 == hashlib.sha256(made).hexdigest()
