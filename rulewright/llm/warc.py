"""WARC derivatives: from responses, linked metadata records and plain-text conversion records.

A derivative keeps what ties it to its source: WARC-Refers-To has the response's record id, the target URI and date are
the response's, and all its headers, repeated ones too, and digests are listed in the metadata. Record ids are derived from
the source's id and the kind, so a job that is run again makes the same records. Pages that were kept without a record
get a response record, which is written as well. Bodies are taken out of chunked transfer coding and of gzip and deflate;
one in another coding has no text, and the metadata says so. ``parse`` and ``write`` are WARC/1.1 records, plain or
with a gzip member for each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare_workers

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {source}')}>"


class Headers(dict):
    """The first value of each name; ``pairs`` has every header in order, repeated ones too."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__(reversed(pairs))
        self.pairs = pairs


def pairs_of(headers: dict[str, str]) -> list[tuple[str, str]]:
    return headers.pairs if isinstance(headers, Headers) else list(headers.items())


def write(headers: dict[str, str], block: bytes, compressed: bool = False) -> bytes:
    """One record; Content-Length is set. Line ends within values become blanks."""
    kept = [(k, v) for k, v in pairs_of(headers) if k.lower() != "content-length"]
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in [*kept, ("Content-Length", str(len(block)))])
    record = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compressed else record


def _headers(data: bytes) -> Headers:
    out: list[tuple[str, str]] = []
    for line in re.sub(rb"\r?\n[ \t]+", b" ", data).splitlines():
        name, found, value = line.partition(b":")
        if found:
            out.append((name.decode("utf-8", "replace").strip(), value.decode("utf-8", "replace").strip()))
    return Headers(out)


def unchunk(body: bytes) -> bytes:
    """A chunked body's data; what can't be read as chunks is kept as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return body if not out else b"".join(out)
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _plain(body: bytes, http: dict[str, str]) -> bytes | None:
    """A body without its codings; None for one that isn't known or is damaged."""
    if "chunked" in (field(http, "Transfer-Encoding") or "").lower():
        body = unchunk(body)
    for coding in reversed((field(http, "Content-Encoding") or "").lower().replace(" ", "").split(",")):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
            elif coding not in ("", "identity"):
                return None
        except (OSError, EOFError, zlib.error):
            return None
    return body


def field(headers: dict[str, str], name: str) -> str | None:
    """A header by name, whatever its case."""
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file. A damaged gzip member or record ends the file."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        whole, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                whole.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        stream = io.BytesIO(b"".join(whole))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        head = bytearray()
        while (line := stream.readline()).strip():
            head += line
        headers = _headers(bytes(head))
        size = field(headers, "Content-Length") or ""
        block = stream.read(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            return
        yield headers, block


def to_text(page: str) -> str:
    """Plain text of HTML: scripts, styles and comments dropped, block ends as line ends, entities decoded, blanks tidied."""
    page = _TAG.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def respond(url: str, page: str, date: str, key: str = "") -> tuple[dict[str, str], bytes]:
    """A response record of a page that was kept without one; key tells apart pages of equal address and text."""
    body = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", f"{key}{date} {url} {digest(block)}"), "WARC-Date": date, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body),
    }
    return headers, block


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The conversion and the metadata record of a response; nothing for records of other types."""
    if (field(headers, "WARC-Type") or "").lower() != "response":
        return []
    source = field(headers, "WARC-Record-ID") or record_id("response", digest(block))
    cut = re.search(rb"\r?\n\r?\n", block)
    top, body = (block[: cut.start()], block[cut.end() :]) if cut else (b"", block)
    status, _, rest = top.partition(b"\n")
    http = _headers(rest)
    raw, body = body, _plain(body, http)
    unknown, body = body is None, body or b""
    named = _CHARSET.search((field(http, "Content-Type") or "").encode()) or _CHARSET.search(body[:2048])
    try:
        page = body.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = to_text(page).encode()
    title = _TITLE.search(page)
    linked = {"WARC-Refers-To": source}
    for name, own in (("WARC-Target-URI", "WARC-Refers-To-Target-URI"), ("WARC-Date", "WARC-Refers-To-Date")):
        if value := field(headers, name):
            linked |= {name: value, own: value}
    conversion = {
        "WARC-Type": "conversion", "WARC-Record-ID": record_id("conversion", source), **linked, "Content-Type": "text/plain; charset=utf-8",
        "WARC-Block-Digest": digest(text), "WARC-Payload-Digest": digest(text),
    }
    about = [("source-status", status.decode("utf-8", "replace").strip())]
    about += [(f"source-{k}", v) for k, v in pairs_of(headers)]
    about += [(f"http-{k}", v) for k, v in pairs_of(http)]
    about += [("unsupported-coding", field(http, "Content-Encoding") or "")] if unknown else []
    about += [("payload-digest", digest(raw)), ("conversion", conversion["WARC-Record-ID"]), ("text-length", str(len(text)))]
    about += [("title", " ".join(html.unescape(_TAG.sub("", title[1])).split()))] if title else []
    about += [("outlink", " ".join(html.unescape(a or b or c).split())) for a, b, c in _LINK.findall(_DROPPED.sub(" ", page))]
    fields = "".join(f"{k}: {v}\r\n" for k, v in about).encode()
    metadata = {"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", source), **linked, "WARC-Concurrent-To": conversion["WARC-Record-ID"], "Content-Type": "application/warc-fields", "WARC-Block-Digest": digest(fields)}
    return [(conversion, text), (metadata, fields)]


def build_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, kind, record_id, refers_to, target_uri, source_payload_digest, block_digest string, content_length long, record binary).

    pages has page_id, url and html: a row for each response, which refers to none, and for both its derivatives. Or it has warc binary
    instead of html, a file of records: a row for both derivatives of each response. A null url is an empty target, a null page
    an empty one, a null or damaged file gives the records before the damage. Equal rows give equal records.
    """
    prepare_workers(pages.sparkSession)
    files = "warc" in pages.columns
    kind = pages.schema["page_id"].dataType.simpleString()
    columns = ["page_id", "warc"] if files else ["page_id", "url", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, out, ids = [], [], batch.column(0).to_pylist()
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                records = parse(row[0] or b"") if files else [respond(row[0] or "", row[1] or "", date, f"{ids[i]} ")]
                for headers, block in records:
                    for made, text in [*([] if files else [(headers, block)]), *derive(headers, block)]:
                        source.append(i)
                        out.append((made["WARC-Type"], made["WARC-Record-ID"], made.get("WARC-Refers-To"), made.get("WARC-Target-URI"), field(headers, "WARC-Payload-Digest"), made["WARC-Block-Digest"], len(text), write(made, text)))
            lists = zip(*out, strict=True) if out else [[]] * 8
            types = (*[pa.string()] * 6, pa.int64(), pa.binary())
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, t) for x, t in zip(lists, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "kind", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_length", "record"])

    types = f"page_id {kind}, kind string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, record binary"
    return map_batches(pages.select(*columns), run, types)


def op8(spark, sf_dir: str) -> DataFrame:
    """The response and both derivatives of every page; of the record itself its digest."""
    made = build_derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return made.select(*[c for c in made.columns if c != "record"], F.sha2("record", 256).alias("record_sha256"))
