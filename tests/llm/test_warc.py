import gzip

from rulewright.llm import warc

DATE = "2024-05-06T07:08:09Z"
PAGE = "<title>A &amp; b</title><script>if (a<b) x()</script><!-- no --><p>Hi <b>you</b>&lt;</p><a href='/q?a=1'>z</a><style>p{}</style>"


def test_text():
    assert warc.to_text(PAGE) == "A & b\nHi you<\nz"
    assert warc.to_text("") == "" and warc.to_text("a < b") == "a < b" and warc.to_text("<script>x") == ""


def test_derivatives_are_linked():
    headers, block = warc.respond("http://x/", PAGE, DATE)
    (conversion, text), (metadata, fields) = warc.derive(headers, block)
    assert text.decode() == "A & b\nHi you<\nz" and conversion["WARC-Type"] == "conversion" and metadata["WARC-Type"] == "metadata"
    for made in (conversion, metadata):
        assert made["WARC-Refers-To"] == headers["WARC-Record-ID"] and made["WARC-Target-URI"] == made["WARC-Refers-To-Target-URI"] == "http://x/" and made["WARC-Date"] == DATE
    assert metadata["WARC-Concurrent-To"] == conversion["WARC-Record-ID"] and conversion["WARC-Block-Digest"] == warc.digest(text)
    lines = fields.decode().split("\r\n")
    assert f"source-WARC-Payload-Digest: {warc.digest(PAGE.encode())}" in lines and f"payload-digest: {warc.digest(PAGE.encode())}" in lines
    assert "http-Content-Type: text/html; charset=utf-8" in lines and "title: A & b" in lines and "outlink: /q?a=1" in lines
    assert warc.derive(metadata, fields) == [] and warc.derive(headers, block) == warc.derive(headers, block)


def test_files_round_trip():
    records = [warc.respond(f"http://x/{i}", "<p>é" * i, DATE) for i in range(4)]
    for compressed in (False, True):
        data = b"".join(warc.write(h, b, compressed) for h, b in records)
        got = list(warc.parse(data))
        assert [b for _, b in got] == [b for _, b in records]
        assert all({k: v for k, v in g.items() if k != "Content-Length"} == h for (g, _), (h, _) in zip(got, records, strict=True))
        assert len(list(warc.parse(data[:-40]))) == 3 and list(warc.parse(b"junk")) == [] and list(warc.parse(b"")) == []


def test_encodings():
    body = "<p>né".encode("latin-1")
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(body)
    (_, text), _ = warc.derive({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>"}, block)
    assert text.decode() == "né"
    (_, text), _ = warc.derive({"warc-type": "response"}, b"no headers")
    assert text == b"no headers"


def test_tables(spark):
    pages = [(1, "http://a/", PAGE, "x"), (None, None, None, None), (2, "http://b/\r\nX: y", "", "x"), (1, "http://a/", PAGE, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, kind string")
    rows = warc.build_derivatives(df, DATE).collect()
    assert len(rows) == 12 and len({r.record_id for r in rows}) == 9
    assert {r.refers_to for r in rows} - {None} == {r.record_id for r in rows if r.kind == "response"}
    for r in rows:
        ((headers, block),) = warc.parse(bytes(r.record))
        assert headers["WARC-Record-ID"] == r.record_id and headers.get("WARC-Refers-To") == r.refers_to and len(block) == r.content_length and "X" not in headers
    assert warc.build_derivatives(df.where("false")).collect() == []
    files = spark.createDataFrame([(1, b"".join(warc.write(*warc.respond("http://a/", PAGE, DATE)) for _ in range(2))), (2, None), (3, b"junk")], "page_id long, warc binary")
    assert [r.kind for r in warc.build_derivatives(files).collect()] == ["conversion", "metadata"] * 2
    same = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://a/", PAGE)], "page_id long, url string, html string")
    assert len({r.record_id for r in warc.build_derivatives(same, DATE).collect()}) == 6


def test_all_source_headers_are_kept():
    top = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nLink: <x>\r\nContent-Type: text/html\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Concurrent-To: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:3>\r\nWARC-IP-Address: 1.2.3.4\r\nWARC-Warcinfo-ID: <urn:uuid:9>\r\nContent-Length: %d\r\n\r\n" % (len(top) + 2) + top + b"hi\r\n\r\n"
    ((headers, block),) = warc.parse(record)
    _, (_, fields) = warc.derive(headers, block)
    lines = fields.decode().split("\r\n")
    for wanted in ("http-Set-Cookie: a=1", "http-Set-Cookie: b=2", "http-Link: <x>", "source-WARC-Concurrent-To: <urn:uuid:2>", "source-WARC-Concurrent-To: <urn:uuid:3>", "source-WARC-IP-Address: 1.2.3.4", "source-WARC-Warcinfo-ID: <urn:uuid:9>"):
        assert wanted in lines
    ((again, _),) = warc.parse(warc.write(headers, block))
    assert [p for p in again.pairs if p[0] != "Content-Length"] == [p for p in headers.pairs if p[0] != "Content-Length"]


def test_codings():
    import zlib

    raw = zlib.compressobj(wbits=-15)
    chunked = b"4;x=y\r\n<p>o\r\n2\r\nne\r\n0\r\n\r\n"
    cases = [(b"Transfer-Encoding: chunked", chunked), (b"Content-Encoding: deflate", zlib.compress(b"<p>one")), (b"Content-Encoding: deflate", raw.compress(b"<p>one") + raw.flush())]
    cases += [(b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", b"%x\r\n" % len(gzip.compress(b"<p>one")) + gzip.compress(b"<p>one") + b"\r\n0\r\n\r\n")]
    for header, body in cases:
        (_, text), _ = warc.derive({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\n" + header + b"\r\n\r\n" + body)
        assert text == b"one"
    (_, text), (_, fields) = warc.derive({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x0b\x02")
    assert text == b"" and b"unsupported-coding: br" in fields
