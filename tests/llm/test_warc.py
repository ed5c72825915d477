"""Derivatives against their sources."""

import base64
import gzip
import hashlib
import time
import zlib

import pytest

from talkloom.llm import warc

SCHEMA = "page_id int, record_id string, target_uri string, warc_date string, block binary, block_digest string, payload_digest string, warc_type string"


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<p>One <b>two</b>&amp;three<p>four", "One two&three\nfour"),
        ("a<!-- x <p> --> b<script>if (a<b) </p>;</script><style>p{}</style>c", "a bc"),
        ("a<script>never closed", "a"),
        ("a<!-- never closed", "a"),
        ("1 < 2 and <br>x", "1 < 2 and\nx"),
        ("plain\n\n  text ", "plain\ntext"),
    ],
)
def test_plain_text(page, text):
    assert warc.plain_text(page) == text


def test_long_hostile_markup_takes_linear_time():
    started = time.process_time()
    for page in ("<a" * 200_000, "<!" * 200_000, "<script" * 50_000, "<!--" * 100_000, "<title>" * 50_000):
        warc.plain_text(page)
    assert time.process_time() - started < 20


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_refer_to_their_source(spark):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\n\r\n<title>T &amp; x</title><a href='/l'>\xe9</a>"
    rows = [
        (1, "<urn:uuid:a>", "http://x/", "2020-01-01T00:00:00Z", bytearray(block), digest(block), None, "clash"),
        (1, "<urn:uuid:a>", "http://x/", "2020-01-01T00:00:00Z", bytearray(block), digest(block), None, "clash"),
        (2, "<urn:uuid:b>", None, None, None, None, None, None),
        (3, "<urn:uuid:c>", "u", "d", bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"), "sha1:WRONG", None, None),
        (4, None, "u", "d", bytearray(b"no header"), None, "sha1:GIVEN", None),
    ]
    got = warc.derivatives(spark.createDataFrame(rows, SCHEMA), ["page_id"]).collect()
    by = {(r["page_id"], r["warc_type"]): r for r in got}
    assert len(got) == 4 + 2 + 1 + 2 and len(by) == 7
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text["block"] == "T & x\né"
    assert text["refers_to"] == meta["refers_to"] == "<urn:uuid:a>" and text["record_id"] != meta["record_id"]
    assert text["block_digest"] == digest(text["block"].encode()) and text["content_length"] == len(text["block"].encode())
    assert text["source_block_digest"] == digest(block) and text["source_payload_digest"] == digest(block.partition(b"\r\n\r\n")[2]) and text["digest_ok"]
    assert meta["http_status"] == 404 and [tuple(h) for h in meta["source_headers"]] == [("content-type", "text/html; charset=latin-1"), ("x-a", "1")] and "source-header: x-a: 1\r\n" in meta["block"]
    assert "title: T & x\r\n" in meta["block"] and "outlink: /l\r\n" in meta["block"]
    assert by[2, "conversion"]["block"] == "" and by[2, "metadata"]["target_uri"] is None
    assert (3, "conversion") not in by and not by[3, "metadata"]["digest_ok"]
    assert by[4, "conversion"]["block"] == "no header" and by[4, "metadata"]["source_payload_digest"] == "sha1:GIVEN"
    assert warc.derivatives(spark.createDataFrame([], SCHEMA), ["page_id"]).count() == 0


def test_headers_are_kept_in_order_with_repeats():
    block = b"HTTP/1.1 200 OK\nSet-Cookie: a=1\nVia: x\nset-cookie: b=2\n  folded\nno colon\nEmpty:\n\nbody: not a header"
    assert warc.parse_http(block) == (200, [("set-cookie", "a=1"), ("via", "x"), ("set-cookie", "b=2 folded"), ("empty", "")], b"body: not a header")
    assert warc.parse_http(b"HTTP/1.0 204 No Content\r\nA: 1") == (204, [("a", "1")], b"")
    assert warc.parse_http(b"plain\r\n\r\nx") == (None, [], b"plain\r\n\r\nx")


def chunks(data, size):
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)) + b"0\r\n\r\n"


@pytest.mark.parametrize("coding", ["", "gzip", "deflate", "raw"])
@pytest.mark.parametrize("chunked", [False, True])
def test_bodies_are_unpacked(spark, coding, chunked):
    page = "<p>Grüße</p>" * 50
    body = page.encode()
    if coding == "gzip":
        body = gzip.compress(body[:100]) + gzip.compress(body[100:])
    elif coding:
        pack = zlib.compressobj(wbits=15 if coding == "deflate" else -15)
        body = pack.compress(body) + pack.flush()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (b"Content-Encoding: %s\r\n" % (b"gzip" if coding == "gzip" else b"deflate") if coding else b"")
    block = head + (b"Transfer-Encoding: chunked\r\n\r\n" + chunks(body, 7) if chunked else b"\r\n" + body)
    records = warc._derive({"record_id": "r", "target_uri": "u", "warc_date": "d", "block": block, "block_digest": None, "payload_digest": None})
    assert records[1][-1] == "\n".join(["Grüße"] * 50) and records[1][9] == digest(block.partition(b"\r\n\r\n")[2])


def test_broken_bodies_are_read_as_far_as_they_go():
    packed = gzip.compress(b"abc " * 5000)
    assert b"abc " * 5000 == warc.inflated(packed, "gzip") and warc.inflated(packed[:40], "gzip") in b"abc " * 5000
    assert warc.inflated(b"not packed", "gzip") == b"not packed" and warc.inflated(b"as is", "br") == b"as is"
    assert warc.dechunked(b"3\r\nabc\r\nzz\r\n") == b"abc" and warc.dechunked(b"5\r\nab") == b"ab" and warc.dechunked(b"") == b""


def test_pages_become_responses_and_records_are_rendered(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>hé"), (2, None, None), (None, "u", "")], "page_id bigint, url string, html string")
    out = warc.derivatives(warc.page_responses(pages), ["page_id"])
    assert out.count() == 6
    for row in out.withColumn("record", warc.render()).collect():
        head, _, rest = bytes(row["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and row["refers_to"].encode() in head
        assert b"X-Source-Header: content-type: text/html; charset=utf-8" in head and row["source_payload_digest"].encode() in head
        assert rest == row["block"].encode() + b"\r\n\r\n" and f"Content-Length: {len(row['block'].encode())}".encode() in head
