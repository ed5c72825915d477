"""WARC derivatives: metadata and plain-text conversion records of responses.

Every derivative names the response it was made from (refers-to), keeps its target, date and digests, and gets a record
id and digests of its own, all computed from content, so that a rerun writes the same records. Work is per row; nothing
is shuffled."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARC_VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
DERIVED = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, "
    "block_digest string, source_block_digest string, source_payload_digest string, digest_ok boolean, http_status int, "
    "source_headers array<struct<name:string,value:string>>, block string"
)

# Elements without readable text, and elements that end a line.
_HIDDEN = "script|style|template|noscript"
_LINE_TAGS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table "
    "td th title tr ul".split()
)
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b.*?(?:</\1\s*>|\Z)|<[!?][^<>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*(?:>|\Z)", re.S | re.I)
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<(?:a|link)\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s<>]+)", re.I)
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\n]*\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(markup: str) -> str:
    """Readable text of a page: hidden elements, comments and tags removed, lines at block elements, entities resolved."""
    text = _MARKUP.sub(lambda m: "\n" if m[2] and m[2].lower() in _LINE_TAGS else "", markup)
    text = _BLANKS.sub(" ", html.unescape(text))
    return _LINES.sub("\n", text).strip()


def parse_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers (lower-case names, in order, repeats kept, folded lines joined) and body; without a status line all
    is body. An empty line ends the headers, with or without carriage returns."""
    if not (first := re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", block)):
        return None, [], block
    end = _HEAD_END.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    headers: list[tuple[str, str]] = []
    for line in head.decode("latin-1").replace("\r\n", "\n").split("\n")[1:]:
        name, mark, value = line.partition(":")
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}".strip())
        elif mark:
            headers.append((name.strip().lower(), value.strip()))
    return int(first[1]), headers, body


def _last(headers: list[tuple[str, str]], name: str) -> str:
    return next((value for known, value in reversed(headers) if known == name), "")


def dechunked(body: bytes) -> bytes:
    """The body of a chunked message; what follows a broken chunk is left out."""
    parts, at = [], 0
    while (mark := _CHUNK.match(body, at)) and (size := int(mark[1], 16)):
        parts.append(body[mark.end() : mark.end() + size])
        at = mark.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(parts)


def inflated(body: bytes, coding: str) -> bytes:
    """A gzip or deflate body unpacked as far as it is sound; as it is where it isn't packed so."""
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        parts, left = [], body
        try:
            while left:  # members may follow each other
                unpack = zlib.decompressobj(bits)
                while left and not unpack.eof:
                    parts.append(unpack.decompress(left, 1 << 20))
                    left = unpack.unconsumed_tail
                    if not left and not unpack.eof:
                        parts.append(unpack.flush())
                        break
                left = unpack.unused_data
        except zlib.error:
            if not any(parts):
                continue
        return b"".join(parts)
    return body


def content(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """What a body says once its transfer and content codings are undone, the last applied first."""
    if "chunked" in _last(headers, "transfer-encoding").lower():
        body = dechunked(body)
    for coding in reversed([c.strip().lower() for name, value in headers if name == "content-encoding" for c in value.split(",")]):
        body = inflated(body, coding)
    return body


def _decode(body: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _record(kind: str, source: dict, content_type: str, block: str, status: int | None, headers: list[tuple[str, str]], digests: tuple) -> tuple:
    data = block.encode("utf-8", "replace")
    own = uuid.uuid5(NAMESPACE, f"{kind} {source['record_id']}")
    return (
        (kind, f"<urn:uuid:{own}>", source["record_id"], source["target_uri"], source["warc_date"], content_type, len(data), sha1_digest(data))
        + digests
        + (status, [{"name": name, "value": value} for name, value in headers], data.decode("utf-8"))
    )


def _derive(source: dict) -> list[tuple]:
    block = source["block"] or b""
    status, headers, body = parse_http(block)
    content_type = _last(headers, "content-type")
    own = sha1_digest(block)
    declared = source["block_digest"]
    digests = (declared or own, source["payload_digest"] or sha1_digest(body), declared is None or declared == own)
    readable = content_type.lower().startswith(("text/", "application/xhtml")) or not content_type
    page = _decode(content(headers, body), content_type) if readable else ""
    markup = readable and not content_type.lower().startswith("text/plain")
    title = _TITLE.search(page) if markup else None
    fields = [("http-status", status), ("source-content-type", content_type), ("source-length", len(body))]
    fields += [("source-block-digest", digests[0]), ("source-payload-digest", digests[1])]
    fields += [("source-header", f"{name}: {value}") for name, value in headers]
    fields += [("title", _BLANKS.sub(" ", html.unescape(title[1])).replace("\n", " ").strip())] if title else []
    fields += [("outlink", html.unescape(link)) for link in _LINK.findall(page)] if markup else []
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    records = [_record("metadata", source, "application/warc-fields", lines, status, headers, digests)]
    if readable:
        text = plain_text(page) if markup else page
        records.append(_record("conversion", source, "text/plain; charset=utf-8", text, status, headers, digests))
    return records


def derivatives(responses: DataFrame, id_columns: list[str]) -> DataFrame:
    """Metadata and conversion records of response records.

    `responses`: record_id, target_uri, warc_date, block (the HTTP message), block_digest, payload_digest (null: computed),
    and id columns to carry along. Each response gives a metadata record; a readable one (text or no stated type) gives a
    conversion record too. A null block counts as empty; null targets and dates stay null; a block whose digest
    differs from the stated one is converted and marked (digest_ok false). Chunked, gzip and deflate bodies are unpacked
    before they are read, digests are of the stored bytes. All headers are kept in order, also in the metadata block. Repeated rows are each converted; an empty
    table gives an empty result; other columns are ignored."""
    named = ["record_id", "target_uri", "warc_date", "block", "block_digest", "payload_digest"]
    fields = responses.select(*id_columns).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), DERIVED])
    names = [*id_columns, *(part.split()[0] for part in re.split(r", (?=\w+ )", DERIVED))]
    text = pa.string()
    kinds = [text] * 6 + [pa.int64(), text, text, text, pa.bool_(), pa.int32(), pa.list_(pa.struct([("name", text), ("value", text)])), text]

    def emit(batch: pa.RecordBatch, kept: list[int], rows: list[tuple]) -> pa.RecordBatch:
        ids = batch.select(list(range(len(id_columns)))).take(pa.array(kept, pa.int64()))
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*ids.columns, *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows, size = [], [], 0
            for k in range(batch.num_rows):
                source = {name: batch.column(len(id_columns) + i)[k].as_py() for i, name in enumerate(named)}
                found = _derive(source)
                kept += [k] * len(found)
                rows += found
                size += len(source["block"] or b"")
                if size > 1 << 22:
                    yield emit(batch, kept, rows)
                    kept, rows, size = [], [], 0
            if rows:
                yield emit(batch, kept, rows)

    ids = [responses[c].alias(f"_id{i}") for i, c in enumerate(id_columns)]
    return responses.select(*ids, *named).mapInArrow(run, schema)


def page_responses(pages: DataFrame, warc_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of `pages` (page_id, url, html): an HTTP message around each page, ids from content."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    digest = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), body).cast("binary"))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    missing = F.lit(None).cast("string")
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(warc_date).alias("warc_date"),
        F.concat(head, body).cast("binary").alias("block"),
        missing.alias("block_digest"),
        missing.alias("payload_digest"),
    )


def render() -> Column:
    """A derived record as the bytes of a WARC file; what it keeps of its source is in extension fields."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit(f"{WARC_VERSION}\r\n"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("X-Source-Block-Digest", F.col("source_block_digest")),
        line("X-Source-Payload-Digest", F.col("source_payload_digest")),
        F.array_join(F.transform("source_headers", lambda h: F.concat(F.lit("X-Source-Header: "), h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), ""),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary")
