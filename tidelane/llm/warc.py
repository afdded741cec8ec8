"""WARC records: reading, writing, and deriving linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Headers = list[tuple[str, str]]
RECORDS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, source_digest_ok boolean, error string, record binary"
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]
_DROPPED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "svg", "head")}
_BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer main aside blockquote pre title body".split())
_LINKED = frozenset(("a", "link", "img", "script", "iframe"))
_NAME = re.compile(r"/?([a-z][a-z0-9]*)\b", re.I)
_TARGET = re.compile(r"\s(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSE_TITLE = re.compile(r"</title\s*>", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable identifier made from what the record is derived from."""
    h = hashlib.sha256("\x00".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def write_record(headers: Headers, block: bytes) -> bytes:
    lines = [f"{k}: {one_line(v)}" for k, v in headers if k.lower() != "content-length"]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of data, or data itself where it isn't compressed. A member that is cut off gives what it has."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            out.append(d.decompress(data[at : at + step]))
            at = min(at + step, len(data))
        at -= len(d.unused_data)
        yield b"".join([*out, d.flush()])
    if at < len(data):
        yield data[at:] if at else data


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record, of a file as it is or gzipped by record. A broken tail raises ValueError."""
    for part in _members(data):
        at = 0
        while True:
            while part[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(part):
                break
            end = part.find(b"\r\n\r\n", at)
            if not part.startswith(b"WARC/", at) or end < 0:
                raise ValueError(f"no record at byte {at}")
            headers: Headers = []
            for line in part[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
                if line[:1] in " \t" and headers:
                    headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
                else:
                    k, _, v = line.partition(":")
                    headers.append((k, v.strip()))
            size = int(dict((k.lower(), v) for k, v in headers).get("content-length", "-1"))
            if size < 0 or end + 4 + size > len(part):
                raise ValueError(f"record at byte {at} is cut off")
            yield headers, part[end + 4 : end + 4 + size]
            at = end + 4 + size


def read_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and body of a response; transfer and content coding are undone where they can be."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if x)]
    of = {k.lower(): v.lower() for k, v in headers}
    if of.get("transfer-encoding") == "chunked":
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if n <= 0:
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
        body = b"".join(out)
    if of.get("content-encoding") in ("gzip", "deflate"):
        try:
            body = zlib.decompressobj(47 if of["content-encoding"] == "gzip" else 15).decompress(body)
        except zlib.error:
            pass
    return lines[0], headers, body


def decode_html(body: bytes, content_type: str) -> tuple[str, str]:
    m = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(body[:2048])
    charset = m[1].decode().lower() if m else "utf-8"
    try:
        return body.decode(charset, "replace"), charset
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def _tags(page: str) -> Iterator[tuple[int, int, str, bool]]:
    """Where each tag or comment begins and ends, its name ("!--" for comments) and whether it closes; in one walk."""
    at, comments = 0, True
    while (i := page.find("<", at)) >= 0:
        if comments and page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            if j >= 0:
                yield i, j + 3, "!--", False
                at = j + 3
                continue
            comments = False  # no other one is closed either
        j = page.find(">", i + 1)
        if j < 0:
            return
        m = _NAME.match(page, i + 1, j)
        yield i, j + 1, m[1].lower() if m else "", page.startswith("/", i + 1)
        at = j + 1


def html_to_text(page: str) -> str:
    """Visible text: a line for each block element, white space collapsed, character references resolved.

    Comments, and scripts, styles and the like with what they hold, are left out if they are closed.
    """
    out, at, unclosed = [], 0, set()
    for i, j, name, closing in _tags(page):
        if i < at:
            continue  # inside what is left out
        out.append(page[at:i])
        at = j
        if name == "!--":
            out.append(" ")
        elif name in _DROPPED and not closing and name not in unclosed:
            m = _DROPPED[name].search(page, j)
            if m:
                out.append(" ")
                at = m.end()
            else:
                unclosed.add(name)
        elif name in _BREAK:
            out.append("\n")
    out.append(page[at:])
    lines = (_SPACES.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def title_and_links(page: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The first closed title, and (target, tag) of what the page links to, comments left out."""
    title, links, look = None, [], True
    for i, j, name, closing in _tags(page):
        if name == "title" and not closing and title is None and look:
            m = _CLOSE_TITLE.search(page, j)
            title, look = (html.unescape(page[j : m.start()]), False) if m else (None, False)
        elif name in _LINKED and not closing and (m := _TARGET.search(page, i, j)):
            links.append((html.unescape(m[1] or m[2] or m[3] or ""), name))
    return title, links


def build_response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    """A response record that holds a page. Its id is made of page_id, url and payload, so equal rows give the same record."""
    body = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(body))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return write_record(headers, block)


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes, bool]]:
    """The metadata and the conversion record of a response; nothing for records of other types.

    Both refer to the response's id, carry its target, date and warcinfo, and name their concurrent record. The
    metadata record keeps the response's digests, status and HTTP headers, and the page's title and links.
    The boolean tells whether the response's own digests are those of its bytes.
    """
    of = {k.lower(): v for k, v in headers}
    if of.get("warc-type") != "response":
        return []
    status, http, body = read_http(block)
    raw = block.partition(b"\r\n\r\n")[2]
    ok = of.get("warc-block-digest", digest(block)) == digest(block) and of.get("warc-payload-digest", digest(raw)) in (digest(raw), digest(body))
    content = next((v for k, v in http if k.lower() == "content-type"), "")
    page, charset = decode_html(body, content)
    source = of.get("warc-record-id", "")
    meta_id, text_id = (record_id(kind, source, digest(block)) for kind in ("metadata", "conversion"))
    shared = [(name, of[name.lower()]) for name in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address") if name.lower() in of]
    title, links = title_and_links(page)
    fields = [
        ("source-record-id", source), ("source-block-digest", of.get("warc-block-digest", "")),
        ("source-payload-digest", of.get("warc-payload-digest", "")), ("source-status", status), *(("source-header", f"{k}: {v}") for k, v in http),
        ("charset", charset)
    ]
    fields += [] if title is None else [("title", title)]
    fields += [("outlink", f"{target} {tag}") for target, tag in links]
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = html_to_text(page).encode("utf-8", "surrogatepass")
    make = lambda kind, own, other, mime, data: [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Concurrent-To", other), *shared, ("Content-Type", mime),
        ("WARC-Block-Digest", digest(data)), *([("WARC-Source-Payload-Digest", of["warc-payload-digest"])] if "warc-payload-digest" in of else [])
    ]
    return [
        (make("metadata", meta_id, text_id, "application/warc-fields", meta), meta, ok),
        (make("conversion", text_id, meta_id, "text/plain; charset=utf-8", text), text, ok)
    ]


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): a WARC response record for each row of pages (page_id, url, html); nulls are empty.

    Equal rows give equal records, rows that differ in any of the three records of their own. An empty table gives an
    empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array([build_response(*r, date) for r in rows], pa.binary())], ["page_id", "record"]
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


def _row(page_id: int | None, h: Headers, new: bytes, ok: bool) -> tuple:
    of = dict(h)
    return (
        page_id, of["WARC-Type"], of["WARC-Record-ID"], of["WARC-Refers-To"], of.get("WARC-Target-URI"), of.get("WARC-Date"), of["Content-Type"],
        of["WARC-Block-Digest"], of.get("WARC-Source-Payload-Digest"), ok, None, write_record(h, new)
    )


def derivatives(responses: DataFrame, errors: bool = False, most: int = 1 << 21) -> DataFrame:
    """RECORDS for each row of responses (page_id, record): record may hold any number of records, gzipped or not.

    A row that can't be read to its end gives the records before that; with errors, one row more of type "error"
    says what is wrong, so that all that is lost can be counted. Null and empty rows give nothing. Repeated rows
    give their records each. An empty table gives an empty result; other columns are not looked at.
    """

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 8, pa.bool_(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for page_id, record in zip(b.column("page_id"), b.column("record"), strict=True):
                try:
                    for headers, block in read_records(record.as_py() or b""):
                        for h, new, ok in derive(headers, block):
                            out.append(_row(page_id.as_py(), h, new, ok))
                            size += len(out[-1][-1])
                        if size > most:
                            yield batch(out)
                            out, size = [], 0
                except (ValueError, zlib.error) as wrong:
                    if errors:
                        out.append((page_id.as_py(), "error", *[None] * 8, str(wrong), None))
            yield batch(out)
            out, size = [], 0

    return responses.select("page_id", "record").mapInArrow(run, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record) from WARC files at path, a row for each file of up to 2 GB; page_id is null."""
    return spark.read.format("binaryFile").load(path).select(F.lit(None).cast("long").alias("page_id"), F.col("content").alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of the whole pages table, by the digest of each record and of what it holds."""
    found = derivatives(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest",
        "source_digest_ok", F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")
    )
