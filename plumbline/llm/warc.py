"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

``derive`` reads whole response records (WARC header, HTTP header, body), decodes transfer and content
encodings and the charset, and returns for each a ``metadata`` record (application/warc-fields with the
source's headers and digests) and a ``conversion`` record (text/plain; charset=utf-8, the page's visible
text). Both refer to the source by ``WARC-Refers-To``, keep its target URI and date, and carry the
source's digests; record ids are UUIDs (version 5) of source id and kind, so a repeated run names them
alike. The source's own digests are checked, and a mismatch is said in ``problem``. Of repeated headers all
values are kept in order: as lines of their own in the metadata record, joined by line feeds under the first
one's name in ``source_headers``. All members of a gzip body are read; a body whose compressed stream or
chunks end early is converted as far as it goes, and ``problem`` says so.

Null, broken and non-response records, and undecodable bodies, give one metadata record whose
``problem`` says why, and no conversion. An empty body gives an empty conversion. Repeated records give
repeated derivatives; kept columns pass through unless a new column has their name; an empty table
gives an empty table. Bodies are decoded whole, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import pieces, ready_workers
from plumbline.llm.html_paths import joined_blocks, parse

#: Namespace of the derivatives' record ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plumbline:warc-derivatives")
FIELDS = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers map<string,string>, source_payload_digest string, source_block_digest string, "
    "block_digest string, content_length long, content string, problem string"
)
#: Bytes of a compressed file that are decompressed at once.
MEMBER_BYTES = 1 << 14
_CHARSET = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?([-\w:.]+)""", re.I)


class Response(NamedTuple):
    warc: list[tuple[str, str]]
    status: str
    http: list[tuple[str, str]]
    block: bytes
    payload: bytes


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("utf-8", "replace").splitlines() or [""]
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()]


def _value(headers: Sequence[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _joined(headers: Sequence[tuple[str, str]], name: str) -> str | None:
    return ", ".join(v for k, v in headers if k.lower() == name.lower()) or None


def _split(data: bytes) -> tuple[bytes, bytes]:
    m = re.search(rb"\r?\n\r?\n", data)
    return (data, b"") if m is None else (data[: m.start()], data[m.end() :])


def parse_response(record: bytes) -> Response:
    """The parts of a response record; ValueError says what is wrong with it."""
    head, rest = _split(record)
    version, warc = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    if (_value(warc, "WARC-Type") or "").lower() != "response":
        raise ValueError("not a response record")
    try:
        size = int(_value(warc, "Content-Length") or "")
    except ValueError:
        raise ValueError("no content length") from None
    if len(rest) < size:
        raise ValueError("truncated record")
    block = rest[:size]
    head, payload = _split(block)
    status, http = _headers(head)
    if not status.startswith("HTTP/"):
        raise ValueError("no HTTP header")
    return Response(warc, status, http, block, payload)


def _joined_chunks(body: bytes) -> tuple[bytes, str | None]:
    """The chunks' bytes as far as they go, and what is wrong with their end."""
    source, parts = io.BytesIO(body), []
    while True:
        line = source.readline()
        if not line.endswith(b"\n"):
            return b"".join(parts), None if line.split(b";")[0].strip() == b"0" else "chunks end early"
        size = int(line.split(b";")[0], 16)
        if size < 0:
            raise ValueError("chunk size below zero")
        if not size:
            return b"".join(parts), None
        parts.append(source.read(size))
        if len(parts[-1]) < size:
            return b"".join(parts), "chunks end early"
        source.readline()


def _inflated(body: bytes, wbits: int) -> tuple[bytes, str | None]:
    """All members of a compressed stream as far as they go, and what is wrong with its end."""
    parts = []
    while body:
        member = zlib.decompressobj(wbits)
        try:
            parts.append(member.decompress(body))
        except zlib.error:
            if not parts:
                raise
            return b"".join(parts), "bytes after the compressed stream"
        if not member.eof:
            return b"".join(parts), "compressed stream ends early"
        body = member.unused_data.lstrip(b"\0") if wbits == 47 else b""
    return b"".join(parts), None


def decoded_text(r: Response) -> tuple[str, str | None]:
    """The body as text: chunks joined, content encoding undone, charset applied; and what was missing of it."""
    body, problems = r.payload, []
    if "chunked" in (_joined(r.http, "Transfer-Encoding") or "").lower():
        body, problem = _joined_chunks(body)
        problems.append(problem)
    encodings = [x.strip() for x in (_joined(r.http, "Content-Encoding") or "").lower().split(",")]
    for encoding in reversed(encodings):
        if encoding in ("gzip", "x-gzip", "deflate"):
            body, problem = _inflated(body, 47 if encoding != "deflate" or body[:1] == b"\x78" else -15)
            problems.append(problem)
        elif encoding not in ("identity", ""):
            raise ValueError(f"unknown content encoding {encoding}")
    named = re.search(r"charset\s*=\s*[\"']?([-\w:.]+)", _value(r.http, "Content-Type") or "", re.I)
    meta = _CHARSET.search(body[:4096])
    charset = named[1] if named else meta[1].decode("ascii", "replace") if meta else "utf-8"
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text, "; ".join(p for p in problems if p) or None


def derivatives(record: bytes | None) -> list[tuple]:
    """The rows of FIELDS for one source record."""
    try:
        if not record:
            raise ValueError("empty record")
        r, problem = parse_response(bytes(record)), None
    except ValueError as e:
        r, problem = Response([], "", [], b"", b""), str(e)
    source = _value(r.warc, "WARC-Record-ID")
    text = None
    if problem is None:
        try:
            page, short = decoded_text(r)
            problem = f"incomplete body: {short}" if short else None
            kind = (_value(r.http, "Content-Type") or "text/html").lower()
            text = joined_blocks(parse(page, plain=True)) if "html" in kind or "xml" in kind else page
        except (ValueError, zlib.error) as e:
            problem = f"undecodable body: {e}"
    claimed = [(n, _value(r.warc, n)) for n in ("WARC-Payload-Digest", "WARC-Block-Digest")]
    for (name, said), data in zip(claimed, (r.payload, r.block), strict=True):
        if problem is None and said and said.lower().startswith("sha1:") and said[5:].upper() != digest(data)[5:]:
            problem = f"{name} does not match"
    uri, date = _value(r.warc, "WARC-Target-URI"), _value(r.warc, "WARC-Date")
    all_headers = [(f"warc:{k}", v) for k, v in r.warc] + [(f"http:{k}", v) for k, v in r.http] + ([("http:status", r.status)] if r.status else [])
    names: dict[str, str] = {}
    headers: dict[str, str] = {}
    for k, v in all_headers:
        name = names.setdefault(k.lower(), k)
        headers[name] = f"{headers[name]}\n{v}" if name in headers else v
    payload_digest = claimed[0][1] or (digest(r.payload) if r.warc else None)
    block_digest = claimed[1][1] or (digest(r.block) if r.warc else None)
    fields = [("refersTo", source), ("sourcePayloadDigest", payload_digest), ("sourceBlockDigest", block_digest), ("problem", problem)]
    fields += sorted(((names[k.lower()], v) for k, v in all_headers), key=lambda x: x[0])
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    made = [("metadata", "application/warc-fields", lines)]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text))
    seed = source or digest(bytes(record or b""))
    out = []
    for kind, content_type, content in made:
        raw = content.encode("utf-8", "replace")
        own = f"<{uuid.uuid5(NAMESPACE, f'{kind} {seed}').urn}>"
        out.append((kind, own, source, uri, date, content_type, list(headers.items()), payload_digest, block_digest, digest(raw), len(raw), raw.decode(), problem))
    return out


def derive(responses: DataFrame, record_col: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the columns of FIELDS: the metadata and conversion records of every response record."""
    fields = T._parse_datatype_string(FIELDS).fields
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    ready_workers(responses.sparkSession)
    source = responses.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{record_col}`").cast("binary").alias("__in"))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(kept)):
            rows, places = [], []
            for i, record in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                made = derivatives(record)
                rows += made
                places += [i] * len(made)
            if rows:
                columns = [c.take(pa.array(places)) for c in batch.columns[:-1]]
                columns += [pa.array(v, type=f.type) for v, f in zip(zip(*rows, strict=True), list(arrow)[len(kept) :], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return source.mapInArrow(run, schema)


def to_records(derived: DataFrame) -> DataFrame:
    """``record``: each derivative as the bytes of a WARC/1.1 record."""
    line = lambda name, c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        *[line(*x) for x in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))],
        F.lit("\r\n"),
    )
    return derived.withColumn("record", F.encode(F.concat(head, "content", F.lit("\r\n\r\n")), "UTF-8"))


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, record): crawled pages as response records, built by Spark from id, URL and html."""
    body = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    block = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "UTF-8"), body)
    name = F.md5(F.encode(F.concat_ws(" ", F.col(f"`{id_col}`").cast("string"), F.col(f"`{url_col}`")), "UTF-8"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Target-URI: "), F.coalesce(F.col(f"`{url_col}`"), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return pages.select(F.col(f"`{id_col}`"), F.concat(F.encode(head, "UTF-8"), block, end).alias("record"))


def split_warc(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file's bytes, each with its closing blank lines left out."""
    pos = 0
    while (start := data.find(b"WARC/", pos)) >= 0:
        m = re.compile(rb"\r?\n\r?\n").search(data, start)
        if m is None:
            return
        _, headers = _headers(data[start : m.start()])
        size = _value(headers, "Content-Length") or "0"
        pos = m.end() + (int(size) if size.isdigit() else 0)
        yield data[start:pos]


#: How the header of a gzip member begins.
_GZIP = b"\x1f\x8b\x08"


def members(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(bytes, problem) of the gzip members of a file's bytes one after the other, or of the bytes themselves; each is read in pieces, once.

    Crawls write a member for each record. Of a member that is damaged or ends early, what could be read is returned with the
    problem, and reading goes on at the next member that can be read; zero bytes between members are padding, other bytes there are
    a problem too.
    """
    if content[:2] != _GZIP[:2]:
        yield content, None
        return
    pos = 0
    while pos < len(content):
        start = pos
        if content[pos : pos + 2] != _GZIP[:2]:
            pos = content.find(_GZIP, pos)
            pos = len(content) if pos < 0 else pos
            if content[start:pos].strip(b"\0"):
                yield b"", f"{pos - start} bytes between gzip members at {start}"
            continue
        member, parts, wrong = zlib.decompressobj(31), [], None
        while not member.eof and pos < len(content):
            piece = content[pos : pos + MEMBER_BYTES]
            pos += len(piece)
            try:
                parts.append(member.decompress(piece))
            except zlib.error as said:
                wrong = f"damaged gzip member at {start}: {said}"
                break
        if member.eof:
            pos -= len(member.unused_data)
        else:
            wrong = wrong or f"gzip member at {start} ends early"
            pos = _next_member(content, start + 1)
        yield b"".join(parts), wrong


def _next_member(content: bytes, pos: int) -> int:
    """Where the next member begins whose first bytes can be decompressed; the end if none does."""
    while (pos := content.find(_GZIP, pos)) >= 0:
        try:
            zlib.decompressobj(31).decompress(content[pos : pos + 4096], 1 << 16)
            return pos
        except zlib.error:
            pos += 1
    return len(content)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, problem) of WARC files, plain or gzip; a file is read by one task, so files should be split as crawls do (1 GB).

    A row with a ``problem`` stands for what couldn't be read whole: its record is what there is of it (empty if nothing is), and the
    records after it follow. A worker holds a file's bytes and one member of it decompressed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(where: str, record: bytes, problem: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([where]), pa.array([record], type=pa.binary()), pa.array([problem], type=pa.string())], names=["path", "record", "problem"])

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part, problem in members(content):
                    records = list(split_warc(part)) if problem else split_warc(part)
                    if problem:
                        for record in records[:-1]:
                            yield row(where, record, None)
                        yield row(where, records[-1] if records else b"", problem)
                        continue
                    for record in records:
                        yield row(where, record, None)

    ready_workers(spark)
    return files.mapInArrow(run, "path string, record binary, problem string")
