"""Derivatives of web archives: linked metadata and plain-text conversion records.

Every response record yields a metadata record (status, content type, length of the payload, whether
its digest holds) and, for text payloads, a conversion record with the visible text.  Both refer to
the response by its identifier and keep its target, date, IP address, source headers and payload
digest; their own identifiers and digests follow from their content, so reruns agree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from . import common
from .html_extract import parse, text_of

VERSION = "WARC/1.1"
GZIP = b"\x1f\x8b\x08"
HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Most bytes that one step of unpacking gives.
OUT = 4 << 20
SPACE = uuid.UUID("5b0f6f0e-6f0f-5d3a-9f57-3b8f3b1c9a10")
#: Named fields of the response that its derivatives repeat.
CARRIED = ("WARC-IP-Address", "WARC-Warcinfo-ID")
HEADERS = pa.map_(pa.string(), pa.string())
RECORD = "record_id string, kind string, target_uri string, date string, refers_to string, headers map<string,string>, source_headers map<string,string>, status int, digest_ok boolean, block_digest string, n_bytes bigint, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields in order; a line that begins with white space continues the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return [(a.strip(), c.strip()) for a, _, c in pairs]


def _get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def plain(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The chunks of an archive, unpacked if it is gzipped: member by member, with only a few chunks held.

    After damage the next member is looked for; a cut tail gives what of it can be unpacked.
    """
    chunks = iter(chunks)
    held = b"".join(islice(chunks, 1))
    while held and len(held) < 2:
        more = next(chunks, b"")
        if not more:
            break
        held += more
    if held[:2] != GZIP[:2]:
        yield held
        yield from chunks
        return
    unpack = None
    while True:
        if unpack is None:
            at = held.find(GZIP)
            if at < 0:
                more = next(chunks, None)
                if more is None:
                    return
                held = held[-2:] + more
                continue
            held, unpack = held[at:], zlib.decompressobj(31)
        try:
            if out := unpack.decompress(held, OUT):
                yield out
            held = unpack.unconsumed_tail
        except zlib.error:
            held, unpack = held[1:], None
            continue
        if unpack.eof:
            held, unpack = unpack.unused_data, None
        elif not held:
            held = next(chunks, None)
            if held is None:
                return


def records(data: bytes | Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(named fields, block) of each record, holding one record at a time; after damage, goes on at the next version line."""
    source = plain([data] if isinstance(data, bytes) else data)
    held, at, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended, at
        if at:
            del held[:at]
            at = 0
        piece = next(source, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        start = held.find(b"WARC/", at)
        if start < 0:
            at = max(at, len(held) - 4)
            if not more():
                return
            continue
        at = start
        m = HEAD_END.search(held, at)
        if not m:
            if not more():
                return
            continue
        fields = _fields(bytes(held[at : m.start()]))
        length = _get(fields, "Content-Length") or ""
        if not length.isdigit():
            at += 5
            continue
        skip, need = m.end() - at, int(length)
        while len(held) < at + skip + need and more():
            pass
        if len(held) < at + skip + need:  # cut, or a wrong length: what follows may still hold whole records
            at += 5
            continue
        yield fields, bytes(held[at + skip : at + skip + need])
        at += skip + need


def serialise(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, header fields and payload of an HTTP response; a block without a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    m = HEAD_END.search(block)
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    status = re.match(rb"HTTP/\S+ (\d{3})", head)
    return int(status[1]) if status else None, _fields(head), body


def _unchunked(body: bytes) -> bytes:
    """A body without its transfer chunks; one that isn't made of chunks stays as it is, a cut one keeps what is there."""
    out, at = [], 0
    while m := re.compile(rb"\s*([0-9a-fA-F]+)[^\r\n]*\r?\n").match(body, at):
        n = int(m[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
    return b"".join(out) if out else body


def _inflated(body: bytes, kind: str) -> bytes | None:
    """A body without one content encoding; None if the encoding isn't known or the data isn't in it."""
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body if kind in ("identity", "") else None


def _payload(body: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, bytes | None]:
    """The body without transfer chunks, and without content encodings as well (None if they can't be undone)."""
    whole = _unchunked(body) if "chunked" in (_get(headers, "Transfer-Encoding") or "").lower() else body
    clear: bytes | None = whole
    for kind in reversed([x.strip().lower() for x in (_get(headers, "Content-Encoding") or "").split(",")]):
        clear = None if clear is None else _inflated(clear, kind)
    return whole, clear


def _text(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = _get(headers, "Content-Type") or ""
    found = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I) or re.search(rb"<meta[^>]*charset=[\"']?([\w.:-]+)", payload[:4096], re.I)
    name = (found[1] if isinstance(found[1], str) else found[1].decode()) if found else "utf-8"
    try:
        return payload.decode(name, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {record_id}')}>"


def derive(fields: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata record and, for text, the conversion record of one response; none for other records.

    A stated payload digest that doesn't hold is replaced by the real one, and the metadata says so.  A body in an
    encoding that can't be undone has no conversion.
    """
    if (_get(fields, "WARC-Type") or "").lower() != "response":
        return []
    status, http, body = split_http(block)
    whole, clear = _payload(body, http)
    stated, own = _get(fields, "WARC-Payload-Digest"), digest(whole)
    source = _get(fields, "WARC-Record-ID") or _derived_id(own, "response")
    kind = (_get(http, "Content-Type") or "text/html").split(";")[0].strip().lower()
    target, date = _get(fields, "WARC-Target-URI"), _get(fields, "WARC-Date")
    shared = [(k, v) for k, v in (("WARC-Target-URI", target), ("WARC-Date", date)) if v] + [(k, v) for k in CARRIED if (v := _get(fields, k))]
    # Crawlers digest the payload with or without its transfer chunks.
    ok = None if stated is None or not stated.lower().startswith("sha1:") else stated.upper() in (own.upper(), digest(body).upper())
    facts = [("http-status", str(status or "")), ("content-type", kind), ("payload-length", str(len(whole))), ("payload-digest", own), ("digest-holds", {None: "unknown", True: "yes", False: "no"}[ok])]
    blocks = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts).encode())]
    if clear is not None and kind in ("text/html", "application/xhtml+xml"):
        blocks.append(("conversion", "text/plain; charset=UTF-8", text_of(_visible(_text(clear, http))).encode("utf-8", "replace")))
    elif clear is not None and kind.startswith("text/"):
        blocks.append(("conversion", "text/plain; charset=UTF-8", _text(clear, http).encode("utf-8", "replace")))
    out = []
    for name, media, body in blocks:
        own_digest = digest(body)
        named = [("WARC-Type", name), ("WARC-Record-ID", _derived_id(source, name)), ("WARC-Refers-To", source), *shared, ("WARC-Payload-Digest", own if ok is False or stated is None else stated), ("WARC-Block-Digest", own_digest), ("Content-Type", media), ("Content-Length", str(len(body)))]
        out.append({"record_id": _derived_id(source, name), "kind": name, "target_uri": target, "date": date, "refers_to": source, "headers": named, "source_headers": http, "status": status, "digest_ok": ok, "block_digest": own_digest, "n_bytes": len(body), "block": body})
    return out


def _visible(html: str):
    root = parse(html)
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if isinstance(c, str) or c.tag not in ("script", "style", "head", "noscript", "template", "textarea", "iframe", "svg")]
        todo.extend(c for c in x.children if not isinstance(c, str))
    return root


def _unique(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Map entries: repeated names are joined by a comma."""
    got: dict[str, str] = {}
    for k, v in pairs:
        got[k] = f"{got[k]}, {v}" if k in got else v
    return list(got.items())


def _batch(rows: list[dict], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    col = lambda name, kind: pa.array([r[name] for r in rows], kind)
    maps = {n: pa.array([_unique(r[n]) for r in rows], HEADERS) for n in ("headers", "source_headers")}
    cols = {n: maps.get(n) if n in maps else col(n, k) for n, k in (("record_id", pa.string()), ("kind", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("headers", None), ("source_headers", None), ("status", pa.int32()), ("digest_ok", pa.bool_()), ("block_digest", pa.string()), ("n_bytes", pa.int64()), ("block", pa.binary()))}
    return pa.RecordBatch.from_pydict(extra | cols)


def _derived(found: Iterable[tuple[Any, list, bytes]], name: str | None, kind: pa.DataType | None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB of the derivatives of records (key, named fields, block) of any number of archives."""
    rows: list[dict] = []
    keys: list = []
    size = 0
    for key, named, block in found:
        got = derive(named, block)
        rows += got
        keys += [key] * len(got)
        size += sum(r["n_bytes"] for r in got)
        if size > most or len(rows) >= 10_000:
            yield _batch(rows, {name: pa.array(keys, kind)} if name else {})
            rows, keys, size = [], [], 0
    if rows:
        yield _batch(rows, {name: pa.array(keys, kind)} if name else {})


def derivatives(archives: DataFrame, content: str = "content", key: str | None = None) -> DataFrame:
    """Rows of ``RECORD`` (after ``key``, if given) for the responses in each row's archive bytes.

    Null or empty bytes and archives without responses give no rows; a damaged record is passed over;
    a response whose digest doesn't hold is converted and marked.  Records are handled one at a time;
    repeated rows give repeated derivatives; other columns aren't read.
    """
    common.small_batches(archives.sparkSession)
    fields = f"`{key}` {archives.schema[key].dataType.simpleString()}, " if key else ""

    def run(batches):
        for b in common.pieces(batches, content):
            keys = b.column(key).to_pylist() if key else [None] * b.num_rows
            found = ((k, named, block) for k, data in zip(keys, b.column(content), strict=True) for named, block in records(data.as_py() or b""))
            yield from _derived(found, key, b.column(key).type if key else None)

    return archives.select(*([common.column(key)] if key else []), common.column(content)).mapInArrow(run, fields + RECORD)


def archive_derivatives(spark: SparkSession, path: str, step: int = 4 << 20) -> DataFrame:
    """(path, *RECORD) for archive files of any size, plain or gzipped: each is streamed by one task."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches):
        for b in batches:
            for name, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                at = unquote(re.sub(r"^file:/+", "/", name))
                chunks = (files.read(at, k, min(step, size - k)) for k in range(0, size, step))
                yield from _derived(((name, named, block) for named, block in records(chunks)), "path", pa.string())

    return listed.mapInArrow(run, f"path string, {RECORD}")


def with_members(derived: DataFrame) -> DataFrame:
    """Append ``member``: the record as a gzip member; members of any order make an archive."""

    def run(batches):
        for b in batches:
            got = [gzip.compress(serialise(h, x), mtime=0) for h, x in zip(b.column("headers").to_pylist(), b.column("block").to_pylist(), strict=True)]
            yield b.append_column("member", pa.array(got, pa.binary()))

    return derived.mapInArrow(run, T.StructType([*derived.schema.fields, T.StructField("member", T.BinaryType())]))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(key, content): each page as a one-record archive, as a crawler would have stored it."""

    def run(batches):
        for b in common.pieces(batches, "x"):
            out = []
            for k, u, x in zip(b.column("k").to_pylist(), b.column("u").to_pylist(), b.column("x").to_pylist(), strict=True):
                body = (x or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, f'{k} {u}')}>"), ("WARC-Target-URI", u or ""), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
                out.append(serialise(fields, block))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.binary())], [key, "content"])

    common.small_batches(pages.sparkSession)
    return pages.select(common.column(key).alias("k"), common.column(url).alias("u"), common.column(html).alias("x")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, content binary")
