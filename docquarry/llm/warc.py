"""Derivative records of WARC responses: linked metadata and plain-text conversions.

Every response record yields two records. The metadata record carries the source's WARC and HTTP
headers, its digests, the title and the links as JSON; the conversion record carries the page's text,
one line per block. Both name the response in WARC-Refers-To and keep its target, date and payload
digest, and have a digest of their own block. Record ids are derived from the source id and the kind, so
a repeated run gives the same records; a response's own id follows from target, date and payload. Digests are
of the bytes as stored; title, links and text are read from the body without its transfer and content encoding.

Defined results: null or empty pages become responses without payload; a null target is left out;
records of other types yield nothing; a record that cannot be read (no WARC header, wrong length, no
blank line) yields one row of kind ``rejected`` with the reason; repeated records are derived each; a body that is
not encoded as its headers say, or in an unknown way, is read as it is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.html_text import blocks_of

VERSION = "WARC/1.0"
SERIES = "WARC/1."  # of versions that are read
SPLIT = "\r\n\r\n" + SERIES
UNDATED = "1970-01-01T00:00:00Z"
# The first href or src of a tag, past other attributes and their values.
_LINK = re.compile(
    r"""<(a|link|img|script|iframe)(?:[\s/]+(?!(?:href|src)[\s=])[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?)*+"""
    r"""[\s/]+(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
    re.IGNORECASE,
)
_NO_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|(<(script|style|textarea)\b[^>]*>).*?(?=</\2|\Z)", re.IGNORECASE | re.DOTALL)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, with its digest and length, up to but without the two line ends that close it."""
    lines = [*headers, ("WARC-Block-Digest", sha1_digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in lines)
    return f"{VERSION}\r\n{head}\r\n".encode() + block


def response_record(url: str | None, html: str | None, date: str | None) -> bytes:
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1_digest(payload)
    own_id = record_id("response", url or "", *([date] if date else []), digest)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", own_id), ("WARC-Date", date or UNDATED)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    return record_bytes(headers, http + payload)


def _header_lines(head: bytes) -> list[tuple[str, str]]:
    pairs: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and pairs:  # continued
            pairs[-1] = (pairs[-1][0], pairs[-1][1] + " " + line.strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            pairs.append((name.strip(), value.strip()))
    return pairs


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """WARC headers and block; a ValueError says what is wrong."""
    head, gap, block = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC version")
    if not gap:
        raise ValueError("no end of headers")
    headers = _header_lines(lines)
    length = next((v for n, v in headers if n.lower() == "content-length"), None)
    if length is None or not length.isdigit() or len(block) < int(length):
        raise ValueError("wrong length")
    return headers, block[: int(length)]


def _unchunked(data: bytes) -> bytes:
    """The body that was sent in chunks; data without a chunk at its start is none."""
    parts, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        size = data[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(parts) if parts else data
        length = int(size, 16)
        if not length:
            break
        parts.append(data[end + 2 : end + 2 + length])
        at = end + 2 + length + 2
    return b"".join(parts)


def _inflated(data: bytes) -> bytes:
    """Contents of gzip members or a zlib or raw deflate stream, as far as they go; other data as it is."""
    for wbits in (47, -15):
        parts, rest = [], data
        try:
            while rest:
                stream = zlib.decompressobj(wbits)
                parts += [stream.decompress(rest), stream.flush()]
                rest = stream.unused_data if wbits > 0 else b""
        except zlib.error:
            if not any(parts):
                continue
        return b"".join(parts)
    return data


def body_of(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The payload without the encodings that its HTTP headers name."""
    named = {n.lower(): v.lower() for n, v in reversed(http)}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    for coding in reversed(named.get("content-encoding", "").split(",")):
        if coding.strip() in ("gzip", "x-gzip", "deflate"):
            payload = _inflated(payload)
    return payload


def links_of(html: str) -> list[dict[str, str]]:
    """Targets of the tags outside comments and scripts, character references decoded."""
    tags = _NO_TAGS.sub(r"\1", html)
    return [{"path": f"{m[1].lower()}@/{m[2].lower()}", "url": unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(tags)]


def derive(data: bytes) -> list[tuple]:
    """(kind, record id, refers to, target, date, payload digest, block digest, block length, record, problem) per derivative."""
    try:
        headers, block = parse_record(data)
    except ValueError as problem:
        return [("rejected", None, None, None, None, None, None, None, None, str(problem))]
    named = {n.lower(): v for n, v in reversed(headers)}
    if named.get("warc-type", "").lower() != "response":
        return []
    source = named.get("warc-record-id")
    if not source:
        return [("rejected", None, None, None, None, None, None, None, None, "no record id")]
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        return [("rejected", None, source, None, None, None, None, None, None, "no HTTP headers")]
    status, _, lines = head.partition(b"\r\n")
    http = _header_lines(lines)
    charset = next((m[1] for n, v in http if n.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w-]+)", v, re.I))), "utf-8")
    body = body_of(payload, http)
    try:
        html = body.decode(charset, "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    digest = named.get("warc-payload-digest") or sha1_digest(payload)
    target, date = named.get("warc-target-uri"), named.get("warc-date")
    title = _TITLE.search(html)
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": [list(h) for h in headers],
            "Payload-Metadata": {
                "Actual-Payload-Digest": sha1_digest(payload), "Actual-Block-Digest": sha1_digest(block),
                "HTTP-Response-Metadata": {
                    "Status-Line": status.decode("utf-8", "replace"), "Headers": [list(h) for h in http], "Payload-Length": len(payload),
                    "HTML-Metadata": {
                        "Title": " ".join(title[1].split()) if title else None,
                        "Links": links_of(html),
                    },
                },
            },
        }
    }
    text = "\n".join(b.text for b in blocks_of(html))
    kinds = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", text.encode())]
    made = []
    for kind, content, own in kinds:
        own_id = record_id(kind, source)
        kept = [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", digest)]
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own_id), *[(n, v) for n, v in kept if v is not None], ("Content-Type", content)]
        made.append((kind, own_id, source, target, date, digest, sha1_digest(own), len(own), record_bytes(lines, own), None))
    return made


_FIELDS = [
    ("kind", pa.string(), T.StringType()), ("record_id", pa.string(), T.StringType()), ("refers_to", pa.string(), T.StringType()),
    ("target_uri", pa.string(), T.StringType()), ("warc_date", pa.string(), T.StringType()), ("payload_digest", pa.string(), T.StringType()),
    ("block_digest", pa.string(), T.StringType()), ("block_length", pa.int64(), T.LongType()), ("record", pa.binary(), T.BinaryType()),
    ("problem", pa.string(), T.StringType()),
]


@F.arrow_udf(T.BinaryType())
def _responses(urls: pa.Array, pages: pa.Array, dates: pa.Array) -> pa.Array:
    return pa.array([response_record(*r) for r in zip(urls.to_pylist(), pages.to_pylist(), dates.to_pylist())], pa.binary())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, k) for n, _, k in _FIELDS])))
def _derived(records: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(n, k) for n, k, _ in _FIELDS]))
    names = [n for n, _, _ in _FIELDS]
    return pa.array([[dict(zip(names, d)) for d in derive(r)] if r is not None else [] for r in records.to_pylist()], kind)


def responses(url: Column, html: Column, date: Column | None = None) -> Column:
    """A WARC response record, as bytes, for every page."""
    return _responses(url, html, F.lit(None).cast("string") if date is None else date)


def derivatives(records: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """The derivative records of all records, one row each, beside the columns named in ``keep``."""
    return records.select(*keep, F.explode(_derived(F.col(record))).alias("d")).select(*keep, "d.*")


def write_records(records: DataFrame, path: str, record: str = "record", compression: str = "none") -> None:
    """Write records as WARC files; Spark's text writer sets the line ends between them."""
    closed = F.concat(F.col(record).cast("string"), F.lit("\r\n"))
    records.filter(F.col(record).isNotNull()).select(closed).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of any version of the series, cut by Spark's text reader where a version line follows a blank line.

    A block that holds such a line itself is cut too; its parts come out as rejected, not as wrong records.
    """
    cut = spark.read.option("lineSep", SPLIT).text(path).filter("value <> ''")
    whole = F.when(F.col("value").startswith("WARC/"), F.col("value")).otherwise(F.concat(F.lit(SERIES), F.col("value")))
    return cut.select(whole.cast("binary").alias("record"))
