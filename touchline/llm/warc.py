"""Operator 6: WARC derivatives. Response records become linked metadata and plain-text conversion records.

``responses`` stores web pages as WARC/1.1 response records; ``derivatives`` reads any response record and writes two
records for it: ``metadata`` (application/warc-fields: the source's HTTP status and headers, its digests, its links) and
``conversion`` (the page's text). Both name the response in WARC-Refers-To and keep its target URI and date; digests are
SHA-1 in base 32, as the format has them. Record ids follow from kind and source id, so a lost task writes the same
records again. Row by row, no shuffle: hot hosts and repeated rows need no care.

Bodies in chunks and with gzip (all members) or deflate codings, several in a row too, are undone before they are converted.

Defined results: a null page has an empty payload, a null URL an empty target; null and empty record values give a row
of kind ``null``, other values that are no whole response record, have no record id, or whose block or payload digest
differs, one of kind ``damaged``; so have responses whose chunks or codings end early or break, have something else
behind their end, are unknown here (``br``), or unpack to more than ``MOST`` bytes: half a page never stands for a whole
one. A body that says it is in chunks and does not begin with one is taken as it is; an empty body is empty in any coding; a response whose body is empty gives an empty text. Very long pages take time and
memory in proportion to their length. Repeated rows give repeated records; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Date of records made from pages that carry none.
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of HTML: raw and silent elements, silent ones with markup, what a head may hold, cells, line ends.
RAW = frozenset(["script", "style", "title"])
CLOSED = ("noscript", "template")
IN_HEAD = frozenset(["title", "meta", "link", "script", "style", "base", "noscript", "template", "bgsound", "basefont"])
CELLS = frozenset(["td", "th", "dt", "dd", "option"])
ASCII_UPPER = re.compile("[A-Z]+")
#: Bytes of a page once a coding is undone; more are taken for damage, so that a bomb does not end an executor.
MOST = 1 << 30
LINES = frozenset(["p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "header", "footer", "nav"])
COLUMNS = ["kind", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_block_digest", "source_payload_digest", "source_headers", "block", "record"]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record; header values lose line breaks."""
    clean = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "".join(clean) + "\r\n").encode() + block + b"\r\n\r\n"


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def response(url: str | None, html: str | None, key: str = "") -> bytes:
    body = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = [("WARC-Type", "response"), ("WARC-Record-ID", _id("response", key, url or "", digest(body))), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body))]
    return record(head, block)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in b" \t" and out and line:
            out[-1] = out[-1][0], out[-1][1] + " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            out.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if it is not whole or its block digest differs."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        return None
    headers = {k.lower(): v for k, v in _fields(lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    block = rest[: int(size)]
    named = headers.get("warc-block-digest", "")
    return None if named.startswith("sha1:") and named != digest(block) else (headers, block)


TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)(?>[^>=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>")
HREF = re.compile(r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def html_text(html: str) -> tuple[str, list[str]]:
    """Visible text, a line a block and a space between cells, and the links in order. One pass, in linear time.

    A comment or a tag that never ends takes the rest of the page, as browsers have it; so does a script, style or title.
    A ``noscript`` or ``template`` is silent if it has an end; a head is until its end, the body, or what no head holds.
    """
    out: list[str] = []
    links: list[str] = []
    lower = html.lower() if html.isascii() else ASCII_UPPER.sub(lambda m: m[0].lower(), html)  # places stay the same
    ends = {tag: lower.rfind("</" + tag) for tag in CLOSED}
    silent, head, at = dict.fromkeys(CLOSED, 0), False, 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at and not head and not any(silent.values()):
            out.append(unescape(html[at:start]))
        at = start
        if at >= len(html) - 1:
            break
        follows = html[at + 1]
        if follows in "!?" or (follows == "/" and not html[at + 2 : at + 3].isalpha()):
            end, width = (html.find("-->", at + 2), 3) if html.startswith("<!--", at) else (html.find(">", at), 1)
            if end < 0:
                break
            at = end + width
            continue
        if not (follows == "/" or (follows.isascii() and follows.isalpha())):
            if not head and not any(silent.values()):
                out.append("<")
            at += 1
            continue
        tag = TAG.match(html, at)
        if not tag:
            break
        at, name, closes = tag.end(), tag[1].lower(), follows == "/"
        if name in LINES:
            out.append("\n")
        elif name in CELLS:
            out.append(" ")
        if closes:
            head = head and name != "head"
            if silent.get(name):
                silent[name] -= 1
            continue
        if name == "head":
            head = True
        elif head and name not in IN_HEAD:
            head = False
        if name == "a":
            found = HREF.search(tag[0])
            link = found and (found[1] or found[2] or found[3])
            links += [unescape(link)] if link else []
        elif name in RAW:
            end = lower.find("</" + name, at)
            if end < 0:
                break
            at = end
        elif name in CLOSED and ends[name] >= at:
            silent[name] += 1
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), links


def chunked(body: bytes) -> bytes | None:
    """The data of a body in chunks; None if they break before the last one, the body itself if it is not in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None if at else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if body[at - 2 : at] != b"\r\n":
            return None


def inflated(body: bytes, bits: int, members: bool, most: int) -> bytes | None:
    """Everything that ``body`` holds; None if it ends early, is something else, or holds more than ``most`` bytes."""
    out, size = [], 0
    while True:
        d = zlib.decompressobj(bits)
        try:
            out.append(d.decompress(body, most - size + 1))
        except zlib.error:
            return None
        size += len(out[-1])
        if size > most or not d.eof:
            return None
        body = d.unused_data.lstrip(b"\0") if members else d.unused_data  # members may be filled up with zeros
        if not body:
            return b"".join(out)
        if not members:
            return None


def unpacked(body: bytes, codings: list[str], most: int = MOST) -> bytes | None:
    """The body without its codings, the last one first; None if one of them is unknown or not whole."""
    for coding in reversed(codings):
        if not body or coding in ("", "identity"):
            continue
        if coding in ("gzip", "x-gzip"):
            body = inflated(body, 31, True, most)
        elif coding == "deflate":  # with the format's header, or as some servers have it, without
            whole = inflated(body, 15, False, most)
            body = inflated(body, -15, False, most) if whole is None else whole
        else:
            return None
        if body is None:
            return None
    return body


def derive(data: bytes | None) -> list[dict]:
    """The rows of one response record."""
    if not data:
        return [{"kind": "null"}]
    got = parse(data)
    if got is None or got[0].get("warc-type") != "response":
        return [{"kind": "damaged"}]
    headers, block = got
    source = headers.get("warc-record-id", "")
    if not source:
        return [{"kind": "damaged"}]
    head, _, body = block.partition(b"\r\n\r\n")
    payload = headers.get("warc-payload-digest", "")
    lines = head.split(b"\r\n")
    http = _fields(lines[1:])
    named = {k.lower(): v for k, v in http}
    listed = lambda name: [c.strip().lower() for c in named.get(name, "").split(",")]
    moved = listed("transfer-encoding")
    plain = chunked(body) if moved[-1] == "chunked" else body
    if plain is None or (payload.startswith("sha1:") and payload not in (digest(body), digest(plain))):  # writers differ in which one they name
        return [{"kind": "damaged"}]
    plain = unpacked(plain, listed("content-encoding") + (moved[:-1] if moved[-1] == "chunked" else moved))
    if plain is None:
        return [{"kind": "damaged"}]
    charset = re.search(r"charset=\"?([\w-]+)", named.get("content-type", ""))
    try:
        html = plain.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = plain.decode("utf-8", "replace")
    text, links = html_text(html)
    uri, date = headers.get("warc-target-uri", ""), headers.get("warc-date", DATE)
    digests = headers.get("warc-block-digest") or digest(block), payload or digest(body)
    status = lines[0].decode("utf-8", "replace")
    notes = [("source-status", status), *((f"source-header-{k}", v) for k, v in http), ("source-block-digest", digests[0]), ("source-payload-digest", digests[1]), *(("outlink", x) for x in links)]
    fields = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in notes).encode()
    out = []
    for kind, kind_type, content in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = _id(kind, source)
        whole = record([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", kind_type)], content)
        out.append(dict(zip(COLUMNS, (kind, own, source, uri, date, kind_type, digest(content), *digests, [{"name": k, "value": v} for k, v in http], content, whole))))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): each page as a response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(u, h, str(i)) for i, u, h in zip(*(b[c].to_pylist() for c in ("id", "url", "html")))]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(made, pa.binary())], ["id", "record"])

    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, record binary").withColumnRenamed("id", id_col)


def derivatives(df: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """(id, kind, record_id, refers_to, target_uri, date, content_type, digests, source_headers, block, record) of each derivative."""
    kinds = [*[pa.string()] * 9, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, data in enumerate(b["record"]):
                found = derive(data.as_py())
                at += [k] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), *(pa.array([r.get(c) for r in rows], t) for c, t in zip(COLUMNS, kinds))], ["id", *COLUMNS])

    kept = df.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    schema = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", *(f"{c} string" for c in COLUMNS[:9]), "source_headers array<struct<name:string,value:string>>, block binary, record binary"])
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of every page."""
    return derivatives(responses(table(spark, sf_dir, "pages")))
