r"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response record (bytes, WARC/1.1) is parsed into its named fields and HTTP message; from it come a conversion record
(the page's visible text) and a metadata record (title, language, links, lengths). Both refer to the response's
WARC-Record-ID, keep its WARC-Target-URI and WARC-Date, and carry SHA-1 block and payload digests; the source's own
headers and digest are repeated in the metadata record.

Record ids are derived from the response's id and the record's type, so that reruns and retried tasks write the same
bytes. One streaming pass, no shuffle; a record is handled whole.

Files of several records, plain or gzipped by record, are split by read_records. Chunked transfer and gzip and deflate
encodings are undone before the text is taken.

Defined results: a null or unparsable response, or one in an unknown or broken encoding, yields no derivative and an error text; a null page is an empty body;
an empty table gives an empty result; repeated rows give repeated records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import read
from .per_document import as_batch, map_documents

CRLF = b"\r\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lumensift:warc")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record; line breaks inside field values are replaced by blanks, so no value can forge a field."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    lines = [b"WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in head)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case; the first of a name counts) and block. Raises ValueError if malformed."""
    head, sep, rest = raw.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not sep or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("field without a colon")
        last = name.strip().lower().decode("utf-8", "replace")
        fields.setdefault(last, value.strip().decode("utf-8", "replace"))
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no valid Content-Length") from None
    if n < 0 or len(rest) < n:
        raise ValueError("block is shorter than Content-Length")
    return fields, rest[:n]


def members(raw: bytes):
    """The parts of a gzip stream of several members, or the stream itself if it isn't compressed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        d = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            part = d.decompress(raw) + d.flush()
        except zlib.error:
            raise ValueError("broken gzip stream") from None
        if not d.eof:
            raise ValueError("gzip stream ends early")
        yield part
        raw = d.unused_data.lstrip(b"\0")


def split(raw: bytes):
    """Each record of a WARC file's bytes, plain or gzipped record by record, as (fields, whole record)."""
    for part in members(raw):
        at = 0
        while True:
            while part[at : at + 2] == CRLF:
                at += 2
            if at >= len(part):
                break
            fields, block = parse(part[at:] if at else part)
            end = part.index(CRLF * 2, at) + 4 + len(block)
            yield fields, part[at:end]
            at = end


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, body."""
    head, sep, body = block.partition(CRLF * 2)
    if not sep or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines[1:]) if c], body


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            raise ValueError("broken chunked body")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("broken chunked body")
        out.append(body[at : at + n])
        at += n + 2


def inflated(body: bytes) -> bytes:
    """HTTP's deflate: a zlib stream, or the raw one that some servers send."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(body) + d.flush()
        except zlib.error:
            continue
        if d.eof:
            return out
    raise ValueError("broken deflate body")


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its transfer and content encodings, the last applied undone first. Raises ValueError."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",")]
    for coding in reversed(named("content-encoding") + named("transfer-encoding")):
        if coding in ("", "identity") or not body:
            continue
        if coding == "chunked":
            body = unchunked(body)
        elif coding in ("gzip", "x-gzip"):
            try:
                body = gzip.decompress(body)
            except (OSError, EOFError, zlib.error):
                raise ValueError("broken gzip body") from None
        elif coding == "deflate":
            body = inflated(body)
        else:
            raise ValueError(f"unknown encoding {coding}")
    return body


#: What isn't shown; left open, it reaches to the end of the page.
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAKS = re.compile(r"<(?:/?(?:p|div|h[1-6]|ul|ol|table|tr|article|section|nav|header|footer|blockquote|pre|title|head|body)|br|hr|li|td)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def visible_text(page: str) -> str:
    text = _TAG.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def response(key: str, uri: str, date: str, body: bytes) -> bytes:
    """A response record for a fetched page."""
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]) + CRLF * 2 + body
    fields = [("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body))]
    return record("response", f"<urn:uuid:{uuid.uuid5(_SPACE, f'response {key}')}>", fields, block)


def derive(raw: bytes) -> tuple[bytes, bytes, dict]:
    """(conversion record, metadata record, facts) of a response record."""
    fields, block = parse(raw)
    if fields.get("warc-type", "").lower() != "response" or "warc-record-id" not in fields:
        raise ValueError("not a response record with an id")
    status, headers, body = http(block)
    source = fields["warc-record-id"]
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = m[1] if (m := re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)) else "utf-8"
    plain = decoded(headers, body)
    try:
        page = plain.decode(charset, "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    text = visible_text(page)
    block_text = text.encode()
    shared = [("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Date", fields.get("warc-date", "")), ("WARC-Refers-To", source)]
    ids = [f"<urn:uuid:{uuid.uuid5(_SPACE, f'{k} {source}')}>" for k in ("conversion", "metadata")]
    conversion = record("conversion", ids[0], [*shared, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(block_text))], block_text)
    title = " ".join(html.unescape(m[1]).split()) if (m := _TITLE.search(page)) else ""
    lang = m[1].lower() if (m := _LANG.search(page)) else ""
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    facts = [("title", title), ("lang", lang), ("link-count", str(len(links))), ("text-characters", str(len(text))), ("conversion-id", ids[0]), ("http-status", status)]
    facts += [(f"source-{k}", fields[k]) for k in ("warc-block-digest", "warc-payload-digest", "content-length") if k in fields] + [(f"source-http-{k.lower()}", v) for k, v in headers] + [("link", x) for x in links]
    body_meta = b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() + CRLF for k, v in facts)
    metadata = record("metadata", ids[1], [*shared, ("WARC-Concurrent-To", ids[0]), ("Content-Type", "application/warc-fields")], body_meta)
    return conversion, metadata, {"source": source, "conversion": ids[0], "metadata": ids[1], "title": title, "lang": lang, "n_links": len(links), "text": text, "uri": fields.get("warc-target-uri"), "payload": fields.get("warc-payload-digest") or digest(body)}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """key, response: a response record (binary) for every fetched page."""
    fn = lambda key, uri, body: (key, response(str(key), (uri or b"").decode("utf-8", "replace"), date, body or b""))
    return map_documents(pages, {id_col: "value", url_col: "text", html_col: "text"}, fn, "key long, response binary")


def read_records(files: DataFrame, key_col: str = "key", bytes_col: str = "content") -> DataFrame:
    """Responses of WARC files given as bytes: key, n (place in the file from 0), response; or n null and an error for a
    file that breaks, after the records before the break. Records of other types are passed over."""
    schema = "key long, n long, response binary, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for key, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = -1
                try:
                    if raw is None:
                        raise ValueError("no file")
                    for n, (fields, whole) in enumerate(split(raw)):
                        if fields.get("warc-type", "").lower() == "response":
                            yield as_batch([(key, n, whole, None)], arrow)
                except ValueError as e:
                    yield as_batch([(key, None, None, f"after record {n}: {e}")], arrow)

    return files.select(F.col(key_col).cast("long").alias("key"), F.col(bytes_col).cast("binary").alias("b")).mapInArrow(run, schema)


DERIVED = "key long, refers_to string, conversion_id string, metadata_id string, target_uri string, payload_digest string, title string, lang string, n_links long, text string, conversion binary, metadata binary, error string"


def derivatives(records: DataFrame, key_col: str = "key", record_col: str = "response") -> DataFrame:
    """Per response: its two derived records as bytes, their ids and the main facts, or an error."""

    def one(key, raw):
        try:
            if raw is None:
                raise ValueError("no record")
            conversion, metadata, f = derive(raw)
        except ValueError as e:
            return (key, *[None] * 11, str(e))
        return key, f["source"], f["conversion"], f["metadata"], f["uri"], f["payload"], f["title"], f["lang"], f["n_links"], f["text"], conversion, metadata, None

    return map_documents(records, {key_col: "value", record_col: "value"}, one, DERIVED)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derivatives(responses(read(spark, sf_dir, "pages")))
    return d.select(F.col("key").alias("page_id"), "refers_to", "conversion_id", "metadata_id", "target_uri", "payload_digest", "title", "lang", "n_links", "text", F.sha2("conversion", 256).alias("conversion_sha256"), F.sha2("metadata", 256).alias("metadata_sha256"), "error")
