"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.markup import Ends, Scanner
from cytoloom.llm.shared import groups

VERSION = b"WARC/1."
FIELDS = ["record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "content_length", "block"]
# Fixed values of HTML: elements whose text isn't shown, those that a head may hold, and those that begin a line.
HIDDEN = frozenset("script style noscript template".split())
HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
LINES = frozenset("p div br hr li ul ol dl dt dd tr td th table h1 h2 h3 h4 h5 h6 section article aside header footer nav main form pre blockquote figure figcaption option title body html".split())


def plain_text(page: str | None) -> str:
    """All visible text of a page, a line for each block: scripts, styles, the head, comments and markup go, character references are
    decoded. A head ends with its end tag or with whatever can't stand in one; a "<" that opens no tag is text."""
    page = page or ""
    scan, ends, out, done, head = Scanner(page), Ends(page), [], 0, False
    for begin, end, slash, tag, _ in scan.tokens():
        if not head or page[done:begin].strip():
            head = False
            out.append(page[done:begin])
        done = end
        if not tag:
            out.append("<" if slash else "")
        elif tag == "head":
            head = not slash
        elif head and tag == "title" and not slash:
            if found := ends.find(r"</title\s*>", end):
                scan.at = done = found.end()
        elif tag in HIDDEN and not slash:
            found = ends.find(rf"</{tag}\s*>", end)
            scan.at = done = found.end() if found else len(page)
        elif head and tag not in HEAD:
            head = False
        if not head and tag in LINES:
            out.append("\n")
    out.append("" if head and not page[done:].strip() else page[done:])
    return "\n".join(t for t in (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n")) if t)


def digest(s: Column) -> Column:
    """A labelled digest of the string's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(s, "UTF-8"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based UUID from the parts, so that a task done again gives the same record."""
    h = F.md5(F.encode(F.concat_ws("\n", *parts), "UTF-8"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)), F.lit(">"))


def responses(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: an HTTP message of each row's whole html, with digests of the block and of its payload.

    Adds record_type, record_id, target_uri, date, content_type, http_headers, payload, block_digest, payload_digest and
    content_length; a null html is an empty payload, a null url an empty URI. The id depends on key, url and payload, so repeated rows
    repeat the record. Input columns with these names are replaced, others stay.
    """
    payload, uri = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    size = lambda c: F.octet_length(c).cast("long")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size(payload).cast("string"), F.lit("\r\n\r\n"))
    df = pages.withColumns({"payload": payload, "target_uri": uri, "http_headers": headers})
    block = F.concat("http_headers", "payload")
    return df.withColumns({
        "record_type": F.lit("response"), "record_id": record_id(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("target_uri"), digest(F.col("payload"))), "date": F.lit(date), "content_type": F.lit("application/http; msgtype=response"),
        "block_digest": digest(block), "payload_digest": digest(F.col("payload")), "content_length": size(block),
    })


def derive(source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A metadata and a conversion record of each response record, in two rows, with `keep` columns before FIELDS.

    source: columns record_type, record_id, target_uri, date, content_type, http_headers, payload, block_digest, payload_digest and
    content_length. Both records name the response in refers_to and keep its URI and date. The conversion's block is the page's plain
    text. The metadata's block lists the source's digests, length and HTTP headers and the conversion's id, digest and length; it is
    concurrent to the conversion. Rows that aren't responses (null included) derive nothing; null fields count as "". Empty text
    gives an empty conversion. One pass over the rows: nothing is shuffled.
    """

    @F.arrow_udf(T.StringType())
    def text_of(pages: pa.Array) -> pa.Array:
        return pa.array([plain_text(p) for part in groups(pages) for p in part.to_pylist()], pa.string())

    keep = keep or []
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    size = lambda c: F.octet_length(c).cast("long")
    mine = ["record_id", "target_uri", "date", "http_headers", "block_digest", "payload_digest", "content_length"]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    df = source.where(F.col("record_type") == "response").select(kept.alias("kept"), *mine, text_of("payload").alias("text"))
    df = df.withColumn("conversion", record_id(filled("record_id"), F.lit("conversion"), digest(F.col("text"))))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit("\r\n"))
    http = F.regexp_replace(F.rtrim(filled("http_headers"), F.lit("\r\n")), r"(^|\r\n)", "$1http-header: ")
    meta = F.concat(
        line("source-record-id", filled("record_id")), line("source-block-digest", filled("block_digest")), line("source-payload-digest", filled("payload_digest")), line("source-content-length", filled("content_length")),
        line("conversion-record-id", F.col("conversion")), line("conversion-block-digest", digest(F.col("text"))), line("conversion-content-length", size(F.col("text")).cast("string")), F.when(filled("http_headers") != "", F.concat(http, F.lit("\r\n"))).otherwise(F.lit("")),
    )
    df = df.withColumn("meta", meta)

    def record(kind: str, rid: Column, concurrent: Column, content_type: str, block: Column, payload: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"), rid.alias("record_id"), filled("record_id").alias("refers_to"), concurrent.alias("concurrent_to"), filled("target_uri").alias("target_uri"), filled("date").alias("date"),
            F.lit(content_type).alias("content_type"), digest(block).alias("block_digest"), payload.alias("payload_digest"), size(block).alias("content_length"), block.alias("block"),
        )

    none = F.lit(None).cast("string")
    both = F.array(
        record("metadata", record_id(filled("record_id"), F.lit("metadata"), digest(F.col("meta"))), F.col("conversion"), "application/warc-fields", F.col("meta"), none),
        record("conversion", F.col("conversion"), none, "text/plain; charset=utf-8", F.col("text"), digest(F.col("text"))),
    )
    return df.select("kept", F.explode(both).alias("record")).select(*(["kept.*"] if keep else []), *[F.col(f"record.{c}") for c in FIELDS])


def serialised(records: DataFrame) -> DataFrame:
    """One column, value: each record as WARC/1.0 text, without the two line ends after it; a response's block is its http_headers and
    payload. Line ends within a header's value become a space, so that no value makes a header of its own; null values are empty."""
    has = lambda c: c in records.columns
    block = F.col("block") if has("block") else F.concat("http_headers", "payload")
    optional = [("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Payload-Digest", "payload_digest")]
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n"))
    head = [F.lit("WARC/1.0\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", "date")]
    head += [F.when(F.coalesce(F.col(c), F.lit("")) != "", line(k, c)).otherwise(F.lit("")) for k, c in optional if has(c)]
    head += [line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit("\r\n")]
    return records.select(F.concat(*head, block).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records as WARC files, one a partition, through Spark's text writer, to any store that Spark writes."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers, block and completeness of the records whose version lines cut a file into pieces: a piece that is shorter than its
    Content-Length says goes on in the next one, as its block holds such a line."""
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-concurrent-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest", "content-length"]
    for piece in pieces:
        at = piece.find(b"\r\n\r\n")
        lines = re.sub(r"\r\n[\x20\t]+", " ", piece[: max(at, 0)].decode("utf-8", "replace")).split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head.get("content-length", "0")) if head.get("content-length", "0").isdecimal() else 0
        block, more = bytearray(piece[at + 4 :]) if at >= 0 else bytearray(), at >= 0
        while more and len(block) < size:
            follows = next(pieces, None)
            more = follows is not None
            block += VERSION + follows if more else b""
        yield {k: head.get(k, "") for k in names}, bytes(block[:size]), at >= 0 and len(block) >= size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, 1.0 and 1.1: FIELDS, complete, and http_headers and payload of responses. Spark's text reader cuts a file at
    the version lines, and pieces are put together again up to the record's Content-Length, in bytes. A record is incomplete if its file
    ends before, or, in an uncompressed file, the part of the file that one task reads. Bytes that aren't UTF-8 become replacement signs,
    while complete and content_length go by the bytes. Missing headers are null."""
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).where("value != ''").select(F.col("value").cast("binary").alias("value"))
    kinds = {c: pa.int64() if c == "content_length" else pa.string() for c in FIELDS} | {"complete": pa.bool_(), "http_headers": pa.string(), "payload": pa.string()}
    schema = ", ".join(f"{c} {'bigint' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'string'}" for c, t in kinds.items())

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0
        for head, block, whole in _records(v for b in batches for s in groups(b.column(0)) for v in s.to_pylist()):
            text = block.decode("utf-8", "replace")
            fields = [v or None for v in head.values()]
            fields[-1] = int(fields[-1]) if (fields[-1] or "").isdecimal() else None
            http = text.partition("\r\n\r\n") if head["warc-type"] == "response" else None
            rows.append([*fields, text, whole, *((http[0] + http[1], http[2]) if http else (None, None))])
            waiting += len(block)
            if waiting > 1 << 22:
                yield batch(rows)
                rows, waiting = [], 0
        if rows:
            yield batch(rows)

    return raw.mapInArrow(parsed, schema)
