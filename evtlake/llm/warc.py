"""WARC derivatives: each response gives a metadata record and a plain-text conversion record linked to it.

Input columns: record_id, target_uri, date, http_headers, payload (HTML). Both derivatives keep the response's identifier
in refers_to, its HTTP headers in source_headers and its payload digest in source_digest, and carry a digest of their own
block. The conversion's block is the page's text: scripts, styles and comments dropped (those that never end, up to the
end of the page), block ends as line ends, other tags removed, entities with a semicolon resolved, white space runs joined;
the metadata's block is title, language and links, entities resolved too. `read_responses` and `write_records` read and
write WARC files with Spark's text source, which hands over bytes as they are; a payload_digest that a response brings stays
its source_digest. Content and transfer encodings inside HTTP are not undone.

Defined results: null columns count as empty text; empty pages give both records with empty values; repeated responses
give repeated derivatives with equal identifiers; identifiers are name-based UUIDs of the response's, so a rerun repeats
them; an empty table gives no records; further columns are ignored. Every pattern reads a page once, so the time for a very
long page grows with its length, whatever stands in it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded, lean

NAMES = ["record_id", "target_uri", "date", "http_headers", "payload"]
RECORDS = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, source_digest string, source_headers string, block string"
#: What stands between two records, but for the version.
BOUNDARY = b"\r\n\r\nWARC/"
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
# What is dropped with its content and how it ends, tags that end a line, tags, entities.
OPENS = re.compile(r"<(!--|(?:script|style)(?=[ \t\r\n\f/>]))", re.I)
CLOSES = {"!--": re.compile("-->"), "script": re.compile(r"</script[^<>]*>?", re.I), "style": re.compile(r"</style[^<>]*>?", re.I)}
LINE_TAGS = "p|br|div|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|title|article|section|nav|header|footer|blockquote|pre"
LINE_ENDS = re.compile(rf"</?(?:{LINE_TAGS})(?:[ \t\r\n\f/][^<>]*)?>", re.I)
TAGS = re.compile(r"</?[a-zA-Z!?][^<>]*>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
BLANKS, BREAKS = re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title(?:[ \t\r\n\f][^<>]*)?>([^<]*)", re.I)
PAGE = re.compile(r"<html[^<>]*", re.I)
LANG = re.compile(r"""[ \t\r\n\f]lang[ ]?=[ ]?("[^"<>]*"|'[^'<>]*'|[^ \t\r\n\f"'<>/]+)""", re.I)
LINK = re.compile(r"""<a[ \t\r\n\f](?:[^<>]*?[ \t\r\n\f])?href[ ]?=[ ]?("[^"<>]*"|'[^'<>]*'|[^ \t\r\n\f"'<>]+)""", re.I)


def resolved(text: str) -> str:
    """text with its entities resolved; no-break spaces become spaces."""
    return ENTITY.sub(lambda m: entities.unescape(m[0]), text).replace("\xa0", " ") if "&" in text or "\xa0" in text else text


def without_hidden(page: str) -> str:
    """The page with a space for each script, style and comment, read from left to right."""
    out, at = [], 0
    while found := OPENS.search(page, at):
        out += [page[at : found.start()], " "]
        end = CLOSES[found[1].lower()].search(page, found.end())
        if not end:
            return "".join(out)
        at = end.end()
    return "".join([*out, page[at:]])


def page_text(page: str) -> str:
    text = TAGS.sub(" ", LINE_ENDS.sub("\n", without_hidden(page)))
    return BREAKS.sub("\n", BLANKS.sub(" ", resolved(text))).strip(" \n")


def page_fields(page: str) -> tuple[str, str, list[str]]:
    """Title, language and distinct links in order."""
    title, tag = TITLE.search(page), PAGE.search(page)
    lang = LANG.search(tag[0]) if tag else None
    links = dict.fromkeys(resolved(x.strip("\"'")) for x in LINK.findall(page))
    return " ".join(resolved(title[1]).split()) if title else "", lang[1].strip("\"'") if lang else "", [x for x in links if x]


def identifier(kind: str, record_id: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {record_id}'.encode()).digest(), version=3)}"


def _sha1(data: bytes) -> str:
    return f"sha1:{hashlib.sha1(data).hexdigest()}"


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response."""
    rows = responses.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in NAMES), (F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None)).cast("string").alias("payload_digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record_id, uri, date, headers, page, digest in zip(*(c.to_pylist() for c in batch.columns)):
                source = digest or _sha1(page.encode())
                title, lang, links = page_fields(page)
                fields = f"title: {title}\r\nlanguage: {lang}\r\noutlinks: {len(links)}\r\n" + "".join(f"outlink: {x}\r\n" for x in links)
                for kind, content, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain", page_text(page))):
                    data = block.encode()
                    out.append((identifier(kind, record_id), kind, record_id, uri, date, content, len(data), _sha1(data), source, headers, block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return bounded(rows).mapInArrow(lean(run), RECORDS)


def header(records: DataFrame) -> Column:
    """The WARC header block of a record, up to the empty line."""
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    bracketed = lambda c: F.when(records[c] != "", F.concat(F.lit("<"), records[c], F.lit(">"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", records["warc_type"]),
        line("WARC-Record-ID", bracketed("record_id")),
        line("WARC-Refers-To", bracketed("refers_to")),
        line("WARC-Target-URI", records["target_uri"]),
        line("WARC-Date", records["date"]),
        line("WARC-Block-Digest", records["block_digest"]),
        line("WARC-Source-Payload-Digest", records["source_digest"]),
        # The response's own header lines, each under a prefix.
        line("WARC-Source-Headers", F.regexp_replace(records["source_headers"], "\r?\n", " | ")),
        line("Content-Type", records["content_type"]),
        line("Content-Length", records["content_length"].cast("string")),
    )


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as WARC files, one for each partition. Blocks are text, or binary and then written as they are."""
    lines = records.select(F.concat(header(records), F.lit("\r\n"), records["block"].cast("string")).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def record_of(data: bytes) -> tuple[dict[str, str], bytes, int | None]:
    """Header fields, block and Content-Length of the bytes that follow `WARC/`. Names in lower case, the first of equal ones; a line
    that begins with white space goes on with the line before."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon and name.strip():
            fields.setdefault(name.strip().lower(), value.strip())
    size = fields.get("content-length", "")
    return fields, block, int(size) if size.isdecimal() else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """fields map<string,string> (header names in lower case), block (bytes) and complete of each record in WARC files of any
    version, compressed or not.

    Spark's text source cuts the bytes at boundaries; Content-Length tells the block from what follows it, and joins the
    pieces of a block that holds a boundary itself. complete is false where a file, or a split of an uncompressed file whose
    block holds a boundary, ends before the block does.
    """
    lines = spark.read.option("lineSep", BOUNDARY.decode()).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, place, missing = [], None, 0  # of the record at hand: its pieces, split, and bytes of the block still to come
        for batch in batches:
            out = []
            for value, split in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and split != place:
                    out.append(finished(BOUNDARY.join(parts)))
                    parts = []
                if parts:
                    missing -= len(BOUNDARY) + len(value)
                else:
                    value = value.removeprefix(b"WARC/")
                    _, block, size = record_of(value)
                    missing = 0 if size is None else size - len(block)
                parts.append(value)
                place = split
                if missing <= 0:
                    out.append(finished(BOUNDARY.join(parts)))
                    parts = []
            if out:
                yield batch_of(out)
        if parts:
            yield batch_of([finished(BOUNDARY.join(parts))])

    def finished(data: bytes) -> tuple:
        fields, block, size = record_of(data)
        return list(fields.items()), block if size is None else block[:size], size is None or len(block) >= size

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["fields", "block", "complete"])

    return bounded(lines).mapInArrow(lean(run), "fields map<string,string>, block binary, complete boolean")


def decoded(payload: bytes, headers: str) -> str:
    """A page's text by the charset of its Content-Type, else by the one that its first bytes name, else UTF-8."""
    found = CHARSET.search(headers) or CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses of WARC files as `derivatives` takes them, with payload_digest: the record's own, else that of the
    payload's bytes as they are stored."""
    rows = read_records(spark, path).where("fields['warc-type'] = 'response'")
    names = {"record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
    rows = rows.select(*(F.coalesce(F.col("fields")[f], F.lit("")).alias(n) for n, f in names.items()), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record_id, uri, date, digest, block in zip(*(c.to_pylist() for c in batch.columns)):
                head, _, payload = block.partition(b"\r\n\r\n")
                headers = head.decode("utf-8", "replace")
                out.append((record_id.removeprefix("<").removesuffix(">"), uri, date, headers, decoded(payload, headers), digest or _sha1(payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], [*NAMES, "payload_digest"])

    return bounded(rows).mapInArrow(lean(run), ", ".join(f"{n} string" for n in [*NAMES, "payload_digest"]))
