"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A record is a row: its headers as columns, its block as text. Files are written by Spark's text writer, record after record, and read
record by record by their stated lengths, plain or gzipped. Both derivatives name the response they come from (WARC-Refers-To), keep
its target, date and payload digest, and carry digests of their own blocks."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm.common import needed

#: Columns of a record and the headers that hold them, in the order of writing; a null has no header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "source_key": "X-Source-Key", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
DATE = "2020-01-01T00:00:00Z"
#: Patterns, applied in turn, that make plain text of HTML, with what takes each match's place.
TO_TEXT = [
    (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|title|section|article|header|footer|nav|pre|blockquote)\b[^>]*>", "\n"), (r"<[^>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""),
]
#: Two of these that give the same texts without a match at each single space or line break, which it would only put back.
SPARING = {r"[ \t\r\f]+": r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", r" ?\n[ \n]*": r" \n[ \n]*|\n[ \n]+"}


def record_id(*parts: Column) -> Column:
    """A name-based record id: the same parts always give the same one."""
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response record per page: an HTTP head with type and length, then the page. A null page is an empty one, a null address stays null,
    as does a null key. Line breaks in addresses become %0D and %0A, as a header is one line. Columns other than the three named are not read."""
    given = needed(pages, key=key_col, url=url_col, html=html_col)
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(head, body)
    return given.select(F.lit("response").alias("record_type"), record_id(F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce(uri, F.lit(""))).alias("record_id"),
                        F.lit(None).cast("string").alias("refers_to"), uri.alias("target_uri"), F.lit(date).alias("date"), F.col("key").cast("string").alias("source_key"),
                        digest(block).alias("block_digest"), digest(body).alias("payload_digest"), F.lit("application/http; msgtype=response").alias("content_type"), block.alias("block"))


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """Writes records as WARC/1.1 files, one per partition. A null block is empty."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\r\n"))).otherwise("") for c, name in HEADERS.items()]
    block = F.coalesce("block", F.lit(""))
    value = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"))
    records.select(value.alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file. A cut-off last record raises."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record begins at byte {at}")
        headers: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if end + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below ``path``, with the columns that `write_records` takes. A task holds one file at a time in memory.
    Blocks that are not UTF-8 come with replacement characters; their digests still tell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for content in batch.column(0):
                data = content.as_py()
                rows = []
                for headers, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append([*[headers.get(name.lower()) for name in HEADERS.values()], block.decode("utf-8", "replace")])
                    if len(rows) == 500:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return files.mapInArrow(read, ", ".join(f"{c} string" for c in [*HEADERS, "block"]))


def _rows(rows: list[list[str | None]]) -> pa.RecordBatch:
    names = [*HEADERS, "block"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, blocks become lines, the commonest entities are read, space is collapsed.
    What stands for itself in a pattern is replaced as it is, which takes a fraction of the time."""
    out = html
    for pattern, place in TO_TEXT:
        literal = not set(pattern) & set(r"\^$.|?*+()[]{}")
        out = F.replace(out, F.lit(pattern), F.lit(place)) if literal else F.regexp_replace(out, SPARING.get(pattern, pattern), place)
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (warc-fields on the source: status, type, length, title, links) and ``conversion`` (plain
    text). Records of other types give none; a response without a blank line has an empty page. Equal responses give equal records."""
    found = records.where("record_type = 'response'")
    end = F.instr("block", "\r\n\r\n")
    head = F.when(end > 0, F.substring_index("block", "\r\n\r\n", 1)).otherwise("")
    page = F.when(end > 0, F.expr("substring(block, instr(block, '\\r\\n\\r\\n') + 4)")).otherwise("")
    source = found.select("*", head.alias("head"), page.alias("page"))
    source = source.select("*", F.regexp_extract("head", r"^HTTP/\S+ ([0-9]+)", 1).alias("source_status"), F.regexp_extract("head", r"(?i)\r\ncontent-type: *([^\r\n]*)", 1).alias("source_type"),
                           F.octet_length("page").alias("length"), F.regexp_count("page", F.lit(r"(?i)<a\s[^>]*href")).alias("links"),
                           F.regexp_replace(F.regexp_extract("page", r"(?is)<title[^>]*>(.*?)</title", 1), r"[\r\n\t ]+", " ").alias("title"))
    fields = F.concat(F.lit("status: "), "source_status", F.lit("\r\ncontent-type: "), "source_type", F.lit("\r\ncontent-length: "), F.col("length").cast("string"),
                      F.lit("\r\ntitle: "), "title", F.lit("\r\noutlinks: "), F.col("links").cast("string"), F.lit("\r\n"))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("page")).alias("block")))
    made = source.select("*", F.explode(kinds).alias("made"))
    return made.select("made.record_type", record_id(F.col("made.record_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "source_key",
                       digest(F.col("made.block")).alias("block_digest"), "payload_digest", "made.content_type", "made.block", "source_status", "source_type",
                       F.col("block_digest").alias("source_block_digest"), F.octet_length("made.block").cast("long").alias("content_length"))
