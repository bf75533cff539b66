"""WARC archives with revisit records: written, deduplicated by payload digest, read back and resolved."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, shared_dir, table

# The format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"  # of headers, and of a record
RECORDS = 50_000  # of a file
_HEADERS = "record_id string, type string, page_id long, uri string, date string, digest string, refers_to string"
_READ = f"{_HEADERS}, bytes long, check binary, http binary, payload binary, valid boolean"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: four digits for every five."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def urn(*of: Column) -> Column:
    """A record id that follows from the given values."""
    h = F.md5(F.concat_ws("\x00", *of))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null. What would end a line is percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def rendered(records: DataFrame) -> DataFrame:
    """value: each record as it stands in an archive, but for the four characters that end it.

    records: record_id, type (response or revisit), page_id, uri, date, digest, payload (binary; null: empty), refers_to,
    refers_to_uri, refers_to_date. A revisit has the HTTP headers of its response and no payload. Values null: no header.
    """
    payload = F.coalesce("payload", F.lit(b""))
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(revisit, "").otherwise(_line("Content-Length", F.octet_length(payload))), F.lit("\r\n"))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(payload))
    named = [("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri")), ("X-Page-ID", F.col("page_id"))]
    named += [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, PROFILE))]
    named += [(f"WARC-{n}", F.when(revisit, F.col(c))) for n, c in (("Refers-To", "refers_to"), ("Refers-To-Target-URI", "refers_to_uri"), ("Refers-To-Date", "refers_to_date"))]
    head = F.concat(F.lit(f"{VERSION}\r\n"), *[_line(n, v) for n, v in named], F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length("block")), F.lit("\r\n"))
    return records.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))


def write_archive(records: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """Write records as gzip archives below path, wherever Spark can write. Bytes that are not UTF-8 stay as they are.

    A record is one row whose line end is the end of a record, so tasks stream and a file appears when its task is done.
    """
    rendered(records).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class Parser:
    """Records of a stream of bytes that comes in parts; holds one record at most."""

    def __init__(self):
        self.parts, self.size, self.need, self.head = [], 0, 0, None

    def feed(self, part: bytes) -> Iterator[tuple[dict, bytes]]:
        """(headers in small letters, block) of each record that ends within part."""
        self.parts.append(part)
        self.size += len(part)
        while self.size >= max(self.need, 1):
            data = b"".join(self.parts)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                self.parts, self.size = [data], len(data)
                if not data:
                    return
                end = data.find(END)
                if end < 0:
                    self.need = self.size + 1
                    return
                lines = data[:end].decode("utf-8", "surrogateescape").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not the start of a record: {data[:60]!r}")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                self.need, data = int(self.head["content-length"]) + len(END), data[end + len(END) :]
            else:
                if data[self.need - len(END) : self.need] != END:
                    raise ValueError("a record is longer or shorter than its Content-Length")
                yield self.head, data[: self.need - len(END)]
                data, self.head, self.need = data[self.need :], None, 0
            self.parts, self.size = [data], len(data)

    def close(self) -> None:
        if self.size or self.head is not None:
            raise ValueError("an archive ends within a record")


def _record(head: dict, block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(END) if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    revisit, digest, page = head.get("warc-type") == "revisit", (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, head.get("x-page-id")
    own = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    text = lambda name: (v := head.get(name)) and v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return (
        text("warc-record-id"), text("warc-type"), None if page is None else int(page), text("warc-target-uri"), text("warc-date"), digest if revisit else own, text("warc-refers-to"),
        None if revisit else len(payload), None if revisit else hashlib.sha256(payload).digest(), http if payloads else None, payload if payloads and not revisit else None,
        revisit or digest in (None, own),
    )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the gzip archives below path: headers, digest and size of the payload, http, payload, valid.

    digest and check (SHA-256) are of the payload as read; for a revisit the digest is the stated one and bytes is null.
    valid: the payload has the digest that its header states. Without payloads, http and payload are null. A file that
    ends within a record, or whose lengths are wrong, is an error. An empty archive gives no rows.

    A gzip file is one stream of one task. It comes in parts that end where two line ends stand; records are put together
    from as many as their length asks for, so a task holds a batch of parts and one record.
    """
    names = [f.split()[0] for f in _READ.split(", ")]

    def parse(batches):
        parser, file = Parser(), None
        for batch in batches:
            rows = []
            for value, name in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                if name != file:
                    parser.close()
                    file = name
                rows += [_record(*r, payloads) for r in parser.feed(value.as_py() + END)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)
        parser.close()

    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in _READ.split(", ")]
    # gzip files are never cut, and others are not taken
    parts = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(path)
    return parts.select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(parse, _READ)


def page_records(pages: DataFrame, date: str | None = None) -> DataFrame:
    """A response record for each row of pages (page_id, url, html; null html: empty), with a new record id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    when = F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    null = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"), F.lit("response").alias("type"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"),
        when.alias("date"), base32(F.sha1(payload)).alias("digest"), payload.alias("payload"), null.alias("refers_to"), null.alias("refers_to_uri"), null.alias("refers_to_date"),
    )


def resolved(headers: DataFrame) -> DataFrame:
    """headers with bytes and digest of revisits taken from the responses they refer to, and refers_to_page.

    headers: records as read, stored, as they are read twice. A revisit whose response is not among them keeps its stated
    digest and has null bytes. Many revisits may refer to one response; responses are unique by record_id, so the
    adaptive join can split the revisits.
    """
    named = headers.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("bytes").alias("o_bytes"), F.col("check").alias("o_check"), F.col("digest").alias("o_digest"))
    own = headers.where("type = 'revisit'").join(named, "refers_to", "left")
    own = own.withColumns({"bytes": F.col("o_bytes"), "check": F.col("o_check"), "digest": F.coalesce("o_digest", "digest")}).select(*headers.columns, "refers_to_page")
    return headers.where("type = 'response'").withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(own)


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, date: str | None = None) -> None:
    """Write the archives below source anew below target: of equal payloads one response, the others revisits of it.

    The response is that with the smallest page_id (null: last; ties: the smaller record id). Payloads of under `least`
    bytes are all responses. Payloads are equal if SHA-1 and SHA-256 are. A revisit of the source refers to the new
    response; one whose response is not in the source stays and refers to where it did. All records get new ids and,
    if given, a new date; other headers are made from the values read. Only responses and revisits are taken over.

    Headers alone are shuffled by digest, the smallest of each digest being combined before. Payloads are read again and
    meet the list of those that become revisits, by record id: broadcast where Spark finds the list small, else a shuffle.
    """
    headers = materialize(read_archive(spark, source, payloads=False).where("type in ('response', 'revisit')").drop("http", "payload"), "headers")
    known = materialize(resolved(headers).select("record_id", "type", "page_id", "uri", "date", "digest", "check", "bytes", "refers_to"), "known")
    rank = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    first = known.where(f"type = 'response' and bytes >= {int(least)}").groupBy("digest", "check").agg(F.min(rank)["record_id"].alias("to"), F.min_by(F.struct("uri", "date"), rank).alias("o"))
    again = known.join(first, ["digest", "check"]).where("record_id <> to").select("record_id", "to", F.col("o.uri").alias("to_uri"), F.col("o.date").alias("to_date"))
    again = materialize(again, "revisits")
    fresh = lambda c: urn(F.col(c), F.lit(target))
    kept = read_archive(spark, source).where("type in ('response', 'revisit')").join(again, "record_id", "left")
    revisit = (F.col("type") == "revisit") | F.col("to").isNotNull()
    moved = F.when(F.col("to").isNotNull(), fresh("to")).otherwise(F.col("refers_to"))
    out = kept.select(
        fresh("record_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "page_id", "uri", F.lit(date).alias("date") if date else "date", "digest",
        F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, moved).alias("refers_to"), F.when(revisit, F.col("to_uri")).alias("refers_to_uri"),
        F.when(revisit, F.lit(date) if date else F.col("to_date")).alias("refers_to_date"),
    )
    write_archive(out, target)


def page_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from deduplicated archives.

    Null html is an empty payload, and empty payloads are equal. Rows without page_id come last among equals, so they are
    revisits where a row with one is there; their refers_to is the page_id, which is null if none has one. Of rows that
    repeat a page_id and html one is the response and the others refer to that page_id. Line ends in a url are
    percent-encoded. Very long pages are one record. An empty table gives no rows. Other columns are ignored.

    The pages are written as responses first, so the ids that all later steps go by are fixed in the shared folder.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tidewatch-warc-{uuid.uuid4().hex}"
    write_archive(page_records(pages), f"{folder}/crawled")
    deduplicate(spark, f"{folder}/crawled", f"{folder}/kept", least)
    read = materialize(read_archive(spark, f"{folder}/kept", payloads=False).drop("http", "payload"), "read")
    wrong = F.raise_error(F.lit("a payload does not have the digest of its header"))
    return resolved(read).select("page_id", F.col("bytes").alias("payload_bytes"), F.when(F.col("valid"), F.col("digest")).otherwise(wrong).alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_revisits(table(spark, sf_dir, "pages"))


# DuckDB has SHA-1 in hexadecimal digits; five of them are four of base32.
OP13_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) payload, row_number() over () as row from pages),
d as (select page_id, row, octet_length(payload) payload_bytes, payload, sha1(payload) h from p),
b as (select page_id, row, payload_bytes, payload, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4),
    lambda j: '{BASE32}'[((('0x' || h[5 * i + 1:5 * i + 5])::bigint >> (15 - 5 * j)) & 31) + 1]), '')), '') payload_digest from d),
m as (select *, row_number() over (partition by payload order by page_id nulls last, row) = 1 as own, min(page_id) over (partition by payload) low from b)
select page_id, payload_bytes, payload_digest, case when own then 'response' else 'revisit' end record_type, case when not own then low end refers_to from m
"""
