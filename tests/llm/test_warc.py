"""op13: archives as bytes, round trips, revisits against plain grouping."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import warc

PAGE = "page_id long, url string, html string"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    """Of rows (page_id, html): the sorted rows that the query gives."""
    groups, out = {}, []
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for at, i in enumerate(ids):
            again = at > 0 and len(payload) >= least
            out.append((i, len(payload), sha(payload), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def line_ends(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["\r", "\n", "\r\n", "\r\n\r\n", "x", "WARC/1.1", "é"]) for _ in range(r.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_equals_plain_grouping(spark, least):
    rows = [(i, h) for i, h in enumerate(line_ends(120, 3))]
    rows += [(500, None), (501, ""), (None, "no id"), (None, "no id"), (7, "same"), (7, "same"), (3, "same"), (None, "same"), (600, "long\r\n\r\n" * 50_000), (601, "\x00\U0001f600")]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC-Type: revisit", h, "t", 1, "d") for i, h in rows], PAGE + ", type string, bytes int, digest string").repartition(3)
    assert rows_of(warc.page_revisits(df, least)) == brute(rows, least)


def test_no_pages(spark):
    assert warc.page_revisits(spark.createDataFrame([], PAGE)).count() == 0


def test_archives_are_warc(spark, tmp_path):
    """Read by a plain reader: fields, lengths, and nothing between records."""
    pages = spark.createDataFrame([(1, "http://a/", "é\r\n\r\n"), (2, None, "é\r\n\r\n"), (3, "http://c/", None)], PAGE)
    warc.write_archive(warc.page_records(pages, "2026-01-02T03:04:05Z"), f"{tmp_path}/one")
    warc.deduplicate(spark, f"{tmp_path}/one", f"{tmp_path}/two", date="2026-02-03T04:05:06Z")
    found = {}
    for f in glob.glob(f"{tmp_path}/two/*.gz"):
        data = gzip.open(f).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
            assert lines[0] == "WARC/1.1" and end == b"\r\n\r\n"
            found[int(fields["X-Page-ID"])] = fields, block
    assert set(found) == {1, 2, 3} and len({f["WARC-Record-ID"] for f, _ in found.values()}) == 3
    one, two, three = (found[i] for i in (1, 2, 3))
    assert one[1].partition(b"\r\n\r\n")[2] == "é\r\n\r\n".encode() and three[1].partition(b"\r\n\r\n")[2] == b""
    assert two[0]["WARC-Type"] == "revisit" and two[0]["WARC-Refers-To"] == one[0]["WARC-Record-ID"] and two[0]["WARC-Refers-To-Target-URI"] == "http://a/"
    assert two[0]["WARC-Payload-Digest"] == one[0]["WARC-Payload-Digest"] == "sha1:" + sha("é\r\n\r\n".encode())
    assert {f["WARC-Date"] for f, _ in found.values()} == {"2026-02-03T04:05:06Z"} and two[0]["WARC-Profile"] == warc.PROFILE and "WARC-Target-URI" not in two[0]
    assert b"\r\n\r\n" in two[1] and not two[1].partition(b"\r\n\r\n")[2]


def test_bytes_and_parts_of_any_size():
    """Records come out the same whatever the parts of the stream are."""
    r, blocks = random.Random(2), [x.encode() for x in line_ends(60, 4)] + [bytes(range(256))]
    data = b"".join(b"WARC/1.1\r\nA: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + warc.END for i, b in enumerate(blocks))
    for most in (1, 7, 5000):
        parser, got, at = warc.Parser(), [], 0
        while at < len(data):
            n = r.randint(1, most)
            got += parser.feed(data[at : at + n])
            at += n
        parser.close()
        assert [b for _, b in got] == blocks and [int(h["a"]) for h, _ in got] == list(range(len(blocks)))
    for broken in (data[:-5], data[:300], b"no archive\r\n\r\n", data.replace(b"Content-Length: 0", b"Content-Length: 9")):
        parser = warc.Parser()
        with pytest.raises(ValueError):
            list(parser.feed(broken))
            parser.close()


def test_payloads_that_are_not_text(spark, tmp_path):
    rows = [("<a>", bytes(range(256)) + b"\r\n\r\n\xff\r\n"), ("<b>", b"\xff\xfe"), ("<c>", b"")]
    records = warc.page_records(spark.createDataFrame([(1, "u", "")], PAGE)).drop("record_id", "payload", "digest").crossJoin(spark.createDataFrame(rows, "record_id string, payload binary"))
    warc.write_archive(records.withColumn("digest", warc.base32(F.sha1("payload"))), f"{tmp_path}/x")
    got = {r["record_id"]: r for r in warc.read_archive(spark, f"{tmp_path}/x").collect()}
    assert all(bytes(got[i]["payload"]) == p and got[i]["digest"] == sha(p) and got[i]["valid"] for i, p in rows)
    altered = records.withColumn("digest", F.lit(sha(b"other")))
    warc.write_archive(altered, f"{tmp_path}/y")
    assert not warc.read_archive(spark, f"{tmp_path}/y", payloads=False).where("valid").count()


def test_revisits_of_archives_are_resolved_again(spark, tmp_path):
    """A second pass over deduplicated archives joins their revisits to the responses, so the result stays the same."""
    pages = [(5, "u5", "same"), (9, "u9", "same"), (4, "u4", "other")]
    warc.write_archive(warc.page_records(spark.createDataFrame(pages, PAGE)), f"{tmp_path}/0")
    stray = spark.createDataFrame([("<s>", "revisit", 77, "u77", "d", sha(b"gone"), "<elsewhere>")], "record_id string, type string, page_id long, uri string, date string, digest string, refers_to string")
    warc.write_archive(stray.withColumns({"payload": F.lit(None).cast("binary"), "refers_to_uri": F.lit("u"), "refers_to_date": F.lit("d")}), f"{tmp_path}/0/more")
    more = spark.createDataFrame([(2, "u2", "same")], PAGE)
    for i in range(3):
        warc.deduplicate(spark, f"{tmp_path}/{i}", f"{tmp_path}/{i + 1}")
        got = {r["page_id"]: r for r in warc.resolved(warc.read_archive(spark, f"{tmp_path}/{i + 1}", payloads=False)).collect()}
        low = 5 if i < 2 else 2
        want = {p: low if h == "same" and p != low else None for p, _, h in pages} | {77: None} | ({2: None} if i == 2 else {})
        assert {p: r["refers_to_page"] for p, r in got.items()} == want
        assert {p: r["bytes"] for p, r in got.items()} == {p: 5 if p == 4 else None if p == 77 else 4 for p in want}
        assert got[77]["refers_to"] == "<elsewhere>" and got[9]["digest"] == sha(b"same")
        if i == 1:
            warc.write_archive(warc.page_records(more), f"{tmp_path}/2/more")
