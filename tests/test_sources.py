"""Vendor frames, sorted exports, counters of a stream, NFC and A-labels."""

import base64
import json
import random
import struct
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import content
from tidewatch.sources import exports, frames
from tidewatch.sources.views import Views
from tidewatch.streaming import counters, jobs


def tagged(**fields):
    ids = {n: t for t, n in frames.TAGS.items()}
    body = b"".join(bytes([ids[n], len(v)]) + v for n, v in ((n, v.to_bytes(8, "big") if isinstance(v, int) else v.encode()) for n, v in fields.items()))
    return frames.MAGIC + struct.pack(">H", len(body)) + body + bytes([sum(body) % 256])


def vendor_files(path):
    """Two files of each vendor, with good frames, broken ones and kinds that nobody knows."""
    good = [{"event_type": "call_start", "caller": f"+2332400000{i:02d}", "callee": "+233200000000", "timestamp_ms": 1000 + i, "cdr_id": f"c{i}"} for i in range(6)]
    (path / "generic").mkdir(parents=True)
    (path / "tagged").mkdir()
    (path / "generic" / "001.cdr").write_bytes(b"\n".join([json.dumps(good[0]).encode(), b"", b"{not json", b"[1]", json.dumps(good[1] | {"extra": [1]}).encode()]))
    (path / "generic" / "002.cdr").write_bytes(b"\n".join(json.dumps(x).encode() for x in [good[2] | {"event_type": "TELEPATHY"}, good[2] | {"timestamp_ms": "late"}, good[2] | {"caller": None}, good[2]]) + b"\n")
    broken = bytearray(tagged(**good[3]))
    broken[12] ^= 1
    (path / "tagged" / "001.cdr").write_bytes(b"\x00\x01junk" + tagged(**good[3]) + bytes(broken) + tagged(**(good[4] | {"cdr_id": ""})))
    (path / "tagged" / "002.cdr").write_bytes(tagged(**good[5]) + tagged(caller="x") + tagged(**good[5])[:-3])
    return good


def test_frames_of_two_vendors(spark, tmp_path):
    vendor_files(tmp_path)
    frames.register(spark)
    df = spark.read.format("vendor_frames").load(str(tmp_path))
    events, dead = frames.canonical_voice(df)
    got = {r["event_id"]: (r["kind"], r["caller"], r["ts_ms"]) for r in events.collect()}
    assert {i: x[2] for i, x in got.items() if len(i) < 20} == {"voice_c0": 1000, "voice_c1": 1001, "voice_c2": 1002, "voice_c3": 1003, "voice_c5": 1005} and len(got) == 6
    assert {x[0] for x in got.values()} == {"call_start"} and ("call_start", "+233240000004", 1004) in got.values()
    reasons = sorted((r["vendor"], r["file"], r["reason"]) for r in dead.collect())
    assert reasons == sorted(
        [("generic", "001.cdr", "not JSON"), ("generic", "001.cdr", "not a record"), ("generic", "002.cdr", "unknown kind"), ("generic", "002.cdr", "no time"), ("generic", "002.cdr", "no caller")]
        + [("tagged", "001.cdr", "broken frame"), ("tagged", "001.cdr", "no magic"), ("tagged", "002.cdr", "no kind"), ("tagged", "002.cdr", "broken frame")]
    )
    assert base64.b64decode(dead.where("reason = 'no magic'").first()["value"]) == b"\x00\x01junk"
    assert {r["vendor"] for r in df.where("vendor = 'tagged'").collect()} == {"tagged"}


def test_filters_on_the_vendor_choose_files(tmp_path):
    vendor_files(tmp_path)
    reader = frames.FrameReader(str(tmp_path))
    rest = list(reader.pushFilters([frames.EqualTo(("vendor",), "tagged"), frames.EqualTo(("caller",), "x")]))
    assert [p.vendor for p in reader.partitions()] == ["tagged", "tagged"] and [f.attribute for f in rest] == [("caller",)]
    assert frames.FrameReader(str(tmp_path / "none")).partitions()[0].path == "/dev/null"


def test_frames_as_a_stream(spark, tmp_path):
    """Each file is read once, a restart goes on behind the last, and the rows are those of the batch."""
    vendor_files(tmp_path / "in")
    frames.register(spark)

    def drain():
        src = spark.readStream.format("vendor_frames").option("filesPerBatch", 1).load(str(tmp_path / "in"))
        q = src.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    drain()
    (tmp_path / "in" / "generic" / "003.cdr").write_bytes(json.dumps({"event_type": "handoff", "caller": "a", "timestamp_ms": 5}).encode())
    drain()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(spark.read.format("vendor_frames").load(str(tmp_path / "in")))


def test_pages_of_a_sorted_export(spark, tmp_path, small):
    orders = Views(spark, small).table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    order = [F.desc("o_custkey"), F.asc("o_orderkey")]
    total = exports.sorted_export(orders.repartition(5), str(tmp_path / "x"), order, 4, 100)
    want = [tuple(r) for r in orders.orderBy(*order).collect()]
    assert total == len(want)
    for limit, offset in ((10, 0), (7, 95), (250, 333), (10, total - 3), (5, total), (3, total + 10)):
        got, n = exports.page(spark, str(tmp_path / "x"), limit, offset)
        rows = got.collect()
        assert n == total and [tuple(r)[:3] for r in rows] == want[offset : offset + limit] and [r["row"] for r in rows] == list(range(offset, offset + len(rows)))
    assert len(exports.page(spark, str(tmp_path / "x"), 10, 150)[0].inputFiles()) == 1
    assert exports.sorted_export(orders.limit(0), str(tmp_path / "y"), order) == 0 and exports.page(spark, str(tmp_path / "y"), 5)[0].count() == 0


def test_counters_of_a_replay(spark, tmp_path):
    """Rows, dead letters and events behind the watermark of each operator."""
    lines = [json.dumps({"event_id": i, "ts_ms": t}) for i, t in enumerate([1_000_000, 1_001_000, 1_001_000])] + ["broken"]
    late = [json.dumps({"event_id": 9, "ts_ms": 5_000_000}), json.dumps({"event_id": 0, "ts_ms": 1_000_000})]
    for part in (lines, late, [json.dumps({"event_id": 10, "ts_ms": 100})]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    listener = counters.Counters()
    spark.streams.addListener(listener)
    try:
        raw = counters.counted(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), "parse", dead=F.from_json("value", "event_id long").isNull() | ~F.col("value").startswith("{"))
        good, _ = jobs.parse_json(raw, "event_id long, ts_ms long")
        out = counters.counted(jobs.deduplicated(jobs.with_time(good)), "deduplicated")
        q = out.writeStream.format("noop").queryName("replay").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        for _ in range(100):  # the listener is told a little later
            got = {(r["operator"], r["counter"]): r["value"] for r in listener.totals(spark).collect()}
            if got.get(("dedupeWithinWatermark", "dropped_late")):
                break
            q.awaitTermination(1)
    finally:
        spark.streams.removeListener(listener)
    assert got[("parse", "rows")] == 7 and got[("parse", "dead")] == 1 and got[("dedupeWithinWatermark", "dropped_late")] >= 1
    assert got[("deduplicated", "rows")] + got[("dedupeWithinWatermark", "dropped_late")] >= 5
    listener.flush(spark, str(tmp_path / "counts"))
    assert spark.read.parquet(str(tmp_path / "counts")).where("query = 'replay'").count() > 4 and not [r for r in listener.rows if r[0] == "replay"]


# RFC 3492, 7.1: labels and their Punycode.
RFC = [
    ("他们为什么不说中文", "ihqwcrb4cv8a8dqg056pqjye"), ("他們爲什麽不說中文", "ihqwctvzc91f659drss3x8bo0yb"),
    ("なぜみんな日本語を話してくれないのか", "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa"), ("3年b組金八先生", "3b-ww4c5e180e575a65lsy2b"),
]


def test_a_labels(spark):
    rows = [(f"{u}.example.net", f"xn--{p}.example.net") for u, p in RFC]
    rows += [("Bücher.Example.", "xn--bcher-kva.example"), ("straße.de", "strasse.de"), ("mtn-раypal.com", "xn--mtn-ypal-g3h4i.com"), ("plain.org", "plain.org"), ("é..b", None), ("é" * 80 + ".net", None), ("", None), (None, None), ("ﬁne。net", None)]
    got = {r["d"]: r["c"] for r in spark.createDataFrame([(d,) for d, _ in rows], "d string").select("d", content.canonical_ascii(F.col("d")).alias("c")).collect()}
    for d, want in rows:
        if d and d.isascii() is False and want and not d.startswith("mtn"):
            assert got[d] == want
    assert got["plain.org"] == "plain.org" and got["é..b"] is None and got["é" * 80 + ".net"] is None and got[""] is None and got[None] is None
    assert got["mtn-раypal.com"].startswith("xn--") and got["mtn-раypal.com"] != "mtn-paypal.com"


def test_nfc_and_what_stays_in_the_jvm(spark):
    rows = ["été", "Å", "plain", "", None, "ẛ̣", "가"]
    got = [r["n"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", content.nfc(F.col("x")).alias("n")).orderBy("i").collect()]
    assert got == [None if x is None else unicodedata.normalize("NFC", x) for x in rows]
    seen = content._nfc.func(pd.Series([None, "é"]))
    assert seen[0] is None and seen[1] == "é"  # rows of ASCII come as null


def test_domain_query_equals_brute_force(spark, small):
    from tidewatch.plans.registry import queries

    rows = queries()["domain_idna"](spark, small).collect()
    assert len(rows) > 500 and any(not r["domain"].isascii() for r in rows)
    for r in rows:
        d = r["domain"].strip().rstrip(".").lower()
        try:
            want = ".".join(x if x.isascii() else x.encode("idna").decode() for x in d.split("."))
        except UnicodeError:
            want = None
        assert r["canonical"] == want or len(d) > 253


def test_urls_need_no_search_where_there_is_none(spark):
    rows = [("see http://A.com/x, and\nHTTPS://b.org/Y!", ["http://a.com/x", "https://b.org/Y"]), ("none: here", []), ("", []), (None, None)]
    got = [r["u"] for r in spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string").select("i", content.urls(F.col("x")).alias("u")).orderBy("i").collect()]
    assert got == [u for _, u in rows]


@pytest.mark.parametrize("seed", range(3))
def test_tagged_frames_find_their_place_again(seed):
    r, whole = random.Random(seed), []
    data = b""
    for i in range(40):
        own = tagged(event_type="call_end", caller=f"+1{i}", timestamp_ms=i)
        if r.random() < 0.3:
            own = own[: r.randrange(1, len(own))]
        else:
            whole.append(i)
        data += own
    good = [x["timestamp_ms"] for _, _, x in frames.tagged_frames(data) if isinstance(x, dict)]
    assert set(good) <= set(whole) and len(good) >= len(whole) * 0.6
