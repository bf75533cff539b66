"""Keyed tables, the archive's look-ups, and the loop from flagged URLs to the block list."""

import glob

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import sinks
from tidewatch.sources.keyed import KeyedTable
from tidewatch.streaming import feedback

ROW = "k string, v long, x string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def held(table, **kw):
    out = table.read(**kw)
    return {} if out is None else {r["k"]: (r["v"], r["x"]) for r in out.collect()}


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_a_batch_changes_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), "v", 8)
    assert table.read() is None and table.published() is None and table.clean() == []
    table.upsert(frame(spark, *[(f"k{i}", 1, "a") for i in range(60)]), 0)
    before = {r["bucket"]: r["folder"] for r in table.manifest().collect()}
    table.upsert(frame(spark, ("k7", 2, "b")), 1)
    after = {r["bucket"]: r["folder"] for r in table.manifest().collect()}
    assert len(before) == 8 and [b for b in after if after[b] != before[b]] == [table.read().where("k = 'k7'").select(table.bucket()).first()[0]]
    assert held(table) == {f"k{i}": (1, "a") for i in range(60)} | {"k7": (2, "b")}
    assert held(table, before=1) == {f"k{i}": (1, "a") for i in range(60)}
    table.upsert(frame(spark, ("k7", 1, "old"), ("k8", 1, "same"), ("new", 0, None)), 2)
    assert held(table) == {f"k{i}": (1, "a") for i in range(60)} | {"k7": (2, "b"), "k8": (1, "same"), "new": (0, None)}


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), "v", 4)
    table.upsert(frame(spark, ("a", 1, "x"), ("b", 1, "x")), 0)
    want, kept = held(table), files(table.path)
    touched = table.write(frame(spark, ("a", 9, "lost")), 1)  # and the job ends here
    assert held(table) == want and table.published() == 0 and all(files(table.path)[f] == x for f, x in kept.items())
    table.clean()
    assert held(table) == want
    table.upsert(frame(spark, ("a", 2, "again")), 1)  # the batch is run again
    assert held(table) == want | {"a": (2, "again")} and len(touched) == 1
    table.upsert(frame(spark, ("a", 3, "published before")), 1)
    assert held(table) == want | {"a": (2, "again")}


def test_clean_up_keeps_what_versions_have(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), "v", 4)
    for batch in range(5):
        table.upsert(frame(spark, *[(f"k{i}", batch, str(batch)) for i in range(20)]), batch)
    one = held(table, before=4)
    assert table.clean() == [0, 1, 2] and held(table) == {f"k{i}": (4, "4") for i in range(20)} and held(table, before=4) == one
    assert {f.split("v=")[1].split("/")[0] for f in files(table.path)} == {"3", "4"}
    table.upsert(frame(spark).limit(0), 5)
    assert held(table) == {f"k{i}": (4, "4") for i in range(20)} and table.published() == 5


def rows_scanned(df):
    """The rows that the scan gave out."""
    df.collect()
    plan, todo = None, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        if p.nodeName().startswith("Scan parquet"):
            plan = p
        todo += [p.children().apply(i) for i in range(p.children().size())] + ([p.plan()] if "QueryStage" in p.nodeName() else [])
    return plan.metrics().apply("numOutputRows").value()


def test_archive_is_searched_by_request(spark, tmp_path):
    """Bloom filters leave out the row groups that cannot have the request: far fewer rows are scanned than there are."""
    n, start = 120_000, 1_700_000_000_000
    audit = spark.range(0, n, 1, 6).select((F.lit(start) + F.col("id") * 60_000).alias("event_ts_ms"), F.sha2(F.col("id").cast("string"), 256).alias("request_id"), F.concat(F.lit("N"), F.pmod(F.xxhash64("id"), F.lit(5000))).alias("subject_id"))
    months = sinks.archive(audit, str(tmp_path / "a"), 0)
    assert months.agg(F.sum("n")).first()[0] == n and months.count() == 4
    own = [r for r in audit.where("event_ts_ms % 41 = 0").limit(3).collect()]
    for r in own:
        found = sinks.audit_by(spark, str(tmp_path / "a"), "request_id", r["request_id"])
        assert [(x["event_ts_ms"], x["subject_id"]) for x in found.collect()] == [(r["event_ts_ms"], r["subject_id"])]
        assert rows_scanned(found) < n / 2
    assert sinks.audit_by(spark, str(tmp_path / "a"), "request_id", "absent").count() == 0
    got = sinks.audit_by(spark, str(tmp_path / "a"), "subject_id", own[0]["subject_id"], start, start + 30 * 86_400_000).collect()
    want = audit.where((F.col("subject_id") == own[0]["subject_id"]) & (F.col("event_ts_ms") < start + 30 * 86_400_000)).orderBy("event_ts_ms").collect()
    assert [r["request_id"] for r in got] == [r["request_id"] for r in want] and len(got) > 2


def test_entries_of_signals(spark):
    rows = [
        ("sms.malicious_url", "number", "N1", {"url_match": "http://Bad.Example.com/x", "url_category": "malware"}, 0.9, 5), ("voice.burst", "number", "N1", {"url_match": "a.com"}, 0.9, 5),
        ("ott.look", "url", "evil.net", {}, 0.8, 6), ("sms.url", "number", "N2", {}, 0.8, 6), ("sms.url", "url", "http://x.fine.org/", None, 0.8, 6), ("sms.url", "url", "not a domain", {}, 0.8, 7),
    ]
    sig = spark.createDataFrame(rows, "signal_kind string, subject_kind string, subject_id string, evidence map<string, string>, score double, ts_ms long")
    got = {(r["domain"], r["source"], r["category"], r["expires_ms"], r["reason"]) for r in feedback.entries(sig, spark.createDataFrame([("fine.org",)], "domain string"), 100).collect()}
    assert got == {
        ("bad.example.com", "signals:sms.malicious_url", "malware", 105, "added"), ("evil.net", "signals:ott.look", "phishing", 106, "added"),
        ("x.fine.org", "signals:sms.url", "phishing", 106, "allow_listed"), ("not a domain", "signals:sms.url", "phishing", 107, "invalid_domain"),
    }


def test_flagged_in_one_batch_is_blocked_in_the_next(spark, tmp_path):
    event = "event_id long, domain string, bad boolean, ts_ms long"
    parts = [[(1, "evil.net", True, 10), (2, "www.evil.net", False, 11), (3, "ok.org", True, 12)], [(4, "www.evil.net", False, 20), (5, "ok.org", False, 21), (6, None, False, 22), (7, "evil.net", False, 10_000)], [(8, "a.b.evil.net", False, 30)]]
    for rows in parts:
        spark.createDataFrame(rows, event).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(event).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def classify(df):
        return df.where("bad").select(F.lit("sms.malicious_url").alias("signal_kind"), F.lit("url").alias("subject_kind"), F.col("domain").alias("subject_id"), F.lit(None).cast("map<string,string>").alias("evidence"), F.lit(0.9).alias("score"), "ts_ms")

    allowed, table = spark.createDataFrame([("ok.org",)], "domain string"), feedback.block_list(spark, str(tmp_path / "list"), 4)

    def run(out, checkpoint):
        q = feedback.feedback_stream(src(), classify, allowed, table, str(tmp_path / out), str(tmp_path / checkpoint), 5000).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        return {(r["batch"], r["event_id"], r["blocked_by"]) for r in spark.read.parquet(str(tmp_path / out)).collect()}

    got = run("out", "ck")
    assert got == {(0, 1, None), (0, 2, None), (0, 3, None), (1, 4, "evil.net"), (1, 5, None), (1, 6, None), (1, 7, None), (2, 8, "evil.net")}
    assert run("again", "ck2") == got  # a replay from the start reads the same versions, and adds nothing
    assert {r["domain"] for r in table.read().collect()} == {"evil.net"} and table.published() == 2
