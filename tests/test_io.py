"""Feeds, sinks and streams; a stream gives what the batch gives."""

import json

from pyspark.sql import functions as F

from tidewatch.operators import features
from tidewatch.plans.scoring import during_call
from tidewatch.sources import feeds, sinks
from tidewatch.sources.views import Views
from tidewatch.streaming import jobs


def test_feeds(spark, tmp_path):
    (tmp_path / "un.xml").write_text("<L><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>Ama</FIRST_NAME><SECOND_NAME>B</SECOND_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>AB</ALIAS_NAME></INDIVIDUAL_ALIAS><NATIONALITY><VALUE>GH</VALUE></NATIONALITY></INDIVIDUAL><INDIVIDUAL><DATAID>2</DATAID></INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>3</DATAID><FIRST_NAME>Co</FIRST_NAME></ENTITY></ENTITIES></L>")
    assert sorted((r["entry_id"], r["name"], r["kind"]) for r in feeds.un_xml(spark, str(tmp_path / "un.xml")).collect()) == [("1", "Ama B", "individual"), ("3", "Co", "entity")]
    (tmp_path / "o.csv").write_text('1,"DOE, John",individual,P,-0-,-0-,-0-,-0-,-0-,-0-,-0-,"DOB 1; nationality Ghana; x"\n2,SHIP,vessel,P,-0-,-0-,-0-,-0-,-0-,-0-,-0-,-0-\n')
    r = feeds.ofac_csv(spark, str(tmp_path / "o.csv")).collect()
    assert [(x["entry_id"], x["country"], x["kind"]) for x in r] == [("1", "Ghana", "individual")]
    (tmp_path / "g.csv").write_text("name,aliases\nA,x | y|\n,z\n")
    assert [list(x["aliases"]) for x in feeds.generic_csv(spark, str(tmp_path / "g.csv")).collect()] == [["x", "y"]]
    (tmp_path / "j.json").write_text(json.dumps([{"name": "A"}, {"name": " "}]))
    assert [x["kind"] for x in feeds.json_list(spark, str(tmp_path / "j.json")).collect()] == ["individual"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "en.json").write_text('{"a": "A", "b": "B"}')
    assert sorted((r["locale"], r["key"], r["template"]) for r in feeds.catalogue(spark, str(tmp_path / "c")).collect()) == [("en", "a", "A"), ("en", "b", "B")]
    (tmp_path / "p.yaml").write_text("rules:\n- id: a\n  match: {signal_kind: s}\n  action: x\n  tier: tier1\ndefault: {action: y, tier: tier3}\n")
    assert feeds.policy(str(tmp_path / "p.yaml"))[0][0].signal_kind == "s"


def test_sinks(spark, tmp_path):
    audit = spark.createDataFrame([(1, 1_700_000_000_000), (2, 1_702_000_000_000), (2, 1_702_000_000_000)], "event_id long, event_ts_ms long")
    assert sinks.append_new(audit, str(tmp_path / "a"), "event_id") == 2 and sinks.append_new(audit, str(tmp_path / "a"), "event_id") == 0
    for batch in (0, 1):  # the same rows again are the same part of the same month
        m = sinks.archive(audit, str(tmp_path / "z"), batch).orderBy("year", "month").collect()
        assert [(r["year"], r["month"], r["n"]) for r in m] == [(2023, 11, 1), (2023, 12, 2)]
    assert sinks.archived(spark, str(tmp_path / "z")).count() == 3
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, x int")
    sinks.upsert_latest(rows(("a", 1, 1), ("b", 1, 2)), str(tmp_path / "u"), ["k"], "v", 0)
    for _ in range(2):  # a batch that is repeated changes nothing
        sinks.upsert_latest(rows(("a", 2, 3), ("b", 0, 9)), str(tmp_path / "u"), ["k"], "v", 1)
    assert sorted((r["k"], r["x"]) for r in sinks.latest(spark, str(tmp_path / "u")).collect()) == [("a", 3), ("b", 2)]


def write_parts(df, path, n=3, order=("ts_ms", "event_id")):
    rows = df.orderBy(*order).collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def drained(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_streams_equal_batch(spark, small, tmp_path):
    momo = Views(spark, small).momo.select("event_id", "sender_wallet", "ts_ms").orderBy("ts_ms").limit(150)
    momo = spark.createDataFrame(momo.collect(), momo.schema)
    write_parts(momo, str(tmp_path / "m"))
    src = lambda: jobs.file_source(spark, str(tmp_path / "m"), momo.schema)
    got = {r["event_id"] for r in drained(jobs.suppress(src(), "sender_wallet", 3 * features.DAY), "s2", tmp_path).collect()}
    assert got == {r["event_id"] for r in features.suppressed(momo, "sender_wallet", "ts_ms", "event_id", 3 * features.DAY).where("emitted").collect()}
    twice = jobs.deduplicated(src().withColumn("event_id", F.expr("event_id")))
    assert drained(twice, "s3", tmp_path).count() == 150


def test_otp_stream(spark, tmp_path):
    calls = spark.createDataFrame([(1, "A", "B", "call_start", 0), (2, "X", "B", "call_end", 500_000), (3, "A", "C", "call_start", 0)], "event_id long, caller string, callee string, kind string, ts_ms long")
    texts = spark.createDataFrame([(10, "B", 60_000), (11, "B", 600_000), (12, "C", 950_000), (13, "C", 900_000)], "event_id long, recipient string, ts_ms long")
    write_parts(calls, str(tmp_path / "c"), 1)
    write_parts(texts, str(tmp_path / "t"), 1)
    out = jobs.otp_during_call(jobs.file_source(spark, str(tmp_path / "c"), calls.schema), jobs.file_source(spark, str(tmp_path / "t"), texts.schema))
    got = {(r["sms_id"], r["caller"], r["age_s"]) for r in drained(out, "s4", tmp_path).collect()}
    assert got == {(r["sms_id"], r["caller"], r["age_s"]) for r in during_call(calls, texts).collect()} == {(10, "A", 60), (13, "A", 900)}


def test_bad_json_goes_to_dead_letters(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("nope",)], "value string")
    good, dead = jobs.parse_json(raw, "a int")
    assert [r["a"] for r in good.collect()] == [1] and [r["reason"] for r in dead.collect()] == ["decode"]
