"""The sliding features of a stream, replayed out of order, against the batch."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.operators import features
from tidewatch.sources.views import Views
from tidewatch.streaming import sliding

DELAY_MS = 3 * features.DAY


@pytest.fixture()
def rocksdb(spark):
    sliding.use_rocksdb(spark)
    yield spark
    spark.conf.unset(sliding.PROVIDER)


def replayed(spark, df, path, flush, parts=3):
    """df as files whose events come up to DELAY_MS late, with `flush` at the end; as a stream."""
    r, schema = random.Random(5), StructType([StructField(f.name, f.dataType) for f in df.schema])
    rows = sorted(df.collect(), key=lambda x: x["ts_ms"] + r.randrange(DELAY_MS))
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
    if flush:
        spark.createDataFrame([tuple(flush.get(c) for c in df.columns)], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return stream.sparkSession.table(name), q.lastProgress["stateOperators"][0]


def some(df, column, n):
    """The rows of a few keys, at most of one in four of their events."""
    return df.where(F.substring(column, 2, 9).cast("int") < n)


def test_wallets_equal_batch(rocksdb, small, tmp_path):
    momo = some(Views(rocksdb, small).momo, "sender_wallet", 12)
    end = momo.agg(F.max("ts_ms")).first()[0] + 90 * features.DAY
    src = replayed(rocksdb, momo, str(tmp_path / "m"), {"event_id": -1, "ts_ms": end, "sender_wallet": "flush", "kind": "p2p_transfer", "amount_minor": 1})
    got, state = drained(sliding.wallet_stream(src, "3 days", 24), "sl_wallet", tmp_path)
    want = features.wallet_features(momo, 24)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert state["numRowsDroppedByWatermark"] == 0 and state["numRowsTotal"] <= 4  # all that is left is the last event, which waits


def test_numbers_equal_batch(rocksdb, small, tmp_path):
    v = Views(rocksdb, small)
    voice, sms, data = some(v.voice, "caller", 12), some(v.sms, "sender", 12), some(v.data, "msisdn", 12)
    end = features.number_events(voice, sms, data).agg(F.max("ts_ms")).first()[0] + 900 * features.DAY
    flush = {"event_id": -1, "ts_ms": end, "caller": "flush", "callee": "x", "kind": "call_start"}
    bad = F.col("domain").like("%.net")
    streams = [replayed(rocksdb, df, str(tmp_path / n), f) for n, df, f in (("v", voice, flush), ("s", sms, None), ("d", data, None))]
    got, state = drained(sliding.number_stream(*streams, "400 days", 24, bad), "sl_number", tmp_path)
    want = features.number_features(features.number_events(voice, sms, data), 24, bad)
    key = lambda df: sorted((tuple(map(str, r)) for r in df.select(want.columns).collect()))
    assert key(got) == key(want) and want.count() > 30
    assert {c for c in features.NUMBER if want.select(c).distinct().count() > 1} >= {"velocity_1h", "fanout_1h", "sms_freq_1h", "dns_query_rate_1h", "data_volume_baseline_bytes"}


def test_needs_rocksdb(spark, tmp_path):
    src = spark.readStream.schema("key string, ts_ms long, v long").parquet(str(tmp_path))
    with pytest.raises(ValueError, match="use_rocksdb"):
        sliding.slide_stream(src, "key", [sliding.Slide("n", "count", "v", 5)], [])
