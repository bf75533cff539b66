"""Sliding frames with eviction against plain lists of each frame."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features, sliding
from tidewatch.operators.sliding import Frames, Multiset, Slide

SLIDES = [
    Slide("n", "count", "v", 50), Slide("open_n", "count", "v", 50, False), Slide("total", "sum", "v", 200), Slide("different", "distinct", "s", 90), Slide("most", "top", "s", 120),
    Slide("most_now", "top", "s", 5), Slide("p95", "p95", "v", 200),
]
EVENT = "key string, ts_ms long, id long, v long, s string"


def brute(rows):
    """id -> the results of its frames, by looking at every event of the key."""
    out = {}
    for key, ts, i, _, _ in rows:
        got = []
        for x in SLIDES:
            low = ts - x.width + (not x.closed) if ts is not None else None
            own = [] if ts is None else [(t, r[3] if x.column == "v" else r[4]) for r in rows for t in [r[1]] if r[0] == key and t is not None and low <= t <= ts]
            own = [(t, v) for t, v in own if v is not None]
            values = sorted(v for _, v in own)
            if x.kind == "count":
                got.append(len(own))
            elif x.kind == "sum":
                got.append(sum(values))
            elif x.kind == "distinct":
                got.append(len(set(values)))
            elif x.kind == "top":
                got.append(min(((-values.count(v), min(t for t, w in own if w == v), v) for v in set(values)), default=(0, 0, None))[2])
            else:
                got.append(float(values[max(0, len(values) * 95 // 100 - 1)]) if values else 0.0)
        out[i] = tuple(got)
    return out


def events(n, seed, end=3000):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.15 else x
    return [(r.choice(["a", "a", "b", None]), some(r.randrange(-end // 5, end)), i, some(r.randrange(-4, 9)), some(r.choice("pqrs"))) for i in range(n)]


@pytest.mark.parametrize("span", [1, 2, 8])
def test_equals_frames_as_lists(spark, span):
    """Keys are cut in chunks of 200, 400 and 1600 ms; peers, nulls and negative times among the events."""
    rows = events(500, span) + [("c", 7, 900 + i, 1, "p") for i in range(40)]
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    got = {r["id"]: tuple(r[s.name] for s in SLIDES) for r in sliding.slide(df, "key", SLIDES, span=span).collect()}
    assert got == brute(rows)


def test_small_batches_and_empty(spark):
    rows = events(200, 9, 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = sliding.slide(spark.createDataFrame(rows, EVENT), "key", SLIDES)
        assert {r["id"]: tuple(r[s.name] for s in SLIDES) for r in out.collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sliding.slide(spark.createDataFrame([], EVENT), "key", SLIDES).count() == 0


def test_multiset_ranks():
    r, own, want = random.Random(4), Multiset(load=4), []
    for _ in range(3000):
        if want and r.random() < 0.48:
            v = r.choice(want)
            want.remove(v)
            own.remove(v)
        else:
            v = r.randrange(60)
            want.append(v)
            own.add(v)
        want.sort()
        assert own.n == len(want) and all(own.at(i) == want[i] for i in {0, len(want) // 3, len(want) - 1} if want)


def test_busy_key_is_not_quadratic():
    """A million events of one key with a frame of 100,000 of them; lists of frames would be 10^11 steps."""
    r = random.Random(1)
    slides = [Slide("d", "distinct", "v", 100_000), Slide("t", "top", "v", 100_000), Slide("p", "p95", "v", 100_000)]
    frames, values = Frames(slides), [r.randrange(5000) for _ in range(1_000_000)]
    for i, v in enumerate(values):
        frames.add(i, (v, v, v))
        got = frames.at(i)
    own = values[-100_001:]
    assert got[0] == len(set(own)) and got[2] == sorted(own)[100_001 * 95 // 100 - 1]
    counts = Counter(own)
    assert counts[got[1]] == max(counts.values())
    assert len(frames.held[1][1].heap) <= 64 + 4 * 5000  # ranks that no longer hold do not pile up


def test_features_agree_with_window_functions(spark, small):
    """Counts and sums of all frames as Spark's own range frames give them, at event times close together."""
    from tidewatch.sources.views import Views

    v = Views(spark, small)
    ev = features.number_events(v.voice, v.sms, v.data).withColumns({"ts_ms": F.col("ts_ms") % (40 * features.HOUR), "msisdn": F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("msisdn"))})
    got = features.number_features(ev).select("msisdn", "event_id", "topic", "velocity_1m", "velocity_1h", "fanout_1h", "sms_freq_1h", "data_volume_1h_bytes").collect()
    hour, minute = features.frame("msisdn", features.HOUR), features.frame("msisdn", features.MINUTE, False)
    open_hour = features.frame("msisdn", features.HOUR, False)
    want = ev.select(
        "msisdn", "event_id", "topic", F.count(F.when(F.col("call"), 1)).over(minute), F.count(F.when(F.col("call"), 1)).over(hour), F.size(F.collect_set("callee").over(open_hour)),
        F.count(F.when(F.col("topic") == "sms", 1)).over(hour), F.sum("bytes").over(hour),
    ).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and any(r["velocity_1h"] > 3 for r in got)
