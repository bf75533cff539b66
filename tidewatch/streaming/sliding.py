"""The sliding features as a stream: keyed state with event-time timers, the same frames as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewatch.operators import features
from tidewatch.operators.sliding import KINDS, Frames, Slide
from tidewatch.streaming.jobs import with_time

BUCKETS = 16  # parts of a frame that the state keeps apart
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these jobs need, for all queries that the session starts from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


class SlidingState(StatefulProcessor):
    """Features of a key at each of its events, given out once the watermark has passed the event.

    An event waits (list state) until its time is behind the watermark, which a timer tells; then all that belongs in its
    frames has come, whatever the order of arrival, so results are those of the batch. Events in frames are kept in
    buckets of event time (map state by slide and bucket): a step reads them once, changes those at its end and removes
    those behind. Of values that are counted once each, only the last time is kept. A key without events for as long as
    its widest frame has its timer run out and leaves the state.
    """

    def __init__(self, key: str, carried: list[str], slides: list[Slide], schema: StructType):
        """schema: the events' own; whole numbers other than ts_ms come as text, as pandas rounds them where some are null."""
        self.key, self.carried, self.slides, self.schema = key, carried, slides, schema
        self.columns = sorted({s.column for s in slides})
        self.widest = max(s.width for s in slides)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([self.schema[c] for c in ("ts_ms", *self.carried, *self.columns)]))
        self.buckets = handle.getMapState("buckets", "slide int, bucket long", "times array<long>, numbers array<long>, texts array<string>")
        self.seen = handle.getMapState("seen", "slide int, number long, text string", "last long")
        self.done = handle.getValueState("done", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            own = pdf[["ts_ms", *self.carried, *self.columns]].astype(object)
            own = own.where(own.notna(), None)
            for c in own.columns:
                if self.schema[c].dataType == LongType():
                    own[c] = pd.Series([None if v is None else int(v) for v in own[c]], dtype=object, index=own.index)
            if len(own):
                self.waiting.appendList(list(own.itertuples(index=False, name=None)))
                low = int(own["ts_ms"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in rows if r[0] <= now), key=lambda r: r[0])
        rest = [tuple(r) for r in rows if r[0] > now]
        if due:
            yield self._step(key, due)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        elif not rows and self.done.exists() and self.done.get()[0] + self.widest < now:
            for state in (self.waiting, self.buckets, self.seen, self.done):
                state.clear()

    def _value(self, slide: Slide, number, text):
        return text if self.schema[slide.column].dataType == StringType() else number

    def _step(self, key, due: list[tuple]) -> pd.DataFrame:
        """Take the due events through the frames, in order of time, and leave the state as it is after them."""
        frames, first, end = Frames(self.slides), due[0][0], due[-1][0]
        spans = [max(1, s.width // BUCKETS) for s in self.slides]
        held = {tuple(k): [list(x or []) for x in v] for k, v in self.buckets.iterator()}
        last = {tuple(k): v[0] for k, v in self.seen.iterator()}
        old: dict[int, list] = {i: [] for i in range(len(self.slides))}
        for (i, _), (times, numbers, texts) in held.items():
            old[i] += [(t, self._value(self.slides[i], *v)) for t, *v in zip(times, numbers or [None] * len(times), texts or [None] * len(times))]
        for (i, *value), t in last.items():
            old[i].append((t, self._value(self.slides[i], *value)))
        for i, own in old.items():
            for t, v in sorted(own, key=lambda x: x[0]):
                frames.put(i, t, v)
        at = 1 + len(self.carried)
        place = [at + self.columns.index(s.column) for s in self.slides]
        results, new, changed = [], set(), set()
        for n, r in enumerate(due):
            for i, s in enumerate(self.slides):
                v = r[place[i]]
                if v is None:
                    continue
                frames.put(i, r[0], v)
                text = isinstance(v, str)
                if s.kind == "distinct":
                    k = (i, None if text else int(v), v if text else None)
                    last[k] = r[0]
                    new.add(k)
                elif r[0] >= end - s.width:
                    own = held.setdefault((i, r[0] // spans[i]), [[], [], []])
                    own[0].append(r[0])
                    own[2 if text else 1].append(v if text else int(v))
                    changed.add((i, r[0] // spans[i]))
            if n + 1 == len(due) or due[n + 1][0] != r[0]:
                now = frames.at(r[0])
                results += [now] * (n + 1 - len(results))
        for k, (times, numbers, texts) in held.items():
            if (k[1] + 1) * spans[k[0]] <= end - self.slides[k[0]].width:
                self.buckets.removeKey(k)
            elif k in changed:
                self.buckets.updateValue(k, (times, numbers, texts))
        for k, t in last.items():
            if t < end - self.slides[k[0]].width:
                self.seen.removeKey(k)
            elif k in new:
                self.seen.updateValue(k, (t,))
        before = self.done.get()[0] if self.done.exists() else None
        if before is not None:
            self.handle.deleteTimer(before + self.widest + 1)
        self.done.update((end,))
        self.handle.registerTimer(end + self.widest + 1)
        out = pd.DataFrame([(key[0], *r[:at], *x) for r, x in zip(due, results)], columns=[self.key, "ts_ms", *self.carried, *[s.name for s in self.slides]])
        return out.astype({s.name: "int64" for s in self.slides if KINDS[s.kind][1] == LongType()})

    def close(self) -> None:
        pass


def slide_stream(events: DataFrame, key: str, slides: list[Slide], carried: list[str]) -> DataFrame:
    """key, ts_ms, carried and a column for each Slide, at each event that the watermark has passed.

    events: a stream with event_time, a watermark on it, and ts_ms, from which it was made. Events that come behind the
    watermark are dropped and counted by Spark. Use use_rocksdb before the query starts.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}: call use_rocksdb")
    columns = sorted({s.column for s in slides})
    events = events.select(key, F.col("ts_ms").cast("long").alias("ts_ms"), "event_time", *carried, *columns)
    out = StructType([events.schema[c] for c in (key, "ts_ms", *carried)] + [StructField(s.name, KINDS[s.kind][1]) for s in slides])
    plain = {c: F.col(c).cast("string") for c in (*carried, *columns) if events.schema[c].dataType == LongType()}
    return events.withColumns(plain).groupBy(key).transformWithStateInPandas(SlidingState(key, carried, slides, events.schema), out, "Append", "EventTime")


def number_stream(voice: DataFrame, sms: DataFrame, data: DataFrame, delay: str = "30 seconds", scale: int = 1, suspicious: Column | None = None) -> DataFrame:
    """number_features of three streams that have no watermark of their own yet; events without time or number are left out."""
    own = features.number_inputs(features.number_events(voice, sms, data), suspicious).where("msisdn is not null and ts_ms is not null")
    out = slide_stream(with_time(own, delay), "msisdn", features.number_slides(scale), ["event_id", "topic"])
    return features.finished(out)


def wallet_stream(momo: DataFrame, delay: str = "30 seconds", scale: int = 1) -> DataFrame:
    """wallet_features of a stream that has no watermark of its own yet; events without time are left out."""
    own = with_time(features.wallet_inputs(momo).where("ts_ms is not null"), delay)
    return slide_stream(own, "wallet_id", features.wallet_slides(scale), ["event_id"])
