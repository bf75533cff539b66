"""Structured Streaming jobs. What is stateless or windowed reuses the batch functions; keyed state stands here and, for sliding features, in sliding.py."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.features import LATENESS
from tidewatch.sources.sinks import upsert_latest


def file_source(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream with event_time; a message bus is the same with another format and options."""
    return with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path))


def with_time(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)


def parse_json(raw: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of JSON records; a record that does not parse keeps its bytes as base64."""
    own = raw.withColumn("x", F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = own.where("x is not null and x._bad is null").select("x.*").drop("_bad")
    return good, own.where("x is null or x._bad is not null").select(F.base64(F.col(column).cast("binary")).alias("value"), F.lit("decode").alias("reason"))


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first event of each id within the watermark; state is dropped behind it."""
    return events.dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, keys: list[str], aggs: list) -> DataFrame:
    """Tumbling hours; distinct counts are approximate here, exact in batch."""
    own = events.groupBy(F.window("event_time", "1 hour"), *keys).agg(*aggs)
    return own.select((F.unix_millis("window.start")).alias("window_start_ms"), *keys, *[c for c in own.columns if c not in ("window", *keys)])


def suppress(events: DataFrame, key: str, window_ms: int) -> DataFrame:
    """key, event_id, ts_ms of events that are not silenced: the first, and the first window_ms after the last let through.

    The state of a key goes when the key has been idle for window_ms and the lateness on the clock; a replay runs faster
    than its events, so it keeps state longer, never shorter. After an outage of that length an event that should be
    silenced may be let through. No event is dropped as late.
    """

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"], kind="stable")
        out = []
        for t, e in zip(rows["ts_ms"].tolist(), rows["event_id"].tolist()):
            if last is None or t - last >= window_ms:
                last = t
                out.append((k[0], e, t))
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(window_ms + LATENESS)
        yield pd.DataFrame(out, columns=[key, "event_id", "ts_ms"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, event_id long, ts_ms long", "last long", "append", "ProcessingTimeTimeout")


def otp_during_call(calls: DataFrame, texts: DataFrame, ttl_ms: int = 900_000) -> DataFrame:
    """sms_id, number, caller, age_s: messages while a call to the number is open. The latest start wins, any end closes.

    An end takes the call out of the state; one whose end is lost goes when its number has been idle for ttl_ms and the
    lateness on the clock, as in suppress. No event is dropped as late.
    """
    null = F.lit(None)
    c = calls.select(F.col("callee").alias("number"), "ts_ms", F.lit(0).alias("side"), "event_id", "kind", "caller", "event_time")
    t = texts.select(F.col("recipient").alias("number"), "ts_ms", F.lit(1).alias("side"), "event_id", null.cast("string").alias("kind"), null.cast("string").alias("caller"), "event_time")

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        kind, caller, since = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "side", "event_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.side == 0:
                kind, caller, since = r.kind, r.caller, int(r.ts_ms)
            elif kind == "call_start" and r.ts_ms - since <= ttl_ms:
                out.append((int(r.event_id), k[0], caller, int(r.ts_ms - since) // 1000))
        if kind == "call_start":
            state.update((kind, caller, since))
            state.setTimeoutDuration(ttl_ms + LATENESS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["sms_id", "number", "caller", "age_s"])

    return c.unionByName(t).groupBy("number").applyInPandasWithState(step, "sms_id long, number string, caller string, age_s long", "kind string, caller string, since long", "append", "ProcessingTimeTimeout")


def upsert_stream(events: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, keys: list[str], version: str, checkpoint: str):
    """Apply a batch function to each micro-batch and keep the latest row of each key."""
    return events.writeStream.foreachBatch(lambda df, i: upsert_latest(transform(df), path, keys, version, i)).option("checkpointLocation", checkpoint).outputMode("append")


def lag(query) -> dict[str, int]:
    """Rows and time of the last micro-batch, and events dropped behind the watermark."""
    p = query.lastProgress or {}
    dropped = sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in p.get("stateOperators", []))
    return {"rows": int(p.get("numInputRows", 0)), "ms": int(p.get("durationMs", {}).get("triggerExecution", 0)), "dropped": dropped}
