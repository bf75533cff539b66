"""Event-time sliding features of numbers and wallets, and the stream operators they rest on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidewatch.operators.sliding import Slide, slide

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
LATENESS = 30_000
LONG = 7 * 24  # hours from which a frame is a long one


def frame(key: str, width: int, closed: bool = True, ts: str = "ts_ms"):
    """The last `width` ms of a key up to each event; a closed frame holds the boundary."""
    return Window.partitionBy(key).orderBy(ts).rangeBetween(-width if closed else 1 - width, 0)


def late_events(events: DataFrame, key: str, arrival: str, lateness: int = LATENESS) -> DataFrame:
    """events with late: more than `lateness` ms behind the highest event time that arrived for its key before it."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(F.max("ts_ms").over(before) - F.col("ts_ms") > lateness, F.lit(False)))


def first_of_each(events: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """The first event of each id: a grouped minimum that is combined before the shuffle."""
    rest = [c for c in events.columns if c not in ids]
    picked = events.groupBy(*ids).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return picked.select(*ids, "first.*").select(*events.columns)


def suppressed(events: DataFrame, key: str, ts: str, order: str, window_ms: int) -> DataFrame:
    """events with emitted: the first of its key, and the first after each silence of window_ms.

    Suppressed events do not extend the silence, so the emitted ones depend on each other in turn. A task reads its keys
    sorted by time and carries only the last key and its last emitted time, so no list of a key's events is held and rows
    with equal ids stay apart. A null time is not emitted; null keys are one key.
    """
    schema = StructType([*events.schema.fields, StructField("emitted", BooleanType(), False)])

    def step(batches):
        own, last = (), None
        for batch in batches:
            out = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(ts).to_pylist()):
                if own != (k,):
                    own, last = (k,), None
                go = t is not None and (last is None or t - last >= window_ms)
                last = t if go else last
                out.append(go)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "emitted"])

    return events.repartition(key).sortWithinPartitions(key, ts, order).mapInArrow(step, schema)


def number_events(voice: DataFrame, sms: DataFrame, data: DataFrame) -> DataFrame:
    """The three streams of a number as one: msisdn, ts_ms, event_id, topic and what the features read."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    call = F.expr("kind = 'call_start' and callee is not null")
    v = voice.select(F.col("caller").alias("msisdn"), "ts_ms", "event_id", F.lit("voice").alias("topic"), call.alias("call"), F.when(call, F.col("callee")).alias("callee"), "imei", null("string", "template_hash"), null("string", "domain"), F.lit(0).cast("long").alias("bytes"))
    s = sms.select(F.col("sender").alias("msisdn"), "ts_ms", "event_id", F.lit("sms").alias("topic"), F.lit(False).alias("call"), null("string", "callee"), null("string", "imei"), "template_hash", null("string", "domain"), F.lit(0).cast("long").alias("bytes"))
    dns = F.when(F.col("kind").isin("dns_query", "dns_response"), F.col("domain"))
    size = F.when(F.col("kind") == "ipdr_session", F.coalesce("bytes_up", F.lit(0)) + F.coalesce("bytes_down", F.lit(0))).otherwise(0).cast("long")
    d = data.where("msisdn is not null").select("msisdn", "ts_ms", "event_id", F.lit("data").alias("topic"), F.lit(False).alias("call"), null("string", "callee"), null("string", "imei"), null("string", "template_hash"), dns.alias("domain"), size.alias("bytes"))
    return v.unionByName(s).unionByName(d)


NUMBER = ("velocity_1m", "velocity_5m", "velocity_1h", "fanout_1h", "imei_count", "sms_freq_1h", "sms_template_top", "dns_query_rate_1h", "suspicious_domain_count_1h", "data_volume_1h_bytes", "data_volume_baseline_bytes", "geo_entropy")
WALLET = ("txn_velocity_1h", "counterparty_diversity_24h", "value_p95_24h")


def number_slides(scale: int = 1) -> list[Slide]:
    """The frames of a number. One-minute, five-minute and fanout frames leave out their boundary; the others hold it."""
    hour = HOUR * scale
    return [
        Slide("velocity_1m", "count", "is_call", MINUTE * scale, False), Slide("velocity_5m", "count", "is_call", 5 * MINUTE * scale, False), Slide("velocity_1h", "count", "is_call", hour),
        Slide("fanout_1h", "distinct", "callee", hour, False), Slide("imei_count", "distinct", "imei", 30 * DAY), Slide("sms_freq_1h", "count", "is_sms", hour), Slide("sms_template_top", "top", "template_hash", hour),
        Slide("dns_query_rate_1h", "count", "domain", hour), Slide("suspicious_domain_count_1h", "count", "is_bad", hour), Slide("data_volume_1h_bytes", "sum", "traffic", hour),
        Slide("data_volume_baseline_bytes", "sum", "traffic", 7 * DAY * scale),
    ]


def wallet_slides(scale: int = 1) -> list[Slide]:
    day = DAY * scale
    return [Slide("txn_velocity_1h", "count", "real_amount", HOUR * scale), Slide("counterparty_diversity_24h", "distinct", "cp_id", day), Slide("value_p95_24h", "p95", "real_amount", day)]


def number_inputs(events: DataFrame, suspicious: Column | None = None) -> DataFrame:
    """number_events with the columns that number_slides reads; null where an event does not count."""
    bad = F.lit(False) if suspicious is None else suspicious
    marks = {"is_call": F.when(F.col("call"), 1), "is_sms": F.when(F.col("topic") == "sms", 1), "is_bad": F.when(F.col("domain").isNotNull() & bad, 1), "traffic": F.nullif("bytes", F.lit(0))}
    return events.withColumns({n: c.cast("long") for n, c in marks.items()})


def wallet_inputs(momo: DataFrame) -> DataFrame:
    """Transactions with their wallet, the sender or else the recipient; reversals count for diversity only."""
    own = momo.withColumns({"wallet_id": F.coalesce("sender_wallet", "recipient_wallet"), "cp_id": F.coalesce("recipient_wallet", "account_hash"), "real_amount": F.when(F.col("kind") != "reversal", F.col("amount_minor").cast("long"))})
    return own.where("wallet_id is not null")


def _slid(events: DataFrame, key: str, slides: list[Slide]) -> DataFrame:
    """Short frames and long ones one after the other, as chunks of a busy key are as long as its frames ask for."""
    for group in ([s for s in slides if s.width < HOUR * LONG], [s for s in slides if s.width >= HOUR * LONG]):
        if group:
            events = slide(events, key, group)
    return events


def number_features(events: DataFrame, scale: int = 1, suspicious: Column | None = None, only: list[str] | tuple = NUMBER) -> DataFrame:
    """Features of a number at each of its events; scale widens all frames but that of devices.

    Null callees, templates and domains do not count. geo_entropy is always 0. The top template's ties go to the one seen
    first in the frame, then to the smaller hash. only: the features to work out.
    """
    slides = [s for s in number_slides(scale) if s.name in only]
    read = {s.column for s in slides}
    own = number_inputs(events, suspicious).select("msisdn", "ts_ms", "event_id", "topic", *sorted(read))
    return finished(_slid(own, "msisdn", slides), only)


def finished(slid: DataFrame, only: list[str] | tuple = NUMBER) -> DataFrame:
    """The features from what the frames of a number give: the baseline as bytes of an hour, geo_entropy as 0."""
    out = slid.withColumn("geo_entropy", F.lit(0.0))
    if "data_volume_baseline_bytes" in only:
        out = out.withColumn("data_volume_baseline_bytes", F.floor(F.col("data_volume_baseline_bytes") / 168))
    return out.select("msisdn", "ts_ms", "event_id", "topic", *[n for n in NUMBER if n in only])


def wallet_features(momo: DataFrame, scale: int = 1, only: list[str] | tuple = WALLET) -> DataFrame:
    """Features of a wallet at each of its transactions.

    The wallet is the sender, else the recipient. Reversals count for diversity only. p95 is the sorted amount at
    max(0, int(n * 0.95) - 1), 0 without amounts. only: the features to work out.
    """
    slides = [s for s in wallet_slides(scale) if s.name in only]
    own = wallet_inputs(momo).select("wallet_id", "ts_ms", "event_id", *sorted({s.column for s in slides}))
    return slide(own, "wallet_id", slides).select("wallet_id", "ts_ms", "event_id", *[n for n in WALLET if n in only])


def final_state(features: DataFrame, key: str, order: tuple[str, ...] = ("ts_ms", "event_id")) -> DataFrame:
    """The features of each key at its last event, by default the latest, of these the one with the largest event_id."""
    rest = [c for c in features.columns if c != key]
    return features.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def anomaly(volume: Column, baseline: Column) -> Column:
    return F.when(baseline <= 0, 0.0).otherwise(volume / baseline)


def first_seen(data: DataFrame, window_days: int = 30) -> DataFrame:
    """Each domain event with the age of its domain on the wire and whether that is at most window_days.

    The first times are a grouping, one row a domain, so a popular domain is combined before the shuffle and its events can
    be split among tasks by the adaptive join.
    """
    own = data.where("domain is not null")
    out = own.join(own.groupBy("domain").agg(F.min("ts_ms").alias("_first")), "domain").select(*own.columns, F.floor((F.col("ts_ms") - F.col("_first")) / 1000).alias("age_s"))
    return out.withColumn("newly_seen", F.col("age_s") <= window_days * 86_400)


def tumble(events: DataFrame, keys: list[str], aggs: list[Column], ts: str = "ts_ms", width: int = HOUR) -> DataFrame:
    """Fixed windows of `width` ms: window_start_ms and keys with aggs. Works the same on a stream's micro-batch."""
    return events.groupBy((F.floor(F.col(ts) / width) * width).cast("long").alias("window_start_ms"), *keys).agg(*aggs)
