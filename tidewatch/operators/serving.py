"""Serving and compliance: alerts, tenants, intelligence, audit and regulator roll-ups as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a totally ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def alert_list(alerts: DataFrame, tenant_id: str, statuses: list[str] | None = None, severities: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A tenant's alerts, newest first; each filter stands on a raw column, so it reaches the scan."""
    own = alerts.where(F.col("tenant_id") == tenant_id)
    if statuses:
        own = own.where(F.col("status").isin(statuses))
    if severities:
        own = own.where(F.col("severity").isin(severities))
    return page(own, [F.desc("created_ms"), F.desc("id")], limit, offset)


def newest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def dashboard(alerts: DataFrame, now_ms: int, keys: list[str]) -> DataFrame:
    """Counts of a tenant's alerts by state in one pass."""
    day = F.col("created_ms") >= now_ms - 86_400_000 * 30
    c = F.count_if
    return alerts.groupBy(*keys).agg(
        F.count("*").alias("total"), c(F.col("status") == "new").alias("open"), c(F.col("status") == "claimed").alias("claimed"), c(F.col("status") == "closed").alias("closed"),
        c(F.col("severity") == "critical").alias("critical"), c((F.col("severity") == "critical") & (F.col("status") == "new")).alias("critical_open"), c(day).alias("recent"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def upsert_intel(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by (kind, identifier): the greater score, hits added, the latest time to live, later metadata over earlier.

    Metadata goes by its keys: of each, the value at the latest last_ms (ties: the greater value), so what a task holds for
    an identifier grows with its different keys, not with its entries. Null maps count as empty.
    """
    both = old.unionByName(new)
    ids = ["kind", "identifier"]
    named = both.select(*ids, "last_ms", F.explode("metadata").alias("name", "value"))
    named = named.groupBy(*ids, "name").agg(F.max_by(F.struct("value"), F.struct("last_ms", "value")).alias("x"))
    merged = named.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "x.value")))).alias("_own"))
    out = both.groupBy(*ids).agg(F.max("risk_score").alias("risk_score"), F.sum("hit_count").alias("hit_count"), F.max("last_ms").alias("last_ms"), F.max("expires_ms").alias("expires_ms"))
    out, merged = out.alias("o"), merged.alias("m")
    same = F.col("o.kind").eqNullSafe(F.col("m.kind")) & F.col("o.identifier").eqNullSafe(F.col("m.identifier"))
    return out.join(merged, same, "left").select("o.*", F.coalesce("m._own", F.expr("cast(map() as map<string, string>)")).alias("metadata"))


def sweep(entries: DataFrame, now_ms: int) -> DataFrame:
    """active is false for what has expired."""
    return entries.withColumn("active", F.col("expires_ms") > now_ms)


def replace_source(current: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """A watchlist in which the active entries of a source are the fresh ones; old ones stay, not active."""
    old = current.withColumn("active", F.col("active") & (F.col("source") != source))
    return old.unionByName(fresh.withColumns({"source": F.lit(source), "active": F.lit(True)}))


# States of a takedown and where they lead.
TRANSITIONS = {"proposed": ["approved", "rejected"], "approved": ["executing", "rejected"], "executing": ["done", "failed"], "failed": ["executing"], "done": [], "rejected": []}


def transition(rows: DataFrame, wanted: str = "wanted", state: str = "state") -> DataFrame:
    """rows with applied and the state after a change that is only made where it is allowed."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]).cast("array<string>"))])
    ok = F.coalesce(F.array_contains(F.try_element_at(table, F.col(state)), F.col(wanted)), F.lit(False))
    return rows.withColumns({"applied": ok, state: F.when(ok, F.col(wanted)).otherwise(F.col(state))})


def short_subject(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.left(F.sha2(F.concat_ws("|", kind, value), 256), F.lit(8)))


# Prompt tokens by kind.
PREFIX = {"number": "NUM_", "wallet": "WAL_", "device": "DEV_", "account": "ACC_"}


def prompt_token(kind: Column, value: Column) -> Column:
    return F.concat(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), kind), F.left(F.sha2(value, 256), F.lit(8)))


def translate(requests: DataFrame, catalogue: DataFrame, fallback: str = "en") -> DataFrame:
    """requests (key, locale) with text: of the locale, else of its language, else of the fallback, else the key.

    The catalogue is small; three left joins on (locale, key) let Spark pick broadcasts by its size.
    """
    own = requests.withColumn("language", F.substring_index(F.regexp_replace("locale", "_", "-"), "-", 1))
    for name, loc in (("exact", F.col("locale")), ("base", F.col("language")), ("last", F.lit(fallback))):
        c = catalogue.select(F.col("locale").alias(f"l_{name}"), F.col("key").alias(f"k_{name}"), F.col("template").alias(f"t_{name}"))
        own = own.join(c, (loc == F.col(f"l_{name}")) & (F.col("key") == F.col(f"k_{name}")), "left")
    return own.withColumn("text", F.coalesce("t_exact", "t_base", "t_last", "key")).select(*requests.columns, "text")


# Which signals become which intelligence, and for how many days.
INTEL = {
    "suspect_number": ["voice.velocity_burst", "sms.bulk_template", "device.imei_churn", "momo.mule_velocity", "momo.high_value_velocity", "aml.watchlist_match"],
    "scam_template": ["sms.template_smishing", "sms.known_bad_template", "sms.known_bad_body", "sms.malicious_url"],
    "spoof_indicator": ["cli.spoof_validation_failed"],
    "agent_risk": ["agent.commission_farming", "agent.split_txn", "agent.collusion", "agent.float_manipulation", "agent.phantom_customer"],
}
INTEL_DAYS = {"suspect_number": 30, "scam_template": 90, "spoof_indicator": 30, "agent_risk": 60}


def intel_from_signals(signals: DataFrame) -> DataFrame:
    """signal rows (signal_kind, subject_id, score, ts_ms, evidence map) as intelligence entries; others are left out."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for k, v in INTEL.items() for s in v for x in (s, k)]), F.col("signal_kind"))
    look = lambda *names: F.coalesce(*[F.try_element_at(F.col("evidence"), F.lit(n)) for n in names])
    ident = F.when(kind == "scam_template", F.when(F.col("signal_kind") == "sms.malicious_url", look("url_hash", "domain")).otherwise(look("template_hash", "body_hash"))).otherwise(F.col("subject_id"))
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in INTEL_DAYS.items() for x in kv]), F.col("kind")).cast("long")
    out = signals.withColumns({"kind": kind, "identifier": ident}).where("kind is not null and identifier is not null")
    return out.select("kind", "identifier", F.col("score").alias("risk_score"), F.lit(1).cast("long").alias("hit_count"), F.col("ts_ms").alias("last_ms"), (F.col("ts_ms") + days * 86_400_000).cast("long").alias("expires_ms"), F.create_map(F.lit("last_signal"), F.col("signal_kind")).alias("metadata"))


def verified_discount(scored: DataFrame, businesses: DataFrame, exempt: list[str]) -> DataFrame:
    """Scores of verified businesses for the exempt kinds: a tenth, without a signal, low."""
    known = businesses.where("verified").select(F.col("msisdn").alias("b_msisdn")).distinct()
    own = scored.join(known, F.col("msisdn") == F.col("b_msisdn"), "left")
    hit = F.col("b_msisdn").isNotNull() & F.coalesce(F.col("signal_kind").isin(exempt), F.lit(False))
    return own.withColumns({"score": F.when(hit, F.round(F.col("score") * 0.1, 6)).otherwise(F.col("score")), "signal_kind": F.when(~hit, F.col("signal_kind")), "severity": F.when(hit, "low").otherwise(F.col("severity")), "verified": hit}).drop("b_msisdn")


def report(alerts: DataFrame, where: Column, first: int) -> DataFrame:
    """A regulator's counts by severity, with the ids of the first incidents."""
    own = alerts.where(where)
    counts = own.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "closed").alias("confirmed"), F.round(F.avg("score"), 6).alias("mean_score"))
    top = newest(own, "severity", [F.desc("score"), F.asc("id")], first).groupBy("severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")), ",").alias("incidents"))
    return counts.join(top, "severity")
