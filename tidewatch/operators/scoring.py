"""Rule scores of numbers and wallets, their explanation, OTP and content rules, protection and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the rules; the lab set fits sparse events.
LIMITS = {"velocity": 10, "fanout": 50, "imei": 4, "sms": 30, "velocity_5m": 30, "fanout_low": 20, "imei_low": 2, "wallet_velocity": 15, "diversity": 8, "p95": 100_000, "p95_velocity": 8}
LAB_LIMITS = {"velocity": 3, "fanout": 2, "imei": 2, "sms": 3, "velocity_5m": 2, "fanout_low": 2, "imei_low": 2, "wallet_velocity": 3, "diversity": 2, "p95": 15_000, "p95_velocity": 2}


def score_number(features: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """The first rule that holds: velocity burst, device churn (not for verified senders), bulk template; else a low score."""
    x = limits
    rcs = F.coalesce("rcs_verified_recent", F.lit(False)) if "rcs_verified_recent" in features.columns else F.lit(False)
    burst = (F.col("velocity_1m") >= x["velocity"]) & (F.col("fanout_1h") >= x["fanout"])
    churn = (F.col("imei_count") >= x["imei"]) & ~rcs
    bulk = (F.col("sms_freq_1h") >= x["sms"]) & F.col("sms_template_top").isNotNull()
    low = (F.col("velocity_5m") >= x["velocity_5m"]).cast("int") + (F.col("fanout_1h") >= x["fanout_low"]).cast("int") + (F.col("imei_count") >= x["imei_low"]).cast("int")
    return features.withColumns({
        "score": F.round(F.when(burst, 0.92).when(churn, 0.78).when(bulk, 0.85).otherwise(F.least(F.lit(0.99), 0.1 + 0.18 * low)), 6),
        "signal_kind": F.when(burst, "voice.velocity_burst").when(churn, "device.imei_churn").when(bulk, "sms.bulk_template"),
        "severity": F.when(burst, "high").when(churn, "medium").when(bulk, "high").otherwise("low"),
    })


def score_wallet(features: DataFrame, limits: dict = LIMITS) -> DataFrame:
    x = limits
    mule = (F.col("txn_velocity_1h") >= x["wallet_velocity"]) & (F.col("counterparty_diversity_24h") >= x["diversity"])
    high = (F.col("value_p95_24h") >= x["p95"]) & (F.col("txn_velocity_1h") >= x["p95_velocity"])
    return features.withColumns({
        "score": F.when(mule, 0.9).when(high, 0.82).otherwise(0.1), "signal_kind": F.when(mule, "momo.mule_velocity").when(high, "momo.high_value_velocity"),
        "severity": F.when(mule, "high").when(high, "medium").otherwise("low"),
    })


def signals(scored: DataFrame, key: str, kind: str) -> DataFrame:
    """Scored rows with a signal, as records with their suppression key."""
    own = scored.where("signal_kind is not null")
    return own.select(F.lit(kind).alias("subject_kind"), F.col(key).alias("subject_id"), "ts_ms", "event_id", "score", "signal_kind", "severity", F.concat_ws(":", F.lit("T0"), F.lit(kind), key, "signal_kind").alias("suppression_key"))


# What features are like without fraud.
BASELINES = {"vel_1m": 1, "vel_5m": 4, "vel_1h": 30, "fanout_1h": 8, "imei_count": 1, "sms_freq_1h": 5, "txn_velocity_1h": 3, "counterparty_diversity_24h": 4, "value_p95_24h": 20_000, "geo_entropy": 0.4, "inter_call_p95_s": 600}
# The features' own names, where the baselines have shorter ones.
ALIASES = {"velocity_1m": "vel_1m", "velocity_5m": "vel_5m", "velocity_1h": "vel_1h"}


def weight(name: str, value: Column, boosted: Column | None = None) -> Column:
    """How far a feature is from its baseline, within -1 and 1; those a rule looked at count half as much again."""
    base = BASELINES.get(ALIASES.get(name, name))
    own = F.least(F.lit(1.0), F.abs(value.cast("double")) / 100) if base is None else (value.cast("double") - base) / max(abs(base), 1.0)
    if boosted is not None:
        own = own * F.when(boosted, 1.5).otherwise(1.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), own))


def contributions(df: DataFrame, names: list[str], boosts: dict[str, Column] | None = None, top: int = 3) -> Column:
    """The `top` features by absolute weight, ties in the order of names."""
    boosts = boosts or {}
    rows = F.array(*[F.struct((-F.abs(weight(n, F.col(n), boosts.get(n)))).alias("order"), F.lit(i).alias("at"), F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), weight(n, F.col(n), boosts.get(n)).alias("weight")) for i, n in enumerate(names)])
    return F.transform(F.slice(F.array_sort(rows), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["weight"].alias("weight")))


def explanation(kind: Column, top: Column) -> Column:
    """One sentence with the features behind a signal."""
    parts = F.transform(top, lambda x: F.concat(x["feature"], F.lit(" = "), F.format_string("%.0f", x["value"])))
    phrase = F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", "), F.lit(" and "), F.element_at(parts, -1))).otherwise(F.array_join(parts, ""))
    return F.concat(F.coalesce(kind, F.lit("no signal")), F.lit(": "), phrase)


# Words of one-time passwords.
OTP_WORDS = ["otp", "one time password", "one-time password", "verification code", "verification", "verify", "transaction", "authentication", "auth code", "secure code", "pin", "passcode", "do not share", "code is", "your code"]


def detect_otp(body: Column, short_code: Column, banks: list[str]) -> Column:
    """is_otp, confidence, code, n_words: a bank's short code, or a word with a code of 4 to 8 digits, or two words."""
    low = F.lower(F.coalesce(body, F.lit("")))
    n = F.size(F.filter(F.array(*[F.lit(w) for w in OTP_WORDS]), lambda w: F.contains(low, w)))
    code = F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?:^|[^0-9])([0-9]{4,8})(?:[^0-9]|$)", 1), F.lit(""))
    bank, word, has = F.coalesce(F.upper(short_code).isin(banks), F.lit(False)), n > 0, code.isNotNull()
    confidence = F.when(bank & word & has, 0.97).when(bank & (word | has), 0.92).when(bank, 0.85).when(word & has, 0.8).when(n >= 2, 0.55).otherwise(0.0)
    return F.struct((confidence > 0).alias("is_otp"), confidence.alias("confidence"), code.alias("code"), n.alias("n_words"))


# Which actions a subscriber sees without having enrolled.
AUTO_ENROLLED = ["customer.alert_smishing", "customer.alert_spam_call", "customer.alert_otp_fraud", "customer.alert_url_blocked"]
HIGH_ONLY = ["customer.alert_fraud"]
ACTIVE_ONLY = ["customer.do_i_know_you_prompt", "customer.ask_me_first", "momo.review_limit", "safeguard.enroll"]


def allowed(action: Column, mode: Column, severity: Column) -> Column:
    return F.when(mode == "active", True).when(action.isin(AUTO_ENROLLED), True).when(action.isin(HIGH_ONLY), severity.isin("critical", "high")).when(action.isin(ACTIVE_ONLY), False).otherwise(True)


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mann-Whitney with half for ties, from counts by score: one pass, then a window over the distinct scores.

    Counts are added up in two levels (thousandths first), so no task sees more scores than a thousandth holds.
    """
    by = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    by = by.withColumn("bin", F.floor(F.col(score) * 1000))
    from pyspark.sql import Window

    bins = by.groupBy("bin").agg(F.sum("neg").alias("all"))
    below = bins.withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bin", "base")
    own = F.coalesce(F.sum("neg").over(Window.partitionBy("bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = by.withColumn("own", own).join(below, "bin")
    wins = F.sum(F.col("pos") * (F.col("base") + F.col("own") + F.col("neg") / 2))
    return part.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
