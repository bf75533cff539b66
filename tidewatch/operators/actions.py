"""What is done about decisions: action records, customer alerts with their text, counts of what was blocked; URL verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.content import domain_of, suffixes
from tidewatch.operators.serving import translate

# The message that each alert shows, and what counts as blocking.
ALERT_TEMPLATES = {
    "customer.alert_smishing": "spam_sms_warning", "customer.alert_spam_call": "spam_call_warning", "customer.alert_otp_fraud": "otp_fraud_warning",
    "customer.alert_url_blocked": "url_blocked", "customer.alert_fraud": "fraud_alert",
}
ALERT_DEFAULT = "fraud_alert"
BLOCKING = ("volte_tag", "url_block", "momo_friction")
URL_CONFIDENCE, BELOW = 0.95, 0.9


def action_taken(decisions: DataFrame, source: str, policy_version: str, outcome: Column, error: Column | None = None) -> DataFrame:
    """A record for each decision that was acted on (decision_id, action, subject_kind, subject_id): what came of it.

    event_id follows from the decision, so an action that is reported again is the same event. A decision without id gives none.
    """
    meta = F.create_map(F.lit("policy_version"), F.lit(policy_version), F.lit("subject_kind"), F.col("subject_kind"), F.lit("subject_id"), F.col("subject_id"))
    none = F.lit(None).cast("string")
    own = decisions.where("decision_id is not null").withColumns({"outcome": outcome, "error": none if error is None else error})
    return own.select(
        F.concat(F.lit("act_"), F.substring("decision_id", 1, 24)).alias("event_id"), F.lit(source).alias("source"), "decision_id", "action", "outcome",
        F.when(F.col("outcome") == "failed", F.coalesce("error", F.lit("unknown"))).alias("error"), meta.alias("metadata"),
    )


def alert_payloads(decisions: DataFrame, catalogue: DataFrame, locales: DataFrame, fallback: str = "en") -> tuple[DataFrame, DataFrame]:
    """(payloads, failures) of customer alerts: who, what kind, in which language, with the text of the message.

    decisions: decision_id, action, severity, subject_kind, subject_id, protection_mode. locales: msisdn, locale, once each.
    Unknown kinds show the general warning, numbers without locale get the fallback; subjects that are no number fail.
    """
    good, bad = decisions.where("subject_kind = 'number'"), decisions.where("subject_kind is null or subject_kind <> 'number'")
    keys = F.create_map(*[F.lit(x) for kv in ALERT_TEMPLATES.items() for x in kv])
    own = good.join(locales, F.col("subject_id") == F.col("msisdn"), "left").drop("msisdn").withColumns({"locale": F.coalesce("locale", F.lit(fallback)), "key": F.coalesce(F.try_element_at(keys, F.col("action")), F.lit(ALERT_DEFAULT))})
    out = translate(own, catalogue, fallback)
    out = out.select(F.col("subject_id").alias("msisdn"), F.col("action").alias("alert_kind"), "decision_id", "severity", "locale", F.col("key").alias("template_key"), F.col("text").alias("body"), F.coalesce("protection_mode", F.lit("passive")).alias("protection_mode"))
    return out, bad.select("decision_id", F.lit("not a number subject").alias("error"))


def blocked_recently(actions: DataFrame, subscribers: DataFrame, now_ms: int, within_ms: int = 86_400_000, kinds: tuple[str, ...] = BLOCKING) -> DataFrame:
    """tenant_id, blocked: blocking actions on a tenant's subscribers (kind, id) in the last within_ms, 0 for tenants without.

    actions: action_kind, subject_kind, subject_id, taken_ms. They are counted by subject before they meet the subscribers.
    """
    recent = actions.where(F.col("action_kind").isin(list(kinds)) & (F.col("taken_ms") > now_ms - within_ms) & (F.col("taken_ms") <= now_ms))
    own = recent.groupBy(F.col("subject_kind").alias("kind"), F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    return subscribers.join(own, ["kind", "id"], "left").groupBy("tenant_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocked"))


def url_verdicts(urls: DataFrame, flagged_urls: DataFrame, flagged_domains: DataFrame, confidence: float = URL_CONFIDENCE) -> DataFrame:
    """urls (url) with confidence, category, source and matched: the whole URL, else its host, else a domain above the host.

    flagged_urls: url, category, source; flagged_domains: domain, category, source; each entry once. Case does not matter. A
    domain above the host counts less; the nearest one is taken. Distinct URLs and hosts meet the lists, not the rows.
    """
    own = urls.select("url").where("url is not null").distinct().withColumn("u", F.lower("url")).withColumn("host", domain_of(F.col("u")))
    whole = flagged_urls.select(F.lower("url").alias("u"), F.struct(F.lit(confidence).alias("confidence"), "category", "source", F.lower("url").alias("matched")).alias("w")).dropDuplicates(["u"])
    own = own.join(whole, "u", "left")
    hosts = own.where("w is null").select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    rated = F.when(F.col("domain") == F.col("host"), confidence).otherwise(confidence * BELOW)
    named = flagged_domains.select(F.lower("domain").alias("domain"), "category", "source").dropDuplicates(["domain"])
    hit = hosts.join(named, "domain").groupBy("host").agg(F.max_by(F.struct(F.round(rated, 6).alias("confidence"), "category", "source", F.col("domain").alias("matched")), F.length("domain")).alias("d"))
    found = own.join(hit, "host", "left").select("url", F.coalesce("w", "d").alias("v"))
    return urls.join(found, "url", "left").select(*urls.columns, "v.*")


def business_of_code(codes: DataFrame, businesses: DataFrame) -> DataFrame:
    """codes (short_code) with the business that holds it, verified or not; codes do not differ by case. Unknown: verified is false."""
    own = businesses.where("short_code is not null").groupBy(F.upper("short_code").alias("_code")).agg(F.min_by(F.struct("name", "verified"), "msisdn").alias("b"), F.count("*").alias("holders"))
    out = codes.join(own, F.upper("short_code") == F.col("_code"), "left")
    return out.select(*codes.columns, F.col("b.name").alias("name"), F.coalesce("b.verified", F.lit(False)).alias("verified"), F.coalesce("holders", F.lit(0)).alias("holders"))
