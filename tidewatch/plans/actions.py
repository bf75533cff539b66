"""Queries over actions, alerts with their text, URL verdicts and short codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import actions as a
from tidewatch.operators import content as c
from tidewatch.operators import policy as p
from tidewatch.plans.base import query
from tidewatch.plans.scoring import SIG, decided

VERSION = p.fingerprint(p.DEFAULT_RULES)
DECISION = "sha256(event_id || '|' || rule_id)"


def decisions(v):
    own = decided(v).withColumn("decision_id", F.sha2(F.concat_ws("|", "event_id", "rule_id"), 256))
    return own.select("event_id", "decision_id", "action", "severity", "subject_kind", "subject_id", "ts_ms")


@query("action_taken", f"""with {SIG} select 'act_' || left({DECISION}, 24) event_id, {DECISION} decision_id, action, case when event_id % 7 = 0 then 'failed' else 'applied' end outcome,
    case when event_id % 7 = 0 then case when event_id % 2 = 0 then 'timeout' else 'unknown' end end error, '{VERSION}|wallet|' || wallet_id metadata from act""")
def action_taken(v):
    outcome, error = F.expr("if(event_id % 7 = 0, 'failed', 'applied')"), F.expr("if(event_id % 2 = 0, 'timeout', null)")
    own = a.action_taken(decisions(v), "action-tier1", VERSION, outcome, error)
    return own.select("event_id", "decision_id", "action", "outcome", "error", F.concat_ws("|", *[F.col("metadata")[k] for k in ("policy_version", "subject_kind", "subject_id")]).alias("metadata"))


CATALOGUE = [
    ("en", "spam_sms_warning", "This message may be a scam"), ("en", "otp_fraud_warning", "Never share your code"), ("en", "fraud_alert", "We saw something odd"), ("tw", "spam_sms_warning", "Nkra yi betumi aye nnaadaa"),
    ("en-GH", "otp_fraud_warning", "Chale, no share your code"),
]
ALERTS = f"""cat(locale, k, t) as (values {", ".join(str(x) for x in CATALOGUE)}), loc as (select distinct on (sender) sender msisdn, (['en-GH', 'tw_GH', 'fr', null])[substr(sender, 2)::int % 4 + 1] locale from sms),
    d as (select event_id decision_id, case when event_id % 10 = 0 then 'wallet' else 'number' end subject_kind, recipient, (['customer.alert_smishing', 'customer.alert_otp_fraud', 'x'])[event_id % 3 + 1] as action,
        case when event_id % 4 = 0 then 'active' end as mode from sms)"""


@query("alert_body", f"""with {ALERTS}, k as (select d.*, coalesce(l.locale, 'en') locale, case action when 'customer.alert_smishing' then 'spam_sms_warning' when 'customer.alert_otp_fraud' then 'otp_fraud_warning' else 'fraud_alert' end key
        from d left join loc l on l.msisdn = d.recipient where subject_kind = 'number')
    select decision_id, recipient msisdn, action as alert_kind, k.locale, key template_key, coalesce(x.t, y.t, z.t, key) body, coalesce(mode, 'passive') protection_mode from k
    left join cat x on x.locale = k.locale and x.k = key left join cat y on y.locale = string_split(replace(k.locale, '_', '-'), '-')[1] and y.k = key left join cat z on z.locale = 'en' and z.k = key""")
def alert_body(v):
    action = F.expr("element_at(array('customer.alert_smishing', 'customer.alert_otp_fraud', 'x'), cast(event_id % 3 + 1 as int))")
    own = v.sms.select(F.col("event_id").alias("decision_id"), action.alias("action"), F.lit("high").alias("severity"), F.expr("if(event_id % 10 = 0, 'wallet', 'number')").alias("subject_kind"), F.col("recipient").alias("subject_id"), F.expr("if(event_id % 4 = 0, 'active', null)").alias("protection_mode"))
    locale = F.expr("element_at(array('en-GH', 'tw_GH', 'fr', null), cast(cast(substr(sender, 2) as int) % 4 + 1 as int))")
    locales = v.sms.select(F.col("sender").alias("msisdn"), locale.alias("locale")).distinct()
    good, _ = a.alert_payloads(own, v.spark.createDataFrame(CATALOGUE, "locale string, key string, template string"), locales)
    return good.drop("severity")


NOW, MONTH = 1_708_500_000_000, 30 * 86_400_000


@query("blocked_recent", f"""with {SIG}, w as (select event_id, ts_ms from wsc), n as (select 'N' || substr(wallet_id, 2) id, count(*) n from act join w using (event_id)
        where action in ('momo.send_with_care', 'momo.review_limit') and ts_ms > {NOW - MONTH} and ts_ms <= {NOW} group by 1)
    select tenant_id, coalesce(sum(n), 0)::bigint blocked from subscribers s left join n on n.id = s.id and s.kind = 'number' group by 1""")
def blocked_recent(v):
    kinds = F.create_map(*[F.lit(x) for x in ("momo.send_with_care", "momo_friction", "momo.review_limit", "momo_friction")])
    acts = decisions(v).select(F.try_element_at(kinds, F.col("action")).alias("action_kind"), F.lit("number").alias("subject_kind"), F.concat(F.lit("N"), F.expr("substr(subject_id, 2)")).alias("subject_id"), F.col("ts_ms").alias("taken_ms"))
    return a.blocked_recently(acts, v.subscribers, NOW, MONTH)


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"


# The lists are parts of the tables by what a list is: every 40th URL, and the registered names of every 40th event's domain.
@query("url_verdict", f"""with fu as (select distinct lower(url) u from pages where page_id % 40 = 3), fd as (select distinct array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') b from data where event_id % 40 = 1),
    p as (select page_id, url, lower(url) u, {HOST} h from pages)
    select page_id, case when u in (select u from fu) then 0.95 when max(length(b)) = length(h) then 0.95 when max(b) is not null then 0.855 end::double confidence,
        case when u in (select u from fu) then 'malware' when max(b) is not null then 'phishing' end category, case when u in (select u from fu) then u else max_by(b, length(b)) end matched
    from p left join fd on h = b or ends_with(h, '.' || b) group by page_id, u, h""")
def url_verdict(v):
    pages = v.table("pages").select("page_id", "url")
    whole = pages.where("page_id % 40 = 3").select("url", F.lit("malware").alias("category"), F.lit("feed").alias("source"))
    names = v.data.where("event_id % 40 = 1").select(c.registrable(F.col("domain")).alias("domain"), F.lit("phishing").alias("category"), F.lit("signals").alias("source")).where("domain is not null").distinct()
    return a.url_verdicts(pages, whole, names).select("page_id", "confidence", "category", "matched")


@query("shortcode_lookup", """with b as (select upper(short_code) code, count(*) holders, arg_min(name, msisdn) as name, arg_min(verified, msisdn) verified from businesses where short_code is not null group by 1)
    select event_id, short_code, b.name, coalesce(b.verified, false) verified, coalesce(holders, 0) holders from sms left join b on upper(short_code) = code""")
def shortcode_lookup(v):
    return a.business_of_code(v.sms.select("event_id", "short_code"), v.businesses)
