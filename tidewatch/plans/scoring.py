"""Queries that score, explain and decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import motifs as m
from tidewatch.operators import policy as p
from tidewatch.operators import scoring as s
from tidewatch.plans.base import query
from tidewatch.plans.features import NUMBERS, WALLETS, H, f, numbers, over
from tidewatch.plans.graph import MOTIFS, motif_union

L = s.LAB_LIMITS
NUM_SCORED = f"""{NUMBERS}, nf as (select msisdn, ts_ms, event_id, topic, count(*) filter (is_call) {over(f.MINUTE * 24, False)} velocity_1m, count(*) filter (is_call) {over(5 * f.MINUTE * 24, False)} velocity_5m,
        count(distinct callee) {over(H, False)} fanout_1h, count(distinct imei) {over(30 * f.DAY)} imei_count, count(*) filter (topic = 'sms') {over(H)} sms_freq_1h, count(template_hash) {over(H)} templates from nums),
    ns as (select *, case when velocity_1m >= {L["velocity"]} and fanout_1h >= {L["fanout"]} then 'voice.velocity_burst' when imei_count >= {L["imei"]} then 'device.imei_churn'
            when sms_freq_1h >= {L["sms"]} and templates > 0 then 'sms.bulk_template' end signal_kind,
        (velocity_5m >= {L["velocity_5m"]})::int + (fanout_1h >= {L["fanout_low"]})::int + (imei_count >= {L["imei_low"]})::int low from nf)"""
WAL_SCORED = f"""{WALLETS}, ws as (select *, case when txn_velocity_1h >= {L["wallet_velocity"]} and counterparty_diversity_24h >= {L["diversity"]} then 'momo.mule_velocity'
        when value_p95_24h >= {L["p95"]} and txn_velocity_1h >= {L["p95_velocity"]} then 'momo.high_value_velocity' end signal_kind from wfeat),
    wsc as (select *, case signal_kind when 'momo.mule_velocity' then 0.9 when 'momo.high_value_velocity' then 0.82 else 0.1 end::double score,
        case signal_kind when 'momo.mule_velocity' then 'high' when 'momo.high_value_velocity' then 'medium' else 'low' end severity from ws)"""


def wallets(v) -> DataFrame:
    return s.score_wallet(f.wallet_features(v.momo, 24), L)


@query("score_number", f"""with {NUM_SCORED} select msisdn, event_id, topic, signal_kind,
    round(case signal_kind when 'voice.velocity_burst' then 0.92 when 'device.imei_churn' then 0.78 when 'sms.bulk_template' then 0.85 else least(0.99, 0.1 + 0.18 * low) end, 6)::double score,
    case signal_kind when 'voice.velocity_burst' then 'high' when 'device.imei_churn' then 'medium' when 'sms.bulk_template' then 'high' else 'low' end severity from ns""")
def score_number(v):
    return s.score_number(numbers(v), L).select("msisdn", "event_id", "topic", "signal_kind", "score", "severity")


@query("score_wallet", f"with {WAL_SCORED} select wallet_id, event_id, score, signal_kind, severity from wsc")
def score_wallet(v):
    return wallets(v).select("wallet_id", "event_id", "score", "signal_kind", "severity")


@query("signals", f"""with {WAL_SCORED} select 'wallet' subject_kind, wallet_id subject_id, ts_ms, event_id, score, signal_kind, severity, 'T0:wallet:' || wallet_id || ':' || signal_kind suppression_key from wsc where signal_kind is not null""")
def signals(v):
    return s.signals(wallets(v), "wallet_id", "wallet")


SIG = f"""{WAL_SCORED}, sg as (select event_id, wallet_id, score, signal_kind, severity, event_id % 11 = 0 verified from wsc where signal_kind is not null),
    dec as (select *, case when verified then 'verified-business-suppress' when signal_kind = 'momo.mule_velocity' and severity in ('critical', 'high') then 'momo-mule-friction-tier1'
        when signal_kind = 'momo.high_value_velocity' then 'momo-high-value-velocity-tier2' else 'default' end rule_id from sg),
    act as (select *, case rule_id when 'momo-mule-friction-tier1' then 'momo.send_with_care' when 'momo-high-value-velocity-tier2' then 'momo.review_limit' else 'investigation.queue' end as action,
        case rule_id when 'momo-mule-friction-tier1' then 'tier1' when 'momo-high-value-velocity-tier2' then 'tier2' else 'tier3' end tier,
        case rule_id when 'momo-mule-friction-tier1' then 3600 when 'momo-high-value-velocity-tier2' then 14400 when 'verified-business-suppress' then 86400 else 0 end window_s from dec)"""


def decided(v) -> DataFrame:
    sig = s.signals(wallets(v), "wallet_id", "wallet")
    sig = sig.withColumn("evidence", F.create_map(F.lit("verified_business"), F.expr("cast(event_id % 11 = 0 as string)")))
    return p.decide(sig, p.signal_predicate)


@query("policy_signals", f"with {SIG} select event_id, wallet_id subject_id, signal_kind, severity, score, rule_id, action, tier, window_s from act")
def policy_signals(v):
    return decided(v).select("event_id", "subject_id", "signal_kind", "severity", "score", "rule_id", "action", "tier", "window_s")


@query("dispatch", f"with {SIG} select event_id, action, tier, topic from act, unnest(['decisions.audit', 'decisions.' || tier]) t(topic)")
def dispatch(v):
    return p.dispatch(decided(v)).select("event_id", "action", "tier", "topic")


@query("policy_motifs", f"""with {MOTIFS} select id, motif, case when up then 'voice-sms-momo-24h-motif-tier1' else 'default' end rule_id, case when up then 'investigation.escalate' else 'investigation.queue' end as action,
    case when up then 'tier1' else 'tier3' end tier, case when up then 3600 else 0 end window_s from (select *, motif = 'voice_sms_momo_24h' and confidence >= 0.7 up from mo)""")
def policy_motifs(v):
    return p.decide(motif_union(v), p.motif_predicate).select("id", "motif", "rule_id", "action", "tier", "window_s")


@query("protection_gate", f"""with {SIG}, g as (select event_id, action, severity, case when event_id % 3 = 0 then 'active' else 'passive' end as mode from act)
    select *, case when mode = 'active' then true when action in ('momo.review_limit', 'customer.do_i_know_you_prompt', 'customer.ask_me_first', 'safeguard.enroll') then false
        when action = 'customer.alert_fraud' then severity in ('critical', 'high') else true end allowed from g""")
def protection_gate(v):
    own = decided(v).select("event_id", "action", "severity", F.expr("if(event_id % 3 = 0, 'active', 'passive')").alias("mode"))
    return own.withColumn("allowed", s.allowed(F.col("action"), F.col("mode"), F.col("severity")))


NAMES = ["txn_velocity_1h", "counterparty_diversity_24h", "value_p95_24h"]


@query("xai_weights", f"""with {WAL_SCORED}, w as (select event_id, unnest([
        {{'pos': 0, 'feature': 'txn_velocity_1h', 'value': txn_velocity_1h::double, 'w': greatest(-1, least(1, (txn_velocity_1h - 3) / 3 * case when signal_kind = 'momo.mule_velocity' then 1.5 else 1 end))}},
        {{'pos': 1, 'feature': 'counterparty_diversity_24h', 'value': counterparty_diversity_24h::double, 'w': greatest(-1, least(1, (counterparty_diversity_24h - 4) / 4))}},
        {{'pos': 2, 'feature': 'value_p95_24h', 'value': value_p95_24h, 'w': greatest(-1, least(1, (value_p95_24h - 20000) / 20000))}}], recursive := true) from wsc)
    select event_id, row_number() over (partition by event_id order by abs(w) desc, pos) rank, feature, value, round(w, 6)::double weight from w""")
def xai_weights(v):
    top = s.contributions(wallets(v), NAMES, {"txn_velocity_1h": F.coalesce(F.col("signal_kind") == "momo.mule_velocity", F.lit(False))})
    out = wallets(v).select("event_id", F.posexplode(top).alias("at", "x"))
    return out.select("event_id", (F.col("at") + 1).cast("long").alias("rank"), "x.feature", "x.value", F.round("x.weight", 6).alias("weight"))


@query("xai_text", f"""with {WAL_SCORED} select event_id, coalesce(signal_kind, 'no signal') || ': ' || concat('txn_velocity_1h = ', txn_velocity_1h, ' and counterparty_diversity_24h = ', counterparty_diversity_24h) explanation from wsc""")
def xai_text(v):
    top = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in NAMES[:2]])
    return wallets(v).select("event_id", s.explanation(F.col("signal_kind"), top).alias("explanation"))


WORDS = ", ".join(f"'{w}'" for w in s.OTP_WORDS)
# Bodies that read like messages: the synthetic texts have no such words.
BODY = "case event_id % 6 when 0 then 'Your verification code is 48213. Do not share' when 1 then 'Use PIN to verify' when 2 then 'Balance 120 GHS' when 3 then 'OTP 9931' else body end"


@query("otp_detect", f"""with b as (select event_id, {BODY} body, short_code from sms), x as (select *, len(list_filter([{WORDS}], lambda w: contains(lower(body), w)))::int n_words,
        nullif(regexp_extract(body, '(?:^|[^0-9])([0-9]{{4,8}})(?:[^0-9]|$)', 1), '') code, coalesce(upper(short_code) = 'BANK', false) bank from b)
    select event_id, code, n_words, (case when bank and n_words > 0 and code is not null then 0.97 when bank and (n_words > 0 or code is not null) then 0.92 when bank then 0.85
        when n_words > 0 and code is not null then 0.8 when n_words >= 2 then 0.55 else 0 end)::double confidence from x""")
def otp_detect(v):
    out = v.sms.select("event_id", s.detect_otp(F.expr(BODY), F.col("short_code"), ["BANK"]).alias("o"))
    return out.select("event_id", "o.code", "o.n_words", "o.confidence")


@query("otp_during_call", """with t as (select event_id sms_id, recipient, ts_ms from sms where kind = 'mt' and short_code = 'BANK'),
    c as (select t.sms_id, t.recipient, arg_max(v.kind, (v.ts_ms, v.event_id)) last_kind, arg_max(v.caller, (v.ts_ms, v.event_id)) caller, max(v.ts_ms) call_ms, t.ts_ms
        from t join voice v on v.callee = t.recipient and v.ts_ms <= t.ts_ms group by t.sms_id, t.recipient, t.ts_ms)
    select sms_id, recipient, caller, (ts_ms - call_ms) // 1000 age_s from c where last_kind = 'call_start' and ts_ms - call_ms <= 24 * 900000""")
def otp_during_call(v):
    return during_call(v.voice, v.sms.where("kind = 'mt' and short_code = 'BANK'"), 24 * 900_000)


def during_call(voice: DataFrame, sms: DataFrame, ttl_ms: int = 900_000) -> DataFrame:
    """Messages to a number whose last voice event, as a callee, is the start of a call no older than ttl_ms.

    As-of by a union and one window: calls and messages of a number meet in one sorted run, with no pairs.
    """
    from pyspark.sql import Window

    null = F.lit(None).cast("long")
    calls = voice.select(F.col("callee").alias("number"), "ts_ms", F.lit(0).alias("side"), "event_id", null.alias("sms_id"), F.struct("kind", "caller", "ts_ms").alias("call"))
    texts = sms.select(F.col("recipient").alias("number"), "ts_ms", F.lit(1).alias("side"), null.alias("event_id"), F.col("event_id").alias("sms_id"), F.lit(None).cast(calls.schema["call"].dataType).alias("call"))
    w = Window.partitionBy("number").orderBy("ts_ms", "side", "event_id", "sms_id").rowsBetween(Window.unboundedPreceding, 0)
    last = calls.unionByName(texts).withColumn("last", F.last("call", ignorenulls=True).over(w)).where("side = 1")
    return last.where(f"last.kind = 'call_start' and ts_ms - last.ts_ms <= {ttl_ms}").select("sms_id", F.col("number").alias("recipient"), "last.caller", F.expr("(ts_ms - last.ts_ms) div 1000").alias("age_s"))


@query("auc", """with x as (select score, (status = 'closed')::int label from alerts), c as (select score, sum(label) pos, sum(1 - label) neg from x group by 1),
    w as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) below from c)
    select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) auc, sum(pos)::bigint positives, sum(neg)::bigint negatives from w""")
def auc(v):
    out = s.auc(v.alerts.select("score", (F.col("status") == "closed").cast("int").alias("label")))
    return out.select(F.round("auc", 6).alias("auc"), "positives", "negatives")
