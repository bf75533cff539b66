"""Serving, tenant, intelligence and compliance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import scoring
from tidewatch.operators import serving as s
from tidewatch.plans.base import query
from tidewatch.plans.scoring import NUM_SCORED, WAL_SCORED, L, numbers, wallets


NOW = 996_624_000_000  # 2001-08-01, the end of the alerts
MOTIF = "details->>'$.motif'"


def motif():
    return F.get_json_object("details", "$.motif")


@query("alert_list", "select id, subject_id, severity, status, score, created_ms from alerts where tenant_id = 'T1' and status in ('new', 'claimed') and severity in ('critical', 'high') order by created_ms desc, id desc limit 50 offset 25")
def alert_list(v):
    return s.alert_list(v.alerts, "T1", ["new", "claimed"], ["critical", "high"], 50, 25).select("id", "subject_id", "severity", "status", "score", "created_ms")


@query("tenant_alerts", "select a.id, a.subject_id, u.tenant_id, a.severity, a.status from alerts a join subscribers u on u.id = a.subject_id and u.kind = 'number' where u.tenant_id = 'T2'")
def tenant_alerts(v):
    u = v.subscribers.where("tenant_id = 'T2' and kind = 'number'").select(F.col("id").alias("subject_id"), F.col("tenant_id").alias("tenant"))
    return v.alerts.join(u, "subject_id").select("id", "subject_id", F.col("tenant").alias("tenant_id"), "severity", "status")


@query("prior_alerts", "select subject_id, id, created_ms from alerts qualify row_number() over (partition by subject_id order by created_ms desc, id desc) <= 3")
def prior_alerts(v):
    return s.newest(v.alerts, "subject_id", [F.desc("created_ms"), F.desc("id")], 3).select("subject_id", "id", "created_ms")


DASH = """count(*) total, count(*) filter (status = 'new') open, count(*) filter (status = 'claimed') claimed, count(*) filter (status = 'closed') closed, count(*) filter (severity = 'critical') critical,
    count(*) filter (severity = 'critical' and status = 'new') critical_open, count(*) filter (created_ms >= 996624000000 - 86400000 * 30::bigint) recent, round(avg(score), 6) mean_score"""


@query("tenant_dashboard", f"select tenant_id, {DASH} from alerts group by 1")
def tenant_dashboard(v):
    return s.dashboard(v.alerts, NOW, ["tenant_id"])


@query("group_overview", f"select 'all' scope, {DASH}, count(distinct tenant_id) tenants, count(distinct subject_id) subjects from alerts")
def group_overview(v):
    own = s.dashboard(v.alerts, NOW, [])
    more = v.alerts.agg(F.count_distinct("tenant_id").alias("tenants"), F.count_distinct("subject_id").alias("subjects")).withColumn("scope", F.lit("all"))
    return own.withColumn("scope", F.lit("all")).join(more, "scope")


@query("overview_by_opco", """with t as (select distinct tenant_id from subscribers union select 'T9'), a as (select tenant_id, count(*) alerts, count(*) filter (severity = 'critical') critical, max(score) worst from alerts group by 1)
    select t.tenant_id, coalesce(alerts, 0) alerts, coalesce(critical, 0) critical, coalesce(worst, 0) worst from t left join a using (tenant_id)""")
def overview_by_opco(v):
    tenants = v.subscribers.select("tenant_id").unionByName(v.spark.createDataFrame([("T9",)], "tenant_id string")).distinct()
    a = v.alerts.groupBy("tenant_id").agg(F.count("*").alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical"), F.max("score").alias("worst"))
    return tenants.join(a, "tenant_id", "left").select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alerts", "critical", "worst")])


@query("trending_motifs", f"select {MOTIF} motif, count(*) n, count(distinct tenant_id) tenants, max(created_ms) last_ms, round(avg(score), 3) mean_score from alerts where {MOTIF} is not null group by 1 order by n desc, motif limit 50")
def trending_motifs(v):
    return v.alerts.withColumn("motif", motif()).where("motif is not null").groupBy("motif").agg(F.count("*").alias("n"), F.count_distinct("tenant_id").alias("tenants"), F.max("created_ms").alias("last_ms"), F.round(F.avg("score"), 3).alias("mean_score")).orderBy(F.desc("n"), "motif").limit(50)


@query("trending_by_opco", f"select tenant_id, {MOTIF} motif, count(*) n from alerts where {MOTIF} is not null group by 1, 2 order by n desc, tenant_id, motif limit 200")
def trending_by_opco(v):
    return v.alerts.withColumn("motif", motif()).where("motif is not null").groupBy("tenant_id", "motif").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tenant_id", "motif").limit(200)


@query("peer_alerts", "select id, tenant_id from alerts where list_contains(from_json(details->'$.peers', '[\"VARCHAR\"]'), 'P1')")
def peer_alerts(v):
    return v.alerts.where(F.array_contains(F.from_json(F.get_json_object("details", "$.peers"), "array<string>"), "P1")).select("id", "tenant_id")


FLAGS = "fg as (select 'T' || s_nationkey % 5 sender, 'T' || s_suppkey % 5 recipient, s_suppkey id from supplier)"


@query("flag_volume", f"with {FLAGS} select sender, recipient, count(*) n from fg where sender <> recipient group by 1, 2")
def flag_volume(v):
    own = v.table("supplier").select(F.expr("concat('T', s_nationkey % 5)").alias("sender"), F.expr("concat('T', s_suppkey % 5)").alias("recipient"))
    return own.where("sender <> recipient").groupBy("sender", "recipient").agg(F.count("*").alias("n"))


@query("block_share", "select s_suppkey id, peer, sha256('salt|number|N' || s_suppkey) identifier_hash, 0.85::double confidence from supplier, unnest(['P1', 'P2', 'P3']) p(peer)")
def block_share(v):
    own = v.table("supplier").withColumn("peer", F.explode(F.array(F.lit("P1"), F.lit("P2"), F.lit("P3"))))
    return own.select(F.col("s_suppkey").alias("id"), "peer", F.sha2(F.concat_ws("|", F.lit("salt"), F.lit("number"), F.expr("concat('N', s_suppkey)")), 256).alias("identifier_hash"), F.lit(0.85).alias("confidence"))


SIGNALS = f"{WAL_SCORED}, sg as (select wallet_id, event_id, ts_ms, score, signal_kind from wsc where signal_kind is not null)"


def intel(v) -> DataFrame:
    own = wallets(v).where("signal_kind is not null").select(F.col("wallet_id").alias("subject_id"), "ts_ms", "score", "signal_kind", F.create_map(F.lit("domain"), F.lit("x")).alias("evidence"))
    return s.intel_from_signals(own)


@query("intel_populate", f"with {SIGNALS} select 'suspect_number' kind, wallet_id identifier, score risk_score, 1::bigint hit_count, ts_ms last_ms, ts_ms + 30 * 86400000::bigint expires_ms, signal_kind last_signal from sg")
def intel_populate(v):
    return intel(v).withColumn("last_signal", F.col("metadata")["last_signal"]).drop("metadata")


UPSERT = f"{SIGNALS}, up as (select wallet_id identifier, max(score) risk_score, count(*) hit_count, max(ts_ms) last_ms, max(ts_ms) + 30 * 86400000::bigint expires_ms, arg_max(signal_kind, (ts_ms, signal_kind)) last_signal from sg group by 1)"


def upserted(v) -> DataFrame:
    own = intel(v)
    return s.upsert_intel(own.where("last_ms % 2 = 0"), own.where("last_ms % 2 = 1"))


@query("intel_upsert", f"with {UPSERT} select * from up")
def intel_upsert(v):
    return upserted(v).select("identifier", "risk_score", "hit_count", "last_ms", "expires_ms", F.col("metadata")["last_signal"].alias("last_signal"))


@query("intel_page", f"with {UPSERT} select identifier, risk_score, last_ms from up order by risk_score desc, last_ms desc, identifier limit 20 offset 5")
def intel_page(v):
    return s.page(upserted(v), [F.desc("risk_score"), F.desc("last_ms"), F.asc("identifier")], 20, 5).select("identifier", "risk_score", "last_ms")


@query("intel_stats", f"with {UPSERT}, a as (select *, expires_ms > 1708500000000 active from up) select active, count(*) n, count(*) filter (risk_score >= 0.85) high, round(avg(risk_score), 3) mean_risk, max(hit_count) most_hits from a group by 1")
def intel_stats(v):
    return s.sweep(upserted(v), 1_708_500_000_000).groupBy("active").agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") >= 0.85).alias("high"), F.round(F.avg("risk_score"), 3).alias("mean_risk"), F.max("hit_count").alias("most_hits"))


WATCH = """w as (select s_suppkey id, case when s_suppkey % 2 = 0 then 'un' else 'ofac' end source, s_acctbal > 0 active from supplier),
    r as (select id, source, active and source <> 'un' active from w union all select c_custkey, 'un', true from customer)"""


@query("watchlist_stats", f"with {WATCH} select source, count(*) n, count(*) filter (active) active from r group by 1")
def watchlist_stats(v):
    old = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 2 = 0, 'un', 'ofac')").alias("source"), F.expr("s_acctbal > 0").alias("active"))
    new = v.table("customer").select(F.col("c_custkey").alias("id"))
    return s.replace_source(old, new, "un").groupBy("source").agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


@query("business_lookup", "select caller, b.name, coalesce(verified, false) verified from (select distinct caller from voice) v left join businesses b on b.msisdn = v.caller")
def business_lookup(v):
    return v.voice.select("caller").distinct().join(v.businesses, F.col("caller") == F.col("msisdn"), "left").select("caller", "name", F.coalesce("verified", F.lit(False)).alias("verified"))


@query("verified_discount", f"""with {NUM_SCORED}, sc as (select msisdn, event_id, topic, signal_kind, case signal_kind when 'voice.velocity_burst' then 0.92 when 'device.imei_churn' then 0.78 when 'sms.bulk_template' then 0.85 else least(0.99, 0.1 + 0.18 * low) end score from ns),
    j as (select sc.*, msisdn in (select msisdn from businesses where verified) and coalesce(signal_kind in ('voice.velocity_burst', 'sms.bulk_template', 'device.imei_churn'), false) hit from sc)
    select msisdn, event_id, topic, case when not hit then signal_kind end signal_kind, round(case when hit then round(score * 0.1, 6) else score end, 6)::double score, hit verified from j""")
def verified_discount(v):
    own = scoring.score_number(numbers(v), L)
    return s.verified_discount(own, v.businesses, ["voice.velocity_burst", "sms.bulk_template", "device.imei_churn"]).select("msisdn", "event_id", "topic", "signal_kind", "score", "verified")


@query("sms_trust_gate", """with x as (select event_id, recipient, short_code, event_id % 9 = 0 rcs from sms) select event_id, recipient from x where not rcs and (short_code is null or upper(short_code) not in (select upper(short_code) from businesses where verified and short_code is not null))""")
def sms_trust_gate(v):
    known = v.businesses.where("verified and short_code is not null").select(F.upper("short_code").alias("code")).distinct()
    own = v.sms.where("event_id % 9 <> 0")
    return own.join(known, F.upper("short_code") == F.col("code"), "left_anti").select("event_id", "recipient")


@query("business_fp", "select b.name, count(*) alerts, count(*) filter (a.status = 'closed') closed, round(count(*) filter (a.status = 'closed') / count(*), 6) fp_rate from alerts a join businesses b on b.msisdn = a.subject_id where a.created_ms >= 915148800000 group by 1 order by fp_rate desc, b.name")
def business_fp(v):
    own = v.alerts.where("created_ms >= 915148800000").join(v.businesses, F.col("subject_id") == F.col("msisdn"))
    return own.groupBy("name").agg(F.count("*").alias("alerts"), F.count_if(F.col("status") == "closed").alias("closed"), F.round(F.count_if(F.col("status") == "closed") / F.count("*"), 6).alias("fp_rate")).orderBy(F.desc("fp_rate"), "name")


@query("blocked_domains", "select domain, kind, min(ts_ms) first_ms, max(ts_ms) last_ms, count(*) n from data where domain like '%.net' group by 1, 2 order by n desc, domain, kind limit 100")
def blocked_domains(v):
    return v.data.where("domain like '%.net'").groupBy("domain", "kind").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n")).orderBy(F.desc("n"), "domain", "kind").limit(100)


@query("corpus_summary", "select 'severity.' || severity name, count(*) n from alerts group by severity union all select 'status.' || status, count(*) from alerts group by status")
def corpus_summary(v):
    rows = F.explode(F.array(F.concat(F.lit("severity."), "severity"), F.concat(F.lit("status."), "status"))).alias("name")
    return v.alerts.select(rows).groupBy("name").agg(F.count("*").alias("n"))


# What each regulator asks for, and how many incidents it lists.
REGULATORS = {"nca": ("details <> '{}'", 50), "bog": ("score >= 0.5", 30), "csa": ("severity in ('critical', 'high')", 40), "dpc": ("status = 'claimed'", 20), "gfic": ("score >= 0.4 and status = 'closed'", 50)}


def register_report(name: str, where: str, first: int) -> None:
    @query(f"report_{name}", f"""with o as (select * from alerts where {where}), t as (select severity, string_agg(id::varchar, ',' order by rn) incidents from (select *, row_number() over (partition by severity order by score desc, id) rn from o) where rn <= {first} group by 1)
        select severity, count(*) n, count(*) filter (status = 'closed') confirmed, round(avg(score), 6) mean_score, any_value(incidents) incidents from o join t using (severity) group by 1""")
    def run(v):
        return s.report(v.alerts, F.expr(where), first)


for _name, (_where, _first) in REGULATORS.items():
    register_report(_name, _where, _first)


@query("ring_motifs", f"select 'R' || substr(subject_id, 2)::int % 7 ring, {MOTIF} motif, count(*) n from alerts where {MOTIF} is not null group by 1, 2")
def ring_motifs(v):
    return v.alerts.select(F.concat(F.lit("R"), F.substring("subject_id", 2, 30).cast("int") % 7).alias("ring"), motif().alias("motif")).where("motif is not null").groupBy("ring", "motif").agg(F.count("*").alias("n"))


@query("ring_members", "select sender_wallet id, round(avg(amount_minor % 100 / 100), 3) confidence from momo group by 1 order by confidence desc nulls last, id limit 40")
def ring_members(v):
    return v.momo.groupBy(F.col("sender_wallet").alias("id")).agg(F.round(F.avg(F.col("amount_minor") % 100 / 100), 3).alias("confidence")).orderBy(F.desc_nulls_last("confidence"), "id").limit(40)


@query("ring_timeline", """with t as (select 'call' what, ts_ms, caller a, callee b from voice where caller in ('N1', 'N2', 'N3') union select 'sms', ts_ms, sender, recipient from sms where sender in ('N1', 'N2', 'N3')
    union select 'sent', ts_ms, src, dst from sent where src in ('W1', 'W2', 'W3')) select * from t order by ts_ms, what, a, b limit 100""")
def ring_timeline(v):
    calls = v.voice.where("caller in ('N1', 'N2', 'N3')").select(F.lit("call").alias("what"), "ts_ms", F.col("caller").alias("a"), F.col("callee").alias("b"))
    texts = v.sms.where("sender in ('N1', 'N2', 'N3')").select(F.lit("sms").alias("what"), "ts_ms", F.col("sender").alias("a"), F.col("recipient").alias("b"))
    sent = v.sent.where("src in ('W1', 'W2', 'W3')").select(F.lit("sent").alias("what"), "ts_ms", F.col("src").alias("a"), F.col("dst").alias("b"))
    return calls.union(texts).union(sent).distinct().orderBy("ts_ms", "what", "a", "b").limit(100)


@query("evidence_pack", """with n as (select caller id, count(*) calls from voice group by 1), w as (select 'N' || substr(src, 2) id, count(*) sends from sent group by 1), b as (select msisdn id, name from businesses where verified),
    a as (select subject_id id, count(*) alerts from alerts group by 1)
    select n.id, calls, sends, alerts, name business, concat_ws(',', case when sends is null then 'sends' end, case when alerts is null then 'alerts' end, case when name is null then 'business' end) not_available
    from n left join w using (id) left join a using (id) left join b using (id)""")
def evidence_pack(v):
    n = v.voice.groupBy(F.col("caller").alias("id")).agg(F.count("*").alias("calls"))
    w = v.sent.groupBy(F.concat(F.lit("N"), F.substring("src", 2, 30)).alias("id")).agg(F.count("*").alias("sends"))
    a = v.alerts.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("alerts"))
    b = v.businesses.where("verified").select(F.col("msisdn").alias("id"), F.col("name").alias("business"))
    own = n.join(w, "id", "left").join(a, "id", "left").join(b, "id", "left")
    return own.withColumn("not_available", F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in ("sends", "alerts", "business")]))


@query("train_labels", "with r as (select distinct src id from sent where amount_minor > 20000) select wallet, (r.id is not null)::int label from owns left join r on r.id = wallet")
def train_labels(v):
    ring = v.sent.where("amount_minor > 20000").select(F.col("src").alias("wallet"), F.lit(1).alias("label")).distinct()
    return v.owns.select("wallet").join(ring, "wallet", "left").select("wallet", F.coalesce("label", F.lit(0)).alias("label"))


@query("xai_block", f"select id, {MOTIF} motif, len(from_json(details->'$.peers', '[\"VARCHAR\"]'))::int n_peers from alerts")
def xai_block(v):
    return v.alerts.select("id", motif().alias("motif"), F.size(F.from_json(F.get_json_object("details", "$.peers"), "array<string>")).alias("n_peers")).withColumn("n_peers", F.when(F.col("n_peers") >= 0, F.col("n_peers")))


@query("short_subject", "select distinct 'number:' || left(sha256('number|' || caller), 8) subject, 'NUM_' || left(sha256(caller), 8) token from voice")
def short_subject(v):
    return v.voice.select(s.short_subject(F.lit("number"), F.col("caller")).alias("subject"), s.prompt_token(F.lit("number"), F.col("caller")).alias("token")).distinct()


@query("i18n", """with c(locale, k, t) as (values ('en', 'alert', 'Alert {id}'), ('tw', 'alert', 'Kokoboo {id}'), ('en-GH', 'alert', 'Chale {id}'), ('en', 'stop', 'Stop')),
    r as (select event_id, (['en-GH', 'tw_GH', 'fr', 'en'])[event_id % 4 + 1] locale, (['alert', 'stop', 'other'])[event_id % 3 + 1] k from ev)
    select event_id, r.locale, r.k as key, coalesce(a.t, b.t, d.t, r.k) text from r left join c a on a.locale = r.locale and a.k = r.k left join c b on b.locale = string_split(replace(r.locale, '_', '-'), '-')[1] and b.k = r.k left join c d on d.locale = 'en' and d.k = r.k""")
def i18n(v):
    cat = v.spark.createDataFrame([("en", "alert", "Alert {id}"), ("tw", "alert", "Kokoboo {id}"), ("en-GH", "alert", "Chale {id}"), ("en", "stop", "Stop")], "locale string, key string, template string")
    own = v.events.select("event_id", F.expr("element_at(array('en-GH', 'tw_GH', 'fr', 'en'), cast(event_id % 4 + 1 as int))").alias("locale"), F.expr("element_at(array('alert', 'stop', 'other'), cast(event_id % 3 + 1 as int))").alias("key"))
    return s.translate(own, cat)


@query("luhn", "with d as (select event_id, (4000000000 + event_id * 7919)::varchar n from ev), x as (select event_id, n, list_sum(list_transform(range(1, length(n) + 1), lambda i: case when (length(n) - i) % 2 = 1 then (n[i]::int * 2) // 10 + (n[i]::int * 2) % 10 else n[i]::int end)) t from d) select event_id, t % 10 = 0 valid from x")
def luhn(v):
    return v.events.select("event_id", F.expr("luhn_check(cast(4000000000 + event_id * 7919 as string)) as valid"))


@query("takedowns", """with t as (select o_orderkey id, (['proposed', 'approved', 'executing', 'failed', 'done', 'rejected'])[o_orderkey % 6 + 1] state, (['approved', 'executing', 'done', 'rejected', 'failed'])[o_orderkey % 5 + 1] wanted from orders),
    a as (select *, (state, wanted) in (('proposed', 'approved'), ('proposed', 'rejected'), ('approved', 'executing'), ('approved', 'rejected'), ('executing', 'done'), ('executing', 'failed'), ('failed', 'executing')) applied from t)
    select id, wanted, applied, case when applied then wanted else state end state from a""")
def takedowns(v):
    own = v.table("orders").select(F.col("o_orderkey").alias("id"), F.expr("element_at(array('proposed', 'approved', 'executing', 'failed', 'done', 'rejected'), cast(o_orderkey % 6 + 1 as int))").alias("state"), F.expr("element_at(array('approved', 'executing', 'done', 'rejected', 'failed'), cast(o_orderkey % 5 + 1 as int))").alias("wanted"))
    return s.transition(own).select("id", "wanted", "applied", "state")


@query("audit_months", "select year(make_timestamp(created_ms * 1000))::int as year, month(make_timestamp(created_ms * 1000))::int as month, count(*) n, min(id) first_id, max(id) last_id from alerts group by 1, 2")
def audit_months(v):
    own = v.alerts.withColumn("at", F.timestamp_millis("created_ms"))
    return own.groupBy(F.year("at").alias("year"), F.month("at").alias("month")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("audit_range", "select id, subject_id, created_ms from alerts where created_ms >= 978307200000 and created_ms < 980985600000 order by created_ms, id limit 500")
def audit_range(v):
    return v.alerts.where("created_ms >= 978307200000 and created_ms < 980985600000").select("id", "subject_id", "created_ms").orderBy("created_ms", "id").limit(500)


@query("alert_payload", """with d as (select event_id, recipient, (['customer.alert_smishing', 'customer.alert_otp_fraud', 'x'])[event_id % 3 + 1] as action from sms)
    select event_id, recipient, case action when 'customer.alert_smishing' then 'smishing' when 'customer.alert_otp_fraud' then 'otp' else 'default' end template, recipient like 'N%' ok from d""")
def alert_payload(v):
    action = F.expr("element_at(array('customer.alert_smishing', 'customer.alert_otp_fraud', 'x'), cast(event_id % 3 + 1 as int))")
    keys = F.create_map(F.lit("customer.alert_smishing"), F.lit("smishing"), F.lit("customer.alert_otp_fraud"), F.lit("otp"))
    return v.sms.select("event_id", "recipient", F.coalesce(F.try_element_at(keys, action), F.lit("default")).alias("template"), F.col("recipient").like("N%").alias("ok"))
