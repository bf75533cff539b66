"""Queries over event-time features. LAB widens the windows: the test events are sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as f
from tidewatch.plans.base import query

LAB = 24
H, D = f.HOUR * LAB, f.DAY * LAB
DAY_LAB = 3 * f.DAY

NUMBERS = """nums as (
    select caller msisdn, ts_ms, event_id, 'voice' topic, kind = 'call_start' and callee is not null is_call, case when kind = 'call_start' then callee end callee, imei,
        null::varchar template_hash, null::varchar as domain, 0::bigint bytes from voice
    union all select sender, ts_ms, event_id, 'sms', false, null, null, template_hash, null, 0 from sms
    union all select msisdn, ts_ms, event_id, 'data', false, null, null, null, case when kind in ('dns_query', 'dns_response') then domain end,
        case when kind = 'ipdr_session' then bytes_up + bytes_down else 0 end from data where msisdn is not null)"""


def over(w: int, closed: bool = True, key: str = "msisdn") -> str:
    return f"over (partition by {key} order by ts_ms range between {w if closed else w - 1} preceding and current row)"


def numbers(v, *only):
    return f.number_features(f.number_events(v.voice, v.sms, v.data), LAB, F.col("domain").like("%.net"), only or f.NUMBER)


def number_query(name: str, cols: str, sql: str):
    @query(name, f"with {NUMBERS} select msisdn, event_id, topic, {sql} from nums")
    def run(v):
        return numbers(v, *cols.split()).select("msisdn", "event_id", "topic", *cols.split())


number_query("feat_velocity", "velocity_1m velocity_5m velocity_1h", f"count(*) filter (is_call) {over(f.MINUTE * LAB, False)} velocity_1m, count(*) filter (is_call) {over(5 * f.MINUTE * LAB, False)} velocity_5m, count(*) filter (is_call) {over(H)} velocity_1h")
number_query("feat_fanout", "fanout_1h", f"count(distinct callee) {over(H, False)} fanout_1h")
number_query("feat_imei", "imei_count", f"count(distinct imei) {over(30 * f.DAY)} imei_count")
number_query("feat_sms", "sms_freq_1h", f"count(*) filter (topic = 'sms') {over(H)} sms_freq_1h")
number_query("feat_dns", "dns_query_rate_1h suspicious_domain_count_1h", f"count(domain) {over(H)} dns_query_rate_1h, count(*) filter (domain like '%.net') {over(H)} suspicious_domain_count_1h")


@query("feat_template_top", f"""with {NUMBERS}, x as (select msisdn, ts_ms, event_id, topic from nums),
    c as (select x.msisdn, x.event_id, x.topic, n.template_hash h, count(*) c, min(n.ts_ms) t from x join nums n on n.msisdn = x.msisdn and n.template_hash is not null
        and n.ts_ms between x.ts_ms - {H} and x.ts_ms group by all)
    select x.msisdn, x.event_id, x.topic, arg_min(h, (-c, t, h)) sms_template_top from x left join c using (msisdn, event_id, topic) group by all""")
def template_top(v):
    return numbers(v, "sms_template_top").select("msisdn", "event_id", "topic", "sms_template_top")


@query("feat_volume", f"""with {NUMBERS}, x as (select msisdn, event_id, topic, sum(bytes) {over(H)}::bigint data_volume_1h_bytes,
        (sum(bytes) {over(7 * D)} // 168)::bigint data_volume_baseline_bytes from nums)
    select *, round(case when data_volume_baseline_bytes <= 0 then 0 else data_volume_1h_bytes / data_volume_baseline_bytes end, 6) data_volume_anomaly from x""")
def volume(v):
    out = numbers(v, "data_volume_1h_bytes", "data_volume_baseline_bytes").drop("ts_ms")
    return out.withColumn("data_volume_anomaly", F.round(f.anomaly(F.col("data_volume_1h_bytes"), F.col("data_volume_baseline_bytes")), 6))


WALLETS = f"""wals as (select *, coalesce(sender_wallet, recipient_wallet) wallet_id, coalesce(recipient_wallet, account_hash) cp from momo),
    wf as (select wallet_id, ts_ms, event_id, count(*) filter (kind <> 'reversal') {over(H, key="wallet_id")} txn_velocity_1h,
        count(distinct cp) {over(D, key="wallet_id")} counterparty_diversity_24h,
        list_sort(list(amount_minor) filter (kind <> 'reversal') {over(D, key="wallet_id")}) a from wals where wallet_id is not null),
    wfeat as (select wallet_id, ts_ms, event_id, txn_velocity_1h, counterparty_diversity_24h, coalesce(a[greatest(1, len(a) * 95 // 100)], 0)::double value_p95_24h from wf)"""


@query("feat_wallet", f"with {WALLETS} select wallet_id, event_id, txn_velocity_1h, counterparty_diversity_24h from wfeat")
def wallet(v):
    return f.wallet_features(v.momo, LAB, ("txn_velocity_1h", "counterparty_diversity_24h")).drop("ts_ms")


@query("feat_p95", f"with {WALLETS} select wallet_id, event_id, value_p95_24h from wfeat")
def p95(v):
    return f.wallet_features(v.momo, LAB, ("value_p95_24h",)).drop("ts_ms")


@query("feat_final", f"""with {WALLETS} select wallet_id, ts_ms, event_id, txn_velocity_1h, counterparty_diversity_24h, value_p95_24h
    from wfeat qualify row_number() over (partition by wallet_id order by ts_ms desc, event_id desc) = 1""")
def final(v):
    return f.final_state(f.wallet_features(v.momo, LAB), "wallet_id")


@query("feat_final_number", f"""with {NUMBERS} select msisdn, ts_ms, event_id, topic, count(*) filter (is_call) {over(H)} velocity_1h, count(distinct callee) {over(H, False)} fanout_1h, count(distinct imei) {over(30 * f.DAY)} imei_count,
        count(*) filter (topic = 'sms') {over(H)} sms_freq_1h, count(domain) {over(H)} dns_query_rate_1h, sum(bytes) {over(H)}::bigint data_volume_1h_bytes
    from nums qualify row_number() over (partition by msisdn order by ts_ms desc, event_id desc, topic desc) = 1""")
def final_number(v):
    own = numbers(v, "velocity_1h", "fanout_1h", "imei_count", "sms_freq_1h", "dns_query_rate_1h", "data_volume_1h_bytes")
    return f.final_state(own, "msisdn", ("ts_ms", "event_id", "topic"))


@query("nrd", """select event_id, domain, (ts_ms - min(ts_ms) over (partition by domain)) // 1000 age_s,
    (ts_ms - min(ts_ms) over (partition by domain)) // 1000 <= 7 * 86400 newly_seen from data where domain is not null""")
def nrd(v):
    return f.first_seen(v.data, 7).select("event_id", "domain", "age_s", "newly_seen")


@query("flink_voice_agg", """select ts_ms // 3600000 * 3600000 window_start_ms, tenant_id, caller,
    count(*) filter (ts_ms >= ts_ms // 3600000 * 3600000 + 3540000) vel_1m, count(*) filter (ts_ms >= ts_ms // 3600000 * 3600000 + 3300000) vel_5m,
    count(*) vel_1h, count(distinct callee) fanout_1h from calls group by all""")
def voice_tumble(v):
    end = F.col("ts_ms") - F.floor(F.col("ts_ms") / f.HOUR) * f.HOUR
    return f.tumble(v.voice.where("kind = 'call_start'"), ["tenant_id", "caller"], [F.count_if(end >= f.HOUR - f.MINUTE).alias("vel_1m"), F.count_if(end >= f.HOUR - 5 * f.MINUTE).alias("vel_5m"), F.count("*").alias("vel_1h"), F.count_distinct("callee").alias("fanout_1h")])


@query("flink_sms_agg", "select ts_ms // 3600000 * 3600000 window_start_ms, tenant_id, sender, count(*) sms_freq_1h from sms group by all")
def sms_tumble(v):
    return f.tumble(v.sms, ["tenant_id", "sender"], [F.count("*").alias("sms_freq_1h")])


@query("flink_momo_agg", """select ts_ms // 3600000 * 3600000 window_start_ms, tenant_id, sender_wallet, count(*) txn_velocity_1h,
    count(distinct recipient_wallet) counterparties_1h from momo where kind <> 'reversal' group by all""")
def momo_tumble(v):
    return f.tumble(v.momo.where("kind <> 'reversal'"), ["tenant_id", "sender_wallet"], [F.count("*").alias("txn_velocity_1h"), F.count_distinct("recipient_wallet").alias("counterparties_1h")])


# Events arrive in an order of their own here: by a hash of the id within blocks of 64 events.
ARRIVAL = "event_id // 64 * 64 + event_id * 37 % 64"


@query("late_events", f"""with a as (select event_id, sender_wallet, ts_ms, {ARRIVAL} arrival from momo)
    select event_id, sender_wallet, coalesce(max(ts_ms) over (partition by sender_wallet order by arrival rows between unbounded preceding and 1 preceding) - ts_ms > 30000, false) late from a""")
def late(v):
    own = v.momo.withColumn("arrival", F.expr("event_id div 64 * 64 + event_id * 37 % 64"))
    return f.late_events(own, "sender_wallet", "arrival").select("event_id", "sender_wallet", "late")


@query("dedup_events", "select event_id // 3 * 3 event_key, min(event_id) event_id, arg_min(ts_ms, event_id) ts_ms from momo group by 1")
def dedup(v):
    own = v.momo.select(F.expr("event_id div 3 * 3").alias("event_key"), "event_id", "ts_ms")
    return f.first_of_each(own, ["event_key"], ["event_id"])


@query("suppression", f"""with recursive s as (select sender_wallet, ts_ms, event_id, row_number() over (partition by sender_wallet order by ts_ms, event_id) rn from momo),
    r as (select sender_wallet, ts_ms, event_id, rn, ts_ms last_ms, true emitted from s where rn = 1
        union all select s.sender_wallet, s.ts_ms, s.event_id, s.rn, case when s.ts_ms - r.last_ms >= {3 * f.DAY} then s.ts_ms else r.last_ms end, s.ts_ms - r.last_ms >= {3 * f.DAY}
        from r join s on s.sender_wallet = r.sender_wallet and s.rn = r.rn + 1)
    select event_id, sender_wallet, emitted from r""")
def suppression(v):
    return f.suppressed(v.momo.select("event_id", "sender_wallet", "ts_ms"), "sender_wallet", "ts_ms", "event_id", 3 * f.DAY).select("event_id", "sender_wallet", "emitted")
