"""Queries of the records between the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import records as r
from tidewatch.plans.base import query
from tidewatch.plans.features import WALLETS, H
from tidewatch.plans.graph import HASH, g, ops_cte

SINCE = 1_705_000_000_000


@query("graph_extract", f"""with {ops_cte("voice")}, e as (select distinct edge_kind kind, src_kind, src_id, dst_id, ts_ms from o where op = 'upsert_edge' and ts_ms >= {SINCE}),
    n as (select distinct node_kind, node_id from o where op = 'upsert_node' and node_kind = 'Number' order by 1, 2 limit 5000)
    select e.* from e where exists (select 1 from n where node_kind = src_kind and node_id = src_id)""")
def graph_extract(v):
    ops = g.voice_operations(v.voice)
    return r.extract_window(g.latest_nodes(ops), g.distinct_edges(ops), SINCE, 5000, ("Number",)).select("kind", "src_kind", "src_id", "dst_id", "ts_ms")


@query("agent_relevant", """with x as (select event_id, case when kind in ('cash_in', 'merchant_payment') then recipient_wallet else sender_wallet end agent, sender_wallet, recipient_wallet, account_hash from momo where channel = 'agent')
    select event_id, agent, case when agent = sender_wallet then coalesce(recipient_wallet, account_hash) else sender_wallet end counterparty from x where agent is not null""")
def agent_relevant(v):
    return r.relevant(v.momo).select("event_id", "agent", "counterparty")


@query("agent_window", f"""select event_id, sender_wallet agent, count(*) over w n, sum(amount_minor) over w::bigint total_minor from momo where channel = 'agent' window w as (partition by sender_wallet order by ts_ms range between {H} preceding and current row)""")
def agent_window(v):
    from tidewatch.operators.features import frame

    own = v.momo.where("channel = 'agent'").withColumnRenamed("sender_wallet", "agent")
    w = frame("agent", H)
    return own.select("event_id", "agent", F.count("*").over(w).alias("n"), F.sum("amount_minor").over(w).alias("total_minor"))


@query("rescoring", "select distinct 'Wallet' kind, w as key from (select sender_wallet w from momo union all select recipient_wallet from momo) where w is not null")
def rescoring(v):
    return r.to_rescore(g.mutations(g.momo_operations(v.momo)))


@query("signal_urls", """select event_id, case when event_id % 3 = 0 then 'http://a.example/' || event_id when event_id % 3 = 1 then 'u' || event_id end url from sms""")
def signal_urls(v):
    own = v.sms.select("event_id", F.expr("if(event_id % 3 < 2, 'sms.malicious_url', 'otp.during_call')").alias("kind"), F.expr("if(event_id % 3 = 1, 'url', 'number')").alias("sk"), F.expr("concat('u', event_id)").alias("sid"), F.expr("if(event_id % 3 = 0, map('url_match', concat('http://a.example/', event_id)), map('x', 'y'))").alias("ev"))
    return own.select("event_id", r.url_of(F.col("kind"), F.col("sk"), F.col("sid"), F.col("ev")).alias("url"))


@query("attribution", "select event_id, case when event_id % 2 = 0 then 2 else 1 end::int n, (duration_s + case when event_id % 2 = 0 then event_id else 0 end)::double total from voice")
def attribution(v):
    ev = F.expr("map('duration', cast(duration_s as string), 'kind', kind, 'id', if(event_id % 2 = 0, cast(event_id as string), 'none'))")
    own = v.voice.select("event_id", r.attribution(ev).alias("a"))
    return own.select("event_id", F.size("a").alias("n"), F.aggregate(F.map_values("a"), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("audit_records", "select 'score.number' as action, caller subject_id, tenant_id, ts_ms event_ts_ms, case when callee is null then 1 else 2 end::int n_metadata from voice where tenant_id = 'T1'")
def audit_records(v):
    own = r.audit_record(r.scoped(v.voice, "T1", "fraud"), "score.number", "fraud", "caller", ["kind", "callee"])
    return own.select("action", "subject_id", "tenant_id", "event_ts_ms", F.size("metadata").alias("n_metadata"))


@query("report_events", "select o_orderkey id, (['report', 'block', 'enterprise'])[o_orderkey % 3 + 1] source, case o_orderkey % 3 when 0 then 0.6 when 1 then 0.5 else least(1, o_totalprice / 400000) end::double confidence from orders")
def report_events(v):
    own = v.table("orders").select(F.col("o_orderkey").alias("id"), F.expr("element_at(array('report', 'block', 'enterprise'), cast(o_orderkey % 3 + 1 as int))").alias("source"), (F.col("o_totalprice") / 400_000).alias("given"))
    return r.report_events(own).select("id", "source", "confidence")


# A request for every wallet is among them: it is refused where there are more than 500.
@query("federation_lookup", f"""with q as (select distinct unnest(['Q' || substr(sender_wallet, 2)::int // 300, 'all']) request_id, {HASH.format(kind="'Wallet'", value='sender_wallet')} identifier_hash from momo),
    f as (select distinct {HASH.format(kind="'Wallet'", value='sender_wallet')} identifier_hash, 'P' || substr(sender_wallet, 2)::int % 3 peer from momo where substr(sender_wallet, 2)::int % 4 = 0)
    select request_id, identifier_hash, peer from q join f using (identifier_hash) where request_id in (select request_id from q group by 1 having count(*) <= 500)""")
def federation_lookup(v):
    n = F.substring("sender_wallet", 2, 30).cast("int")
    own = r.hashed(v.momo.select("sender_wallet").distinct(), "Wallet", "sender_wallet", "salt")
    asked = own.select(F.explode(F.array(F.concat(F.lit("Q"), F.floor(n / 300)), F.lit("all"))).alias("request_id"), "identifier_hash")
    flags = own.where(n % 4 == 0).select("identifier_hash", F.concat(F.lit("P"), n % 3).alias("peer"))
    return r.federation_lookup(asked, flags, 500).select("request_id", "identifier_hash", "peer")


@query("held_motifs", """with m as (select distinct 'R' || substr(sender_wallet, 2)::int // 10 ring, sender_wallet id from momo), t as (select edge_id motif_id, src id from sent union select edge_id, dst from sent),
    n as (select motif_id, count(*) need from t group by 1) select ring, motif_id from t join m using (id) join n using (motif_id) group by ring, motif_id, need having count(*) = need""")
def held_motifs(v):
    own = v.sent.select(F.col("edge_id").alias("motif_id"), F.col("src").alias("id")).union(v.sent.select("edge_id", "dst"))
    members = v.momo.select(F.concat(F.lit("R"), F.expr("cast(substr(sender_wallet, 2) as int) div 10")).alias("ring"), F.col("sender_wallet").alias("id")).distinct()
    return r.held_motifs(members, own)


@query("wallet_snapshot", f"""with {WALLETS}, s as (select * from wfeat qualify row_number() over (partition by wallet_id order by ts_ms desc, event_id desc) = 1)
    select event_id, m.recipient_wallet wallet_id, coalesce(s.txn_velocity_1h, 0) txn_velocity_1h, coalesce(s.value_p95_24h, 0) value_p95_24h from momo m left join s on s.wallet_id = m.recipient_wallet where m.recipient_wallet is not null""".replace("select event_id, m.", "select m.event_id, m."))
def wallet_snapshot(v):
    """A point get of the latest features for each transaction's recipient."""
    from tidewatch.operators.features import final_state, wallet_features

    s = final_state(wallet_features(v.momo, 24), "wallet_id").select("wallet_id", "txn_velocity_1h", "value_p95_24h")
    own = v.momo.where("recipient_wallet is not null").select("event_id", F.col("recipient_wallet").alias("wallet_id")).join(s, "wallet_id", "left")
    return own.select("event_id", "wallet_id", F.coalesce("txn_velocity_1h", F.lit(0)).alias("txn_velocity_1h"), F.coalesce("value_p95_24h", F.lit(0.0)).alias("value_p95_24h"))


