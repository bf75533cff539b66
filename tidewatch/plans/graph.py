"""Queries over the property graph and its motifs. The motif windows of the lab set are 24 times the usual ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import graph as g
from tidewatch.operators import motifs as m
from tidewatch.plans.base import query

OPS = "event_id, ordinal, op, node_kind, node_id, edge_kind, src_kind, src_id, dst_kind, dst_id"


def ops_sql(view: str, *rows: tuple[str, str]) -> str:
    """Operations in order; each (condition, struct fields) is one. The ordinal counts those that apply."""
    parts = "\nunion all ".join(f"select event_id, {i} o, {fields} from {view} where {cond}" for i, (cond, fields) in enumerate(rows))
    return f"select event_id, (row_number() over (partition by event_id order by o) - 1)::int ordinal, op, node_kind, node_id, edge_kind, src_kind, src_id, dst_kind, dst_id from ({parts})"


def nd(kind: str, col: str, cond: str | None = None) -> tuple[str, str]:
    return cond or f"{col} is not null", f"'upsert_node' op, '{kind}' node_kind, {col} node_id, null edge_kind, null src_kind, null src_id, null dst_kind, null dst_id"


def ed(kind: str, a: str, x: str, b: str, y: str, cond: str = "true") -> tuple[str, str]:
    return f"{x} is not null and {y} is not null and {cond}", f"'upsert_edge', null, null, '{kind}', '{a}', {x}, '{b}', {y}"


SEND = "sender_wallet is not null and recipient_wallet is not null and kind not in ('reversal', 'cash_in')"
ACCOUNT = f"not ({SEND}) and counterparty_kind in ('bank', 'external') and account_hash is not null"
IP = "kind = 'dns_response' and rdata is not null and domain is not null"
DIRECT = "kind = 'ipdr_session' and msisdn is not null and domain is null"
OPS_SQL = {
    "voice": ops_sql("voice", nd("Number", "caller"), nd("Number", "callee"), ed("CALLED", "Number", "caller", "Number", "callee", "kind = 'call_start'"), nd("Device", "imei"), ed("USED", "Number", "caller", "Device", "imei")),
    "sms": ops_sql("sms", nd("Number", "sender"), nd("Number", "recipient"), ed("SMSED", "Number", "sender", "Number", "recipient", "kind in ('mt', 'mo')")),
    "data": ops_sql(
        "(select event_id, kind, nullif(msisdn, '') msisdn, nullif(domain, '') as domain, nullif(rdata, '') rdata from data)", nd("Number", "msisdn"), nd("Domain", "domain"),
        ed("QUERIED", "Number", "msisdn", "Domain", "domain", "kind in ('dns_query', 'dns_response')"), nd("IPEndpoint", "rdata", IP), ed("RESOLVED_TO", "Domain", "domain", "IPEndpoint", "rdata", IP),
        ed("CONNECTED", "Number", "msisdn", "Domain", "domain", "kind = 'ipdr_session'"), nd("IPEndpoint", "rdata", f"{DIRECT} and rdata is not null"), ed("CONNECTED", "Number", "msisdn", "IPEndpoint", "rdata", DIRECT),
    ),
    "momo": ops_sql("momo", nd("Wallet", "sender_wallet"), nd("Wallet", "recipient_wallet"), ed("OWNS", "Number", "sender_msisdn", "Wallet", "sender_wallet"), ed("OWNS", "Number", "recipient_msisdn", "Wallet", "recipient_wallet"), ed("SENT", "Wallet", "sender_wallet", "Wallet", "recipient_wallet", SEND), nd("Account", "account_hash", ACCOUNT), ed("CASHED_OUT_TO", "Wallet", "sender_wallet", "Account", "account_hash", ACCOUNT)),
}
MAKERS = {"voice": g.voice_operations, "sms": g.sms_operations, "data": g.data_operations, "momo": g.momo_operations}


# Properties of the edges: those of the edge kind, as text.
PROPERTIES = {"sms": ("SMSED", ["template_hash"]), "data": ("CONNECTED", ["bytes_up", "bytes_down"])}


def properties_sql(name: str) -> str:
    kind, own = PROPERTIES.get(name, ("", []))
    more = "".join(f", case when edge_kind = '{kind}' then e.{c}::varchar end {c}" for c in own)
    return f"select o.*{more} from ({OPS_SQL[name]}) o join {name} e using (event_id)"


def register_ops(name: str) -> None:
    @query(f"graph_ops_{name}", properties_sql(name))
    def run(v):
        return MAKERS[name](getattr(v, name)).select(*OPS.split(", "), *[F.col("properties")[c].alias(c) for c in PROPERTIES.get(name, ("", []))[1]])


for _name in MAKERS:
    register_ops(_name)


def all_ops(v) -> DataFrame:
    return reduce(DataFrame.unionByName, [MAKERS[n](getattr(v, n)).select("ts_ms", *OPS.split(", ")) for n in MAKERS])


def ops_cte(name: str) -> str:
    return f"o as (select o.*, e.ts_ms from ({OPS_SQL[name]}) o join ev e using (event_id))"


@query("graph_mutations", f"""with {ops_cte("momo")} select 'gm_' || event_id || '_' || ordinal mutation_id, coalesce(node_id, src_id) as key, op, coalesce(node_kind, edge_kind) kind from o""")
def mutations(v):
    return g.mutations(g.momo_operations(v.momo))


@query("graph_dedup", f"with {ops_cte('data')} select distinct edge_kind kind, src_kind, src_id, dst_kind, dst_id, ts_ms from o where op = 'upsert_edge'")
def dedup(v):
    return g.distinct_edges(g.data_operations(v.data))


@query("graph_nodes", f"with {ops_cte('voice')} select node_kind kind, node_id id, max(ts_ms) last_ms from o where op = 'upsert_node' group by all")
def nodes(v):
    return g.latest_nodes(g.voice_operations(v.voice))


@query("flink_edges", """select 'CALLED' edge_kind, caller src_id, callee dst_id, ts_ms from voice where kind = 'call_start'
    union all select 'SMSED', sender, recipient, ts_ms from sms where kind in ('mt', 'mo')
    union all select 'SENT', sender_wallet, recipient_wallet, ts_ms from momo where kind in ('p2p_transfer', 'merchant_payment', 'cash_out') and recipient_wallet is not null
    union all select 'CASHED_OUT_TO', sender_wallet, account_hash, ts_ms from momo where account_hash is not null""")
def flink_edges(v):
    def rows(df, kind, a, b):
        return df.select(F.lit(kind).alias("edge_kind"), F.col(a).alias("src_id"), F.col(b).alias("dst_id"), "ts_ms")

    parts = [
        rows(v.voice.where("kind = 'call_start'"), "CALLED", "caller", "callee"), rows(v.sms.where("kind in ('mt', 'mo')"), "SMSED", "sender", "recipient"),
        rows(v.momo.where("kind in ('p2p_transfer', 'merchant_payment', 'cash_out') and recipient_wallet is not null"), "SENT", "sender_wallet", "recipient_wallet"),
        rows(v.momo.where("account_hash is not null"), "CASHED_OUT_TO", "sender_wallet", "account_hash"),
    ]
    return reduce(DataFrame.unionByName, parts)


LAB = 24


def vsm_sql(sms: int, send: int) -> str:
    return f"""with s as (select c.event_id call_id, c.caller, c.callee, c.ts_ms call_ms, min(s.ts_ms) sms_ms from calls c
        join sms s on s.sender = c.caller and s.recipient = c.callee and s.ts_ms > c.ts_ms and s.ts_ms <= c.ts_ms + {sms} group by all)
    select call_id, caller, callee, wallet, arg_min(dst, (p.ts_ms, p.edge_id)) payee, (sms_ms - call_ms) // 1000 sms_lag_s, (min(p.ts_ms) - sms_ms) // 1000 send_lag_s, 0.9::double confidence
    from s join owns on callee = number join sent p on p.src = wallet and p.ts_ms > sms_ms and p.ts_ms <= sms_ms + {send} group by call_id, caller, callee, wallet, sms_ms, call_ms"""


@query("motif_voice_sms_momo", vsm_sql(m.HOUR, m.DAY))
def voice_sms_momo(v):
    return m.voice_sms_momo(v.voice.where("kind = 'call_start'"), v.sms, v.owns, v.sent)


@query("motif_voice_sms_momo_lab", vsm_sql(LAB * m.HOUR, LAB * m.DAY))
def voice_sms_momo_lab(v):
    return m.voice_sms_momo(v.voice.where("kind = 'call_start'"), v.sms, v.owns, v.sent, LAB * m.HOUR, LAB * m.DAY)


def vm_sql(within: int) -> str:
    return f"""select c.event_id call_id, c.caller, c.callee, a.wallet caller_wallet, arg_min(p.dst, (p.ts_ms, p.edge_id)) callee_wallet,
        (min(p.ts_ms) - c.ts_ms) // 1000 lag_s, 0.92::double confidence
    from calls c join owns a on a.number = c.caller join owns b on b.number = c.callee join sent p on p.src = a.wallet and p.dst = b.wallet and p.ts_ms >= c.ts_ms and p.ts_ms <= c.ts_ms + {within}
    group by c.event_id, c.caller, c.callee, a.wallet, c.ts_ms"""


@query("motif_voice_then_momo", vm_sql(30 * m.MINUTE))
def voice_then_momo(v):
    return m.voice_then_momo(v.voice.where("kind = 'call_start'"), v.owns, v.sent)


@query("motif_voice_then_momo_lab", vm_sql(LAB * 30 * m.MINUTE))
def voice_then_momo_lab(v):
    return m.voice_then_momo(v.voice.where("kind = 'call_start'"), v.owns, v.sent, LAB * 30 * m.MINUTE)


SMS_URL = f"""with q as (select msisdn, domain, ts_ms, event_id from data where kind = 'dns_query' and msisdn is not null and domain like '%.net')
    select s.event_id sms_id, sender, recipient, arg_min(domain, (q.ts_ms, q.event_id)) as domain, (min(q.ts_ms) - s.ts_ms) // 1000 lag_s, 0.94::double confidence
    from sms s join q on recipient = msisdn and q.ts_ms > s.ts_ms and q.ts_ms <= s.ts_ms + {LAB * m.HOUR} group by s.event_id, sender, recipient, s.ts_ms"""


@query("motif_sms_url", SMS_URL)
def sms_url(v):
    return m.sms_url(v.sms, v.data, v.data.where("domain like '%.net'"), LAB * m.HOUR)


FUSION = """with p as (select distinct imei, caller number from voice), n as (select imei, count(*) n, string_agg(number, ',' order by number) numbers from p group by 1 having count(*) >= 2),
    w as (select imei, string_agg(wallet, ',' order by wallet) wallets from (select distinct imei, wallet from p join owns using (number) where wallet in (select src from sent)) group by 1)
    select imei, numbers, wallets, round(least(0.95, 0.7 + 0.05 * (n - 2)), 6)::double confidence from n join w using (imei)"""


@query("motif_device_fusion", FUSION)
def device_fusion(v):
    return m.device_fusion(v.voice, v.owns, v.sent)


@query("motif_sim_carousel", """select imei, string_agg(caller, ',' order by caller) numbers, count(*)::int n_numbers, round(least(0.95, 0.55 + 0.1 * (count(*) - 3)), 6)::double confidence
    from (select distinct imei, caller from voice) group by 1 having count(*) >= 3""")
def sim_carousel(v):
    return m.sim_carousel(v.voice)


BUST = {"burst": 3 * m.DAY, "dormant": 31 * m.DAY, "least": 2, "amount": 2_000, "quiet": 25}


BUST_OUT = f"""with l as (select src, max(ts_ms) last_ms from sent group by 1), x as (select sent.src, ts_ms >= last_ms - {BUST["burst"]} hot, ts_ms, last_ms, amount_minor from sent join l using (src))
    select src, count(*) filter (hot) burst_count, (coalesce(sum(amount_minor) filter (hot), 0))::bigint burst_amount, count(*) filter (not hot and ts_ms >= last_ms - {BUST["dormant"]}) dormant_count
    from x group by 1 having burst_count >= {BUST["least"]} and burst_amount >= {BUST["amount"]} and dormant_count <= {BUST["quiet"]}"""


@query("motif_bust_out", BUST_OUT)
def bust_out(v):
    return m.bust_out(v.sent, **BUST)


MULE = f"""with recursive p as (select distinct [src, dst] path, ts_ms last from sent where src <> dst
        union select list_append(path, dst), ts_ms from p join sent on src = path[-1] and ts_ms >= last and ts_ms - last <= {12 * m.HOUR} and not list_contains(path, dst) where len(path) < 6),
    c as (select distinct path from p where len(path) >= 3), f as (select src, dst, arg_min(amount_minor, (ts_ms, edge_id)) amount from sent group by all),
    l as (select path, unnest(range(1, len(path))) i from c)
    select array_to_string(path, '>') chain, len(path)::int length, sum(amount)::bigint total_amount_minor, round(least(0.95, 0.6 + 0.1 * (len(path) - 3)), 6)::double confidence
    from l join f on src = path[i] and dst = path[i + 1] group by path"""


@query("motif_mule_chain", MULE)
def mule_chain(v):
    return m.mule_chains(v.sent, within=12 * m.HOUR)


# The other motifs' rows are those of their own queries above: id and confidence of each.
MOTIFS = f"""a as ({vsm_sql(LAB * m.HOUR, LAB * m.DAY)}), b as ({vm_sql(LAB * 30 * m.MINUTE)}), mc as ({MULE}), bo as ({BUST_OUT}), su as ({SMS_URL}), df as ({FUSION}),
    n as (select imei, count(distinct caller) n from voice group by 1 having count(distinct caller) >= 3),
    mo as (select 'voice_sms_momo_24h' motif, call_id::varchar id, confidence from a union all select 'voice_then_momo_30m', call_id::varchar, confidence from b
        union all select 'sim_carousel', imei, round(least(0.95, 0.55 + 0.1 * (n - 3)), 6)::double from n union all select 'mule_chain', chain, confidence from mc union all select 'bust_out', src, 0.88 from bo
        union all select 'sms_url', sms_id::varchar, confidence from su union all select 'device_fusion', imei, confidence from df)"""


@query("all_motifs", f"with {MOTIFS} select motif, id, confidence::double confidence from mo")
def all_motifs(v):
    return motif_union(v).select("motif", "id", "confidence")


def motif_union(v) -> DataFrame:
    """motif, id (of the call, message, device, wallet or chain), confidence of all seven detectors."""
    calls = v.voice.where("kind = 'call_start'")
    found = {
        "voice_sms_momo_24h": (m.voice_sms_momo(calls, v.sms, v.owns, v.sent, LAB * m.HOUR, LAB * m.DAY), "call_id"),
        "voice_then_momo_30m": (m.voice_then_momo(calls, v.owns, v.sent, LAB * 30 * m.MINUTE), "call_id"),
        "sim_carousel": (m.sim_carousel(v.voice), "imei"), "device_fusion": (m.device_fusion(v.voice, v.owns, v.sent), "imei"),
        "mule_chain": (m.mule_chains(v.sent, within=12 * m.HOUR), "chain"), "bust_out": (m.bust_out(v.sent, **BUST).withColumn("confidence", F.lit(0.88)), "src"),
        "sms_url": (m.sms_url(v.sms, v.data, v.data.where("domain like '%.net'"), LAB * m.HOUR), "sms_id"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("motif"), F.col(key).cast("string").alias("id"), F.col("confidence").cast("double").alias("confidence")) for name, (df, key) in found.items()])


REACH = f"""und as (select distinct least(src, dst) a, greatest(src, dst) b from sent where src <> dst),
    bi as (select a, b from und union all select b, a from und),
    reach(id, seen) as (select a, a from bi union select bi.b, reach.seen from reach join bi on bi.a = reach.id),
    comp as (select id, min(seen) component from reach group by 1)"""


@query("components", f"with recursive {REACH} select id, component from comp")
def components(v):
    return g.components(v.sent)


@query("degrees", "with u as (select distinct least(src, dst) a, greatest(src, dst) b from sent where src <> dst) select id, count(*) degree from (select a id from u union all select b from u) group by 1")
def degrees(v):
    return g.degrees(v.sent)


@query("edge_weights", "select least(src, dst) a, greatest(src, dst) b, count(*) weight from sent where src <> dst group by 1, 2")
def edge_weights(v):
    return g.edge_weights(v.sent)


@query("rings", f"""with recursive {REACH}, size as (select component, count(*) members from comp group by 1 having count(*) >= 3),
    sh as (select imei, min('W' || substr(caller, 2)) w from voice group by 1 having count(distinct caller) > 1),
    dv as (select component, count(*) devices from sh join comp on id = w group by 1),
    fl as (select component, count(*) flows from (select distinct src, dst from sent) join comp on id = src group by 1),
    mo as (select component, count(distinct motif) motifs from (select 'mule' motif, sender_wallet id from momo where kind = 'cash_out' union all select 'rev', sender_wallet from momo where kind = 'reversal') join comp using (id) group by 1)
    select component, members, coalesce(devices, 0) devices, coalesce(flows, 0) flows, coalesce(motifs, 0) motifs,
        round(least(0.99, least(0.3, 0.05 * members) + least(0.3, 0.1 * coalesce(devices, 0)) + least(0.2, 0.05 * coalesce(flows, 0)) + least(0.4, 0.15 * coalesce(motifs, 0))), 6)::double score
    from size left join dv using (component) left join fl using (component) left join mo using (component)""")
def rings(v):
    used = v.voice.select(F.concat(F.lit("W"), F.substring("caller", 2, 30)).alias("src"), F.col("imei").alias("dst"))
    motifs = v.momo.where("kind in ('cash_out', 'reversal')").select(F.expr("if(kind = 'cash_out', 'mule', 'rev')").alias("motif"), F.col("sender_wallet").alias("id"))
    return g.rings(g.components(v.sent), used, v.sent.select("src", "dst"), motifs)


@query("khop", f"""with recursive u as (select distinct least(src, dst) a, greatest(src, dst) b from sent where src <> dst), bi as (select a, b from u union all select b, a from u),
    h(id, hops) as (select id, 0 from (values ('W19'), ('W5'), ('none')) t(id) union select bi.b, hops + 1 from h join bi on bi.a = h.id where hops < 3)
    select id, min(hops)::int hops from h group by 1""")
def khop(v):
    return g.k_hop(v.sent, v.spark.createDataFrame([(s,) for s in SEEDS], "id string"))


# Two wallets that send and one that is not there.
SEEDS = ("W19", "W5", "none")
FLOWS = f"""e as (select src, dst, 'SENT' kind, amount_minor from sent union all select sender_wallet, account_hash, 'CASHED_OUT_TO', amount_minor from momo where account_hash is not null and kind <> 'reversal'),
    hop as (select distinct src, dst from e where src <> dst),
    p(seed, path) as (select s, [s] from (values {", ".join(f"('{s}')" for s in SEEDS)}) t(s) union all select seed, list_append(path, dst) from p join hop on src = path[-1] and not list_contains(path, dst) where len(path) < 5),
    l as (select distinct seed, path[i] src, path[i + 1] dst from (select seed, path, unnest(range(1, len(path))) i from p))"""


def flows(v):
    """Wallet to wallet and wallet to account, with the seeds of the queries."""
    out = v.momo.where("account_hash is not null and kind <> 'reversal'").select(F.col("sender_wallet").alias("src"), F.col("account_hash").alias("dst"), F.lit("CASHED_OUT_TO").alias("kind"), "amount_minor")
    both = v.sent.select("src", "dst", F.lit("SENT").alias("kind"), "amount_minor").unionByName(out)
    return both, v.spark.createDataFrame([(s,) for s in SEEDS], "id string")


@query("fund_flow", f"""with recursive {FLOWS}
    select src, dst, sum(amount_minor)::bigint amount_minor, count(*) n from e join (select distinct src, dst from l) using (src, dst) group by 1, 2""")
def fund_flow(v):
    return g.fund_flow(*flows(v))


@query("fund_flow_top", f"""with recursive {FLOWS}, d as (select seed, path[i] src, min(i) hop from (select seed, path, unnest(range(1, len(path) + 1)) i from p) group by 1, 2),
    t as (select seed, src, dst, min(kind) kind, sum(amount_minor)::bigint amount_minor, count(*) n from e join l using (src, dst) group by 1, 2, 3)
    select seed, rank::int rank, src, dst, kind, amount_minor, n, hop::int hop from (select *, row_number() over (partition by seed order by hop, amount_minor desc, src, dst) as rank from t join d using (seed, src)) where rank <= 200""")
def fund_flow_top(v):
    return g.largest_flows(*flows(v))


HASH = "sha256('salt|' || {kind} || '|' || {value})"


@query("hash_ids", f"select distinct 'Wallet' kind, sender_wallet id, {HASH.format(kind="'Wallet'", value='sender_wallet')} hash from momo union select distinct 'Device', imei, left({HASH.format(kind="'Device'", value='imei')}, 16) from voice")
def hash_ids(v):
    own = v.momo.select(F.lit("Wallet").alias("kind"), F.col("sender_wallet").alias("id")).unionByName(v.voice.select(F.lit("Device").alias("kind"), F.col("imei").alias("id"))).distinct()
    return own.withColumn("hash", g.identifier_hash(F.col("kind"), F.col("id")))


# Rings of the federation queries: wallets by their number modulo 10, without every fourth.
RING_SQL = f"""mem as (select distinct 'R' || substr(sender_wallet, 2)::int % 10 ring, sender_wallet id from momo where substr(sender_wallet, 2)::int % 4 <> 0),
    ex as (select distinct m.ring, {HASH.format(kind="'Wallet'", value='dst')} hash from sent join mem m on m.id = src where not exists (select 1 from mem x where x.ring = m.ring and x.id = dst))"""


def ring_members(v) -> DataFrame:
    n = F.substring("sender_wallet", 2, 30).cast("int")
    return v.momo.where(n % 4 != 0).select(F.concat(F.lit("R"), n % 10).alias("ring"), F.col("sender_wallet").alias("id")).distinct()


def exits(v) -> DataFrame:
    edges = v.sent.select(F.lit("SENT").alias("edge_kind"), F.col("src").alias("src_id"), F.lit("Wallet").alias("dst_kind"), F.col("dst").alias("dst_id"))
    return g.ring_exits(edges, ring_members(v))


@query("ring_exits", f"with {RING_SQL} select ring, 'Wallet' kind, hash from ex")
def ring_exits(v):
    return exits(v)


@query("cross_opco", f"""with {RING_SQL}, fl as (select distinct 'P' || substr(sender_wallet, 2)::int % 3 peer, {HASH.format(kind="'Wallet'", value='sender_wallet')} h, 0.5 + substr(sender_wallet, 2)::int % 5 / 10 confidence from momo where substr(sender_wallet, 2)::int % 7 = 0),
    a as (select ring, count(distinct peer) peers, count(*) hits, round(avg(confidence), 6) mean_confidence from ex join fl on h = hash group by 1)
    select *, round(least(0.4, 0.1 * peers) + least(0.2, 0.05 * mean_confidence), 6) lift from a""")
def cross_opco(v):
    n = F.substring("sender_wallet", 2, 30).cast("int")
    flags = v.momo.where(n % 7 == 0).select(F.concat(F.lit("P"), n % 3).alias("peer"), g.identifier_hash(F.lit("Wallet"), F.col("sender_wallet")).alias("identifier_hash"), (0.5 + n % 5 / 10).alias("confidence")).distinct()
    return g.cross_operator(exits(v), flags)


NODES = """hn as (select distinct 'O' || event_id % 3 opco, sender_wallet identifier_hash, case when event_id % 2 = 0 then 'Wallet' else 'Number' end kind, round(substr(sender_wallet, 2)::int % 10 / 10, 6) risk_score from momo)"""


def peer_nodes(v) -> DataFrame:
    n = F.substring("sender_wallet", 2, 30).cast("int")
    return v.momo.select(F.expr("concat('O', event_id % 3)").alias("opco"), F.col("sender_wallet").alias("identifier_hash"), F.expr("if(event_id % 2 = 0, 'Wallet', 'Number')").alias("kind"), F.round(n % 10 / 10, 6).alias("risk_score")).distinct()


@query("graph_merge", f"""with {NODES} select identifier_hash, min(kind) kind, max(risk_score) risk_score, string_agg(distinct opco, ',' order by opco) contributors,
    case when count(distinct opco) > 1 then 'multi' else min(opco) end opco from hn group by 1""")
def graph_merge(v):
    return g.merge_nodes(peer_nodes(v).groupBy("opco", "identifier_hash").agg(F.min("kind").alias("kind"), F.max("risk_score").alias("risk_score")).withColumn("kind", F.min("kind").over(_by_hash())))


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("identifier_hash")


@query("cross_opco_edges", """with n as (select distinct sender_wallet h, 'O' || substr(sender_wallet, 2)::int % 3 opco from momo)
    select e.edge_id, e.src src_hash, e.dst dst_hash, a.opco src_opco, b.opco dst_opco from sent e join n a on a.h = e.src join n b on b.h = e.dst where a.opco <> b.opco""")
def cross_opco_edges(v):
    nodes = v.momo.select(F.col("sender_wallet").alias("identifier_hash"), F.concat(F.lit("O"), F.substring("sender_wallet", 2, 30).cast("int") % 3).alias("opco")).distinct()
    return g.seams(v.sent.select("edge_id", F.col("src").alias("src_hash"), F.col("dst").alias("dst_hash")), nodes).select("edge_id", "src_hash", "dst_hash", "src_opco", "dst_opco")
