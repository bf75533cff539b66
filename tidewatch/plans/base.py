"""The registry of queries, and the telecom views in the SQL of the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "ev": """select event_id, epoch_us(ts) // 1000 ts_ms, user_id, event_type, round(value * 100)::bigint cents, (props->>'$.k')::bigint k,
        (select max(user_id) + 1 from events) n_users from events""",
    "voice": """select event_id, ts_ms, 'T' || user_id % 5 tenant_id, 'N' || user_id caller, 'N' || (user_id + 1 + k % 3) % n_users callee,
        case when k % 10 < 8 then 'call_start' else 'call_end' end kind, cents // 100 duration_s,
        lpad((case when k % 2 = 0 then user_id // 4 else user_id end)::varchar, 15, '3') imei from ev where event_type in ('view', 'error')""",
    "sms": """select event_id, ts_ms, 'T' || user_id % 5 tenant_id, 'N' || user_id sender, 'N' || (user_id + 1 + k % 3) % n_users recipient,
        case when k % 10 = 0 then 'mo' else 'mt' end kind, text body, sha256(lang || source) template_hash, case when k % 7 = 0 then 'BANK' end short_code
        from ev left join documents on doc_id = event_id % (select count(*) from documents) where event_type in ('signup', 'click')""",
    "momo": """select event_id, ts_ms, 'T' || user_id % 5 tenant_id, 'W' || user_id sender_wallet,
        case when k % 10 <> 3 then 'W' || (user_id + 1 + k % 3) % n_users end recipient_wallet, 'N' || user_id sender_msisdn,
        case when k % 10 <> 3 then 'N' || (user_id + 1 + k % 3) % n_users end recipient_msisdn, cents amount_minor,
        case k % 10 when 0 then 'cash_in' when 1 then 'cash_out' when 2 then 'reversal' else 'p2p_transfer' end kind,
        case when k % 4 = 0 then 'agent' else 'app' end channel, case when k % 10 = 3 then 'bank' else 'wallet' end counterparty_kind,
        case when k % 10 = 3 then 'A' || k end account_hash from ev where event_type in ('purchase', 'click')""",
    "data": """select event_id, ts_ms, 'T' || user_id % 5 tenant_id, case when k % 20 <> 0 then 'N' || user_id end msisdn,
        case k % 5 when 0 then 'ipdr_session' when 1 then 'dns_response' else 'dns_query' end kind,
        lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as domain, case when k % 5 = 1 then k || '.' || user_id % 256 || '.7.1' end rdata,
        cents bytes_up, cents * 10 bytes_down
        from ev left join pages on page_id = event_id % (select count(*) from pages) where event_type = 'error'""",
    "owns": "select distinct 'N' || user_id number, 'W' || user_id wallet from ev",
    "sent": """select event_id edge_id, sender_wallet src, recipient_wallet dst, ts_ms, amount_minor from momo
        where recipient_wallet is not null and kind not in ('reversal', 'cash_in')""",
    "alerts": """select o_orderkey id, 'N' || o_custkey subject_id, 'T' || o_custkey % 5 tenant_id,
        case o_orderpriority[1] when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end severity,
        case o_orderstatus when 'O' then 'new' when 'P' then 'claimed' else 'closed' end status,
        least(1.0::double, round(o_totalprice / 600000, 3)) score, epoch_us(o_orderdate) // 1000 created_ms,
        case when o_orderkey % 3 = 0 then '{"motif":"' || (['mule_chain', 'bust_out', 'sim_carousel', 'voice_sms_momo_24h'])[o_orderkey % 4 + 1]
            || '","peers":["P' || o_orderkey % 4 || '"]}' else '{}' end details from orders""",
    "subscribers": "select 'T' || c_nationkey % 5 tenant_id, 'number' kind, 'N' || c_custkey id, 'O' || c_nationkey % 3 opco from customer",
    "businesses": "select 'N' || s_suppkey msisdn, s_name as name, s_acctbal > 0 verified, case when s_suppkey % 4 = 0 then 'bank' end short_code from supplier",
    "calls": "select * from voice where kind = 'call_start'",
}
_NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b(from|join)\s+{v}\b", text)] for name, text in VIEWS.items()}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_order(_NEEDS[n]), n] if x not in out]
    return out


def with_views(sql: str) -> str:
    """sql with the views that it names in front; sql may start with its own WITH."""
    used = _order([v for v in VIEWS if re.search(rf"\b{v}\b", sql)])
    if not used:
        return sql
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in used)
    head = re.match(r"\s*with\s+(recursive\s+)?", sql)
    rest = f",\n{sql[head.end():]}" if head else f"\n{sql}"
    return f"with {head[1] or '' if head else ''}{ctes}{rest}"


def query(name: str, sql: str | None = None):
    """Register f(views) -> DataFrame as a query, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
