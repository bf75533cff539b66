"""Queries of the smaller functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import content as c
from tidewatch.operators import extras as x
from tidewatch.plans.base import query
from tidewatch.plans.content import MSG, messages
from tidewatch.plans.features import DAY_LAB


@query("uuid5", f"""with h as (select event_id, sha1(unhex('{x.NAMESPACE}') || encode('event-' || event_id)) h from events)
    select event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] id from h""")
def uuid5(v):
    return v.table("events").select("event_id", x.uuid5(F.expr("concat('event-', event_id)")).alias("id"))


@query("ip_canon")
def ip_canon(v):
    raw = F.expr("case event_id % 4 when 0 then concat('10.0.', user_id % 256, '.1') when 1 then concat('2001:0DB8::00', lower(hex(user_id % 256))) when 2 then ' 1.2.3.4 ' else '1.2.3.999' end")
    return v.table("events").select("event_id", x.canonical_ip(raw).alias("ip"))


@query("locale_pick", """select event_id, (['tw,en;q=0.8', 'fr;q=0.3, en-GH;q=0.9,tw', 'en;q=0, ga ;q=0.5'])[event_id % 3 + 1] header, (['tw en', 'tw en-gh fr', 'ga'])[event_id % 3 + 1] languages from events""")
def locale_pick(v):
    header = F.expr("element_at(array('tw,en;q=0.8', 'fr;q=0.3, en-GH;q=0.9,tw', 'en;q=0, ga ;q=0.5'), cast(event_id % 3 + 1 as int))")
    own = v.table("events").select("event_id", header.alias("header"))
    return own.withColumn("languages", F.array_join(x.languages(F.col("header")), " "))


@query("content_terms", f"with {MSG} select event_id, array_to_string(list_filter([{', '.join(repr(w) for w in sorted(c.SCAM_WORDS))}], lambda w: contains(lower(body), w))[1:5], ',') terms from msg")
def content_terms(v):
    return messages(v).select("event_id", F.array_join(x.content_terms(F.col("body"), c.SCAM_WORDS), ",").alias("terms"))


@query("feat_rcs", f"select event_id, sender, coalesce(max((event_id % 9 = 0)::int) over (partition by sender order by ts_ms range between {DAY_LAB} preceding and current row) = 1, false) rcs_verified_recent from sms")
def feat_rcs(v):
    return x.recent_trust(v.sms.withColumn("rcs_verified", F.expr("event_id % 9 = 0")), DAY_LAB).select("event_id", "sender", "rcs_verified_recent")


@query("call_sessions", """with r as (select caller, ts_ms, case when ts_ms - lag(ts_ms) over (partition by caller order by ts_ms) <= 86400000 then 0 else 1 end s from voice),
    n as (select caller, ts_ms, sum(s) over (partition by caller order by ts_ms) run from r) select caller, min(ts_ms) first_ms, max(ts_ms) last_ms, count(*) n from n group by caller, run""")
def call_sessions(v):
    return x.sessions(v.voice, "caller", 86_400_000)
