"""Telecom tables as views over the given star schema and event stream.

Every view is a plain projection, so filters and columns reach the Parquet scan. All windows work on ts_ms (BIGINT).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """event_id, ts_ms, user_id, event_type, cents, k, n_users."""
        raw = self.table("events")
        users = raw.select((F.max("user_id") + 1).alias("n")).scalar()
        return raw.select(
            "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"), "user_id", "event_type",
            F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"), users.alias("n_users"),
        )

    @property
    def _peer(self) -> Column:
        return F.expr("(user_id + 1 + k % 3) % n_users").cast("string")

    @property
    def _me(self) -> Column:
        return F.col("user_id").cast("string")

    @cached_property
    def voice(self) -> DataFrame:
        return self.events.where("event_type in ('view', 'error')").select(
            "event_id", "ts_ms", F.expr("concat('T', user_id % 5)").alias("tenant_id"), F.concat(F.lit("N"), self._me).alias("caller"), F.concat(F.lit("N"), self._peer).alias("callee"),
            F.expr("if(k % 10 < 8, 'call_start', 'call_end')").alias("kind"), F.expr("cents div 100").alias("duration_s"),
            F.expr("lpad(cast(if(k % 2 = 0, user_id div 4, user_id) as string), 15, '3')").alias("imei"),
        )

    @cached_property
    def sms(self) -> DataFrame:
        return self.sms_with()

    def sms_with(self, **more: Column) -> DataFrame:
        """sms with further columns that are worked out once for each document, not for each message."""
        docs = self.table("documents")
        n = docs.select(F.count("*")).scalar()
        bodies = docs.select("doc_id", F.col("text").alias("body"), F.sha2(F.concat("lang", "source"), 256).alias("template_hash"), *[x.alias(k) for k, x in more.items()])
        own = self.events.where("event_type in ('signup', 'click')").withColumn("doc_id", F.col("event_id") % n)
        return own.join(bodies, "doc_id", "left").select(
            "event_id", "ts_ms", F.expr("concat('T', user_id % 5)").alias("tenant_id"), F.concat(F.lit("N"), self._me).alias("sender"), F.concat(F.lit("N"), self._peer).alias("recipient"),
            F.expr("if(k % 10 = 0, 'mo', 'mt')").alias("kind"), "body", "template_hash", F.expr("if(k % 7 = 0, 'BANK', null)").alias("short_code"), *more,
        )

    @cached_property
    def momo(self) -> DataFrame:
        kind = "case k % 10 when 0 then 'cash_in' when 1 then 'cash_out' when 2 then 'reversal' else 'p2p_transfer' end"
        return self.events.where("event_type in ('purchase', 'click')").select(
            "event_id", "ts_ms", F.expr("concat('T', user_id % 5)").alias("tenant_id"), F.concat(F.lit("W"), self._me).alias("sender_wallet"),
            F.when(F.expr("k % 10 <> 3"), F.concat(F.lit("W"), self._peer)).alias("recipient_wallet"), F.concat(F.lit("N"), self._me).alias("sender_msisdn"),
            F.when(F.expr("k % 10 <> 3"), F.concat(F.lit("N"), self._peer)).alias("recipient_msisdn"), F.col("cents").alias("amount_minor"),
            F.expr(kind).alias("kind"), F.expr("if(k % 4 = 0, 'agent', 'app')").alias("channel"), F.expr("if(k % 10 = 3, 'bank', 'wallet')").alias("counterparty_kind"),
            F.expr("if(k % 10 = 3, concat('A', k), null)").alias("account_hash"),
        )

    @cached_property
    def data(self) -> DataFrame:
        pages = self.table("pages")
        n = pages.select(F.count("*")).scalar()
        hosts = pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("domain"))
        own = self.events.where("event_type = 'error'").withColumn("page_id", F.col("event_id") % n)
        return own.join(hosts, "page_id", "left").select(
            "event_id", "ts_ms", F.expr("concat('T', user_id % 5)").alias("tenant_id"), F.when(F.expr("k % 20 <> 0"), F.concat(F.lit("N"), self._me)).alias("msisdn"),
            F.expr("case k % 5 when 0 then 'ipdr_session' when 1 then 'dns_response' else 'dns_query' end").alias("kind"), "domain",
            F.expr("if(k % 5 = 1, concat(k, '.', user_id % 256, '.7.1'), null)").alias("rdata"), F.col("cents").alias("bytes_up"), (F.col("cents") * 10).alias("bytes_down"),
        )

    @cached_property
    def owns(self) -> DataFrame:
        return self.events.select(F.concat(F.lit("N"), self._me).alias("number"), F.concat(F.lit("W"), self._me).alias("wallet")).distinct()

    @cached_property
    def sent(self) -> DataFrame:
        """Wallet to wallet edges: all kinds but reversal and cash_in."""
        own = self.momo.where("recipient_wallet is not null and kind not in ('reversal', 'cash_in')")
        return own.select(F.col("event_id").alias("edge_id"), F.col("sender_wallet").alias("src"), F.col("recipient_wallet").alias("dst"), "ts_ms", "amount_minor")

    @cached_property
    def alerts(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("subject_id"), F.expr("concat('T', o_custkey % 5)").alias("tenant_id"),
            F.expr("case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end").alias("severity"),
            F.expr("case o_orderstatus when 'O' then 'new' when 'P' then 'claimed' else 'closed' end").alias("status"),
            F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 600000, 3)).alias("score"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000").alias("created_ms"),
            F.expr("""if(o_orderkey % 3 = 0, concat('{"motif":"', element_at(array('mule_chain', 'bust_out', 'sim_carousel', 'voice_sms_momo_24h'), cast(o_orderkey % 4 + 1 as int)),
                '","peers":["P', o_orderkey % 4, '"]}'), '{}')""").alias("details"),
        )

    @cached_property
    def subscribers(self) -> DataFrame:
        return self.table("customer").select(F.expr("concat('T', c_nationkey % 5)").alias("tenant_id"), F.lit("number").alias("kind"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("id"), F.expr("concat('O', c_nationkey % 3)").alias("opco"))

    @cached_property
    def businesses(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("msisdn"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("verified"),
            F.expr("if(s_suppkey % 4 = 0, 'bank', null)").alias("short_code"),
        )
