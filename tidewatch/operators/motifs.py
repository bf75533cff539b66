"""Temporal motifs over typed edges. All interval joins have an equi key; the range stands beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def first_match(left: DataFrame, right: DataFrame, keys: dict[str, str], at: str, time: str, within: int, tie: str, take: list[str], strict: bool = True) -> DataFrame:
    """left with `take` of its earliest match in right: equal keys (left column -> right column), `time` behind `at`.

    time is in (at, at + within], or, if not strict, in [at, at + within]; of equal times the smallest `tie` counts. Both
    sides are one stream of a key, read from its end: each left row takes the right row read last, so no pairs are made
    and a busy key costs its rows once, sorted with spill. Rows with a null key or time match nothing.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    here, there = (F.struct(*left.columns), F.struct(*dict.fromkeys([time, tie, *take])))
    null = lambda df, col: F.lit(None).cast(df.select(col).schema[0].dataType)
    a = left.select(*[F.col(c).alias(k) for c, k in zip(keys, own)], F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), null(right, F.col(tie)).alias("_tie"), here.alias("_l"), null(right, there).alias("_r"))
    b = right.select(*[F.col(c).alias(k) for c, k in zip(keys.values(), own)], F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie"), null(left, here).alias("_l"), there.alias("_r"))
    both = a.unionByName(b).dropna(subset=[*own, "_t"])
    read = Window.partitionBy(*own).orderBy(F.desc("_t"), "_side", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(read)).where(F.col("_l").isNotNull() & (F.col(f"_m.{time}") <= F.col("_t") + within))
    return out.select("_l.*", *[f"_m.{c}" for c in take])


def voice_sms_momo(calls: DataFrame, sms: DataFrame, owns: DataFrame, sent: DataFrame, sms_within: int = HOUR, send_within: int = DAY) -> DataFrame:
    """call, then the earliest SMS caller -> callee in (0, sms_within], then the earliest send of a wallet of the callee.

    One row for each (call, wallet). There is no going back to a later SMS if the earliest leads nowhere.
    """
    c = calls.select(F.col("event_id").alias("call_id"), "caller", "callee", F.col("ts_ms").alias("call_ms"))
    s = sms.select("sender", "recipient", F.col("ts_ms").alias("sms_ms"), F.col("event_id").alias("sms_id"))
    texted = first_match(c, s, {"caller": "sender", "callee": "recipient"}, "call_ms", "sms_ms", sms_within, "sms_id", ["sms_ms"])
    owned = texted.join(owns, F.col("callee") == F.col("number")).drop("number")
    p = sent.select(F.col("src").alias("payer"), F.col("ts_ms").alias("send_ms"), F.col("edge_id").alias("send_id"), F.col("dst").alias("payee"))
    paid = first_match(owned, p, {"wallet": "payer"}, "sms_ms", "send_ms", send_within, "send_id", ["send_ms", "payee"])
    return paid.select("call_id", "caller", "callee", "wallet", "payee", F.expr("(sms_ms - call_ms) div 1000").alias("sms_lag_s"), F.expr("(send_ms - sms_ms) div 1000").alias("send_lag_s"), F.lit(0.9).alias("confidence"))


def voice_then_momo(calls: DataFrame, owns: DataFrame, sent: DataFrame, within: int = 30 * MINUTE) -> DataFrame:
    """call, then the earliest send in [0, within] from a wallet of the caller to one of the callee.

    One row for each (call, wallet of the caller), with the wallet of the callee that is sent to first.
    """
    c = calls.select(F.col("event_id").alias("call_id"), "caller", "callee", F.col("ts_ms").alias("call_ms"))
    mine = owns.select(F.col("number").alias("caller"), F.col("wallet").alias("caller_wallet"))
    theirs = owns.select(F.col("number").alias("callee"), F.col("wallet").alias("callee_wallet"))
    both = c.join(mine, "caller").join(theirs, "callee")
    p = sent.select("src", "dst", F.col("ts_ms").alias("send_ms"), F.col("edge_id").alias("send_id"))
    paid = first_match(both, p, {"caller_wallet": "src", "callee_wallet": "dst"}, "call_ms", "send_ms", within, "send_id", ["send_ms", "send_id"], strict=False)
    rest = ["caller", "callee", "callee_wallet", "call_ms", "send_ms"]
    paid = paid.groupBy("call_id", "caller_wallet").agg(F.min_by(F.struct(*rest), F.struct("send_ms", "send_id")).alias("x")).select("call_id", "caller_wallet", "x.*")
    return paid.select("call_id", "caller", "callee", "caller_wallet", "callee_wallet", F.expr("(send_ms - call_ms) div 1000").alias("lag_s"), F.lit(0.92).alias("confidence"))


def sms_url(sms: DataFrame, data: DataFrame, flagged: DataFrame, within: int = HOUR) -> DataFrame:
    """SMS, then the recipient's earliest query of a flagged domain in (0, within]. Nothing flagged: no rows."""
    q = data.where("kind = 'dns_query' and msisdn is not null").join(flagged.select("domain").distinct(), "domain", "left_semi")
    q = q.select("msisdn", "domain", F.col("ts_ms").alias("query_ms"), F.col("event_id").alias("query_id"))
    s = sms.select(F.col("event_id").alias("sms_id"), "sender", "recipient", F.col("ts_ms").alias("sms_ms"))
    hit = first_match(s, q, {"recipient": "msisdn"}, "sms_ms", "query_ms", within, "query_id", ["query_ms", "domain"])
    return hit.select("sms_id", "sender", "recipient", "domain", F.expr("(query_ms - sms_ms) div 1000").alias("lag_s"), F.lit(0.94).alias("confidence"))


def device_fusion(used: DataFrame, owns: DataFrame, sent: DataFrame, least: int = 2, active: bool = True) -> DataFrame:
    """Devices of at least `least` numbers whose wallets send: device, numbers, wallets, confidence."""
    pairs = used.select("imei", F.col("caller").alias("number")).distinct()
    wallets = pairs.join(owns, "number")
    if active:
        wallets = wallets.join(sent.select(F.col("src").alias("wallet")).distinct(), "wallet", "left_semi")
    numbers = pairs.groupBy("imei").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("number")).alias("numbers")).where(F.col("n") >= least)
    own = wallets.groupBy("imei").agg(F.array_sort(F.collect_set("wallet")).alias("wallets"))
    return numbers.join(own, "imei").select("imei", F.array_join("numbers", ",").alias("numbers"), F.array_join("wallets", ",").alias("wallets"), F.round(F.least(F.lit(0.95), 0.7 + 0.05 * (F.col("n") - 2)), 6).alias("confidence"))


def sim_carousel(used: DataFrame, least: int = 3) -> DataFrame:
    """Devices with at least `least` distinct numbers."""
    out = used.where("imei is not null").groupBy("imei").agg(F.array_sort(F.collect_set("caller")).alias("numbers")).where(F.size("numbers") >= least)
    return out.select("imei", F.array_join("numbers", ",").alias("numbers"), F.size("numbers").alias("n_numbers"), F.round(F.least(F.lit(0.95), 0.55 + 0.1 * (F.size("numbers") - 3)), 6).alias("confidence"))


def bust_out(edges: DataFrame, burst: int = DAY, dormant: int = 31 * DAY, least: int = 5, amount: int = 100_000, quiet: int = 3) -> DataFrame:
    """Wallets quiet for long that burst at the end: two aggregations, the latest time and the counts around it."""
    last = edges.groupBy("src").agg(F.max("ts_ms").alias("last_ms"))
    own = edges.join(last, "src").withColumn("hot", F.expr(f"ts_ms >= last_ms - {burst}"))
    out = own.groupBy("src").agg(F.count_if("hot").alias("burst_count"), F.sum(F.when(F.col("hot"), F.col("amount_minor")).otherwise(0)).alias("burst_amount"), F.count_if(F.expr(f"not hot and ts_ms >= last_ms - {dormant}")).alias("dormant_count"))
    return out.where((F.col("burst_count") >= least) & (F.col("burst_amount") >= amount) & (F.col("dormant_count") <= quiet))


def mule_chains(sent: DataFrame, least: int = 3, most: int = 6, within: int = DAY) -> DataFrame:
    """Distinct simple paths of least..most wallets whose hops follow each other by at most `within` ms.

    Each round is an equi join on the last wallet with the time range beside it; paths that share wallets and last time
    are merged before they grow. total_amount_minor takes the first edge of each pair of wallets.
    """
    hop = sent.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ts_ms").alias("t"))
    path = hop.where("a <> b").select(F.array("a", "b").alias("path"), F.col("t").alias("last")).distinct()
    found = []
    for n in range(2, most + 1):
        if n >= least:
            found.append(path.select("path").distinct())
        if n < most:
            ends = path.withColumn("tail", F.element_at("path", -1))
            path = ends.join(hop, F.expr(f"tail = a and t >= last and t - last <= {within} and not array_contains(path, b)"))
            path = path.select(F.array_append("path", F.col("b")).alias("path"), F.col("t").alias("last")).distinct()
    chains = reduce(DataFrame.unionByName, found)
    first = sent.groupBy("src", "dst").agg(F.min_by("amount_minor", F.struct("ts_ms", "edge_id")).alias("amount"))
    legs = chains.select("path", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("x"), F.slice("path", F.lit(2), F.size("path") - 1).alias("y"))).alias("leg"))
    total = legs.join(first, F.expr("leg.x = src and leg.y = dst")).groupBy("path").agg(F.sum("amount").alias("total_amount_minor"))
    return total.select(F.array_join("path", ">").alias("chain"), F.size("path").alias("length"), "total_amount_minor", F.round(F.least(F.lit(0.95), 0.6 + 0.1 * (F.size("path") - least)), 6).alias("confidence"))
