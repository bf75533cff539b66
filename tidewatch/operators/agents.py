"""Detectors over an agent's transactions, their composite and the agent's profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A transaction: agent, counterparty, kind, counterparty_kind, amount_minor, ts_ms, event_id.


def _capped(base: float, step: float, over: Column, cap: float) -> Column:
    return F.round(F.least(F.lit(cap), base + step * over), 6)


def commission_farming(txns: DataFrame, least: int = 5, within: int = 600_000) -> DataFrame:
    """Cash-ins followed at once by a cash-out of the same counterparty within ten minutes; `least` cycles fire."""
    w = Window.partitionBy("agent", "counterparty").orderBy("ts_ms", "event_id")
    own = txns.where("kind in ('cash_in', 'cash_out') and counterparty is not null").withColumns({"next": F.lead(F.struct("kind", "ts_ms", "amount_minor")).over(w)})
    cycle = own.where(f"kind = 'cash_in' and next.kind = 'cash_out' and next.ts_ms > ts_ms and next.ts_ms - ts_ms <= {within}")
    out = cycle.groupBy("agent").agg(F.count("*").alias("cycles"), F.sum(F.col("amount_minor") + F.col("next.amount_minor")).alias("cycle_amount_minor")).where(F.col("cycles") >= least)
    return out.withColumn("score", _capped(0.6, 0.05, F.col("cycles") - least, 0.99))


def split_transactions(txns: DataFrame, threshold: int = 1_000_000, piece: int = 200_000, least: int = 3) -> DataFrame:
    """Many small pieces to one counterparty that add up; of an agent the counterparty with the most (ties: first seen)."""
    own = txns.where(f"kind in ('cash_out', 'p2p_transfer') and counterparty is not null and amount_minor < {piece}")
    own = own.groupBy("agent", "counterparty").agg(F.count("*").alias("pieces"), F.sum("amount_minor").alias("total_minor"), F.min(F.struct("ts_ms", "event_id")).alias("first")).where(f"pieces >= {least} and total_minor >= {threshold}")
    best = own.groupBy("agent").agg(F.min_by(F.struct("counterparty", "pieces", "total_minor"), F.struct(-F.col("pieces"), "first")).alias("b")).select("agent", "b.*")
    return best.withColumn("score", _capped(0.7, 0.03, F.col("pieces") - least, 0.95))


def phantom_customers(txns: DataFrame, history: DataFrame, least: int = 3) -> DataFrame:
    """Counterparties of an agent that nobody has seen before: history has counterparty, prior."""
    pairs = txns.where("counterparty is not null").select("agent", "counterparty").distinct().join(history, "counterparty", "left")
    out = pairs.groupBy("agent").agg(F.count_if(F.coalesce("prior", F.lit(0)) <= 0).alias("phantoms"), F.count("*").alias("counterparties")).where(F.col("phantoms") >= least)
    ratio = F.col("phantoms") / F.col("counterparties")
    return out.withColumns({"ratio": F.round(ratio, 3), "score": _capped(0.55, 0.05, F.col("phantoms"), 0.95), "severity": F.when(ratio > 0.6, "high").otherwise("medium")})


def collusion(agents: DataFrame, cohorts: DataFrame, least: int = 2) -> DataFrame:
    """Agents in a cohort (agent, cohort, size, devices, sequential) of at least `least`."""
    own = agents.join(cohorts, "agent").where(F.col("size") >= least)
    score = 0.55 + 0.07 * (F.col("size") - least) + 0.05 * F.col("devices") + 0.04 * F.least(F.lit(10), F.col("sequential"))
    return own.withColumn("score", F.round(F.least(F.lit(0.95), score), 6))


def float_manipulation(txns: DataFrame, excess: int = 50_000_000, moves: int = 4) -> DataFrame:
    """Net inflow of an agent beyond `excess`, or `moves` transfers to other agents."""
    amount = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount_minor")).otherwise(0))
    out = txns.groupBy("agent").agg((amount("cash_in") - amount("cash_out")).alias("net_float_minor"), F.count_if(F.expr("kind in ('p2p_transfer', 'bank_transfer') and counterparty_kind = 'agent'")).alias("internal_moves"))
    big, busy = F.col("net_float_minor") >= excess, F.col("internal_moves") >= moves
    parts = F.when(big, F.least(F.lit(0.45), 0.3 + 0.05 * (F.col("net_float_minor") / excess - 1))).otherwise(0.0) + F.when(busy, F.least(F.lit(0.45), 0.3 + 0.03 * (F.col("internal_moves") - moves))).otherwise(0.0)
    return out.where(big | busy).withColumn("score", F.round(F.least(F.lit(0.95), 0.4 + parts), 6))


def composite(detections: list[DataFrame]) -> DataFrame:
    """agent, composite: 1 - product(1 - score) of all its detections."""
    every = reduce(DataFrame.unionByName, [d.select("agent", "score") for d in detections])
    return every.groupBy("agent").agg(F.round(1 - F.product(1 - F.col("score")), 3).alias("composite"), F.count("*").alias("detections"))


def profile(detections: DataFrame, decay: float = 0.1) -> DataFrame:
    """agent, risk: the fold of its detections (agent, ts_ms, score, event_id) in time, decaying by the hour.

    risk = max(score, risk * max(0, 1 - hours * decay)), which is the greatest score times the product of the factors after
    it. A running sum of their logarithms gives each product, and a factor of 0 starts a new run that forgets what was
    before it; so running windows and groupings do, and no list of an agent's detections is held.
    """
    w = Window.partitionBy("agent").orderBy("ts_ms", "event_id", "score")
    factor = F.greatest(F.lit(0.0), 1 - F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w)) / 3_600_000, F.lit(0.0)) * decay)
    steps = detections.select("agent", "score", F.row_number().over(w).alias("n"), factor.alias("factor"))
    by = Window.partitionBy("agent").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.coalesce(F.sum(F.when(F.col("factor") > 0, F.ln("factor"))).over(by), F.lit(0.0))
    runs = steps.select("agent", "n", "score", F.count_if(F.col("factor") == 0).over(by).alias("run"), kept.alias("kept"))
    best = F.max(F.when(F.col("score") > 0, F.ln("score") - F.col("kept")))
    last = runs.groupBy("agent", "run").agg(F.max("n").alias("n"), F.max_by("kept", "n").alias("end"), best.alias("best"))
    own = last.groupBy("agent").agg(F.max_by(F.struct("end", "best"), "run").alias("x"), F.max("n").alias("detections"))
    return own.select("agent", F.round(F.coalesce(F.exp(F.col("x.best") + F.col("x.end")), F.lit(0.0)), 6).alias("risk"), F.col("detections").cast("long").alias("detections"))


def pattern_profile(detections: DataFrame, decay: float = 0.1) -> DataFrame:
    """agent, pattern, score, n: the greatest score of each pattern as it has decayed by its agent's last detection.

    detections: agent, pattern, ts_ms, event_id, score. All scores of an agent decay by each of its detections, as in
    profile; a pattern has the greatest of what is left of its own. n counts its detections; without pattern: left out.
    """
    w = Window.partitionBy("agent").orderBy("ts_ms", "event_id", "score")
    factor = F.greatest(F.lit(0.0), 1 - F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w)) / 3_600_000, F.lit(0.0)) * decay)
    steps = detections.select("agent", "pattern", "score", F.row_number().over(w).alias("n"), factor.alias("factor"))
    by = Window.partitionBy("agent").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.coalesce(F.sum(F.when(F.col("factor") > 0, F.ln("factor"))).over(by), F.lit(0.0))
    runs = steps.select("agent", "pattern", "n", "score", F.count_if(F.col("factor") == 0).over(by).alias("run"), kept.alias("kept"))
    end = runs.groupBy("agent").agg(F.max_by(F.struct("run", "kept"), "n").alias("end"))
    alive = F.when((F.col("run") == F.col("end.run")) & (F.col("score") > 0), F.ln("score") - F.col("kept") + F.col("end.kept"))
    out = runs.where("pattern is not null").join(end, "agent").groupBy("agent", "pattern").agg(F.max(alive).alias("best"), F.count("*").alias("n"))
    return out.select("agent", "pattern", F.round(F.coalesce(F.exp("best"), F.lit(0.0)), 6).alias("score"), "n")
