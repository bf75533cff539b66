"""Queries without SQL: communities and learned scorers, over the whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import communities as c
from tidewatch.operators import learned as m
from tidewatch.plans.base import query
from tidewatch.plans.scoring import wallets

NAMES = ["txn_velocity_1h", "counterparty_diversity_24h", "value_p95_24h"]


@query("communities")
def communities(v):
    return c.communities(v.sent)


@query("cohesion")
def cohesion(v):
    return c.cohesion(v.sent, c.communities(v.sent))


def held_out(key: str):
    """A fifth of the keys, by their crc32, is not learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


@query("ml_wallets")
def ml_wallets(v):
    """Whether a wallet sends a large amount within a day from now on, learned from its features by four fifths of the
    wallets; held_out marks the rest."""
    later = Window.partitionBy("wallet_id").orderBy("ts_ms").rangeBetween(1, 86_400_000)
    large = v.momo.select(F.col("event_id"), "amount_minor")
    own = wallets(v).join(large, "event_id").withColumn("label", F.coalesce(F.max("amount_minor").over(later) > 10_000, F.lit(False)).cast("int"))
    model = m.fit_features(own.where(~held_out("wallet_id")), NAMES)
    return m.score_features(own, model, NAMES).select("wallet_id", "event_id", held_out("wallet_id").alias("held_out"), "rule_score", "score", "signal_kind", "severity")


@query("ml_texts")
def ml_texts(v):
    """Whether a text is toxic, learned by four fifths of the labelled documents; held_out marks the rest."""
    own = v.table("documents").join(v.table("labels"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").alias("label"), F.lit(0.0).alias("rule_score"))
    return m.score_text(own, m.fit_text(own.where(~held_out("doc_id")))).select("doc_id", held_out("doc_id").alias("held_out"), "score", "severity")
