"""Flagged URLs feed the block list that the same stream reads: what one batch flags is blocked from the next on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.content import canonical, domain_of, listed, suffixes, valid_domain
from tidewatch.sources.keyed import KeyedTable

ENTRY = "domain string, source string, category string, confidence double, ts_ms long, expires_ms long"


def block_list(spark: SparkSession, path: str, buckets: int = 16, keep: int = 10) -> KeyedTable:
    return KeyedTable(spark, path, ("domain",), "ts_ms", buckets, keep)


def url_of(signals: DataFrame) -> Column:
    """The URL that a signal is about: its url_match, else its subject if that is a URL; null for signals without 'url'."""
    about = F.lower("signal_kind").contains("url") | (F.col("subject_kind") == "url")
    match = F.nullif(F.try_element_at("evidence", F.lit("url_match")), F.lit(""))
    return F.when(about, F.coalesce(match, F.when(F.col("subject_kind") == "url", F.col("subject_id"))))


def entries(signals: DataFrame, allowed: DataFrame, ttl_ms: int) -> DataFrame:
    """Block-list entries of signals, with reason: added, allow_listed, invalid_domain; signals without a URL give none.

    signals: signal_kind, subject_kind, subject_id, evidence (map), score, ts_ms. allowed: domain; what is below one is
    allowed as well. An entry lasts ttl_ms from its signal.
    """
    url = url_of(signals)
    own = signals.withColumn("url", url).where("url is not null").withColumn("domain", canonical(F.coalesce(F.nullif(domain_of(F.col("url")), F.lit("")), F.col("url"))))
    own = listed(own, "domain", allowed)
    reason = F.when(~valid_domain(F.col("domain")), "invalid_domain").when(F.col("listed").isNotNull(), "allow_listed").otherwise("added")
    category = F.coalesce(F.try_element_at("evidence", F.lit("url_category")), F.lit("phishing"))
    return own.select(
        "domain", F.concat(F.lit("signals:"), F.col("signal_kind")).alias("source"), category.alias("category"), F.col("score").cast("double").alias("confidence"),
        F.col("ts_ms").cast("long").alias("ts_ms"), (F.col("ts_ms") + ttl_ms).cast("long").alias("expires_ms"), reason.alias("reason"),
    )


def blocked(events: DataFrame, held: DataFrame | None) -> DataFrame:
    """events (domain, ts_ms) with blocked_by: the entry, of the domain or one above it, that is in force; the longest counts."""
    if held is None:
        return events.withColumn("blocked_by", F.lit(None).cast("string"))
    names = events.select("domain").where("domain is not null").distinct()
    above = names.select("domain", F.explode(suffixes(F.col("domain"))).alias("d"))
    entry = F.struct(F.length("d").alias("n"), "d", "since", "expires_ms")
    live = held.select(F.col("domain").alias("d"), F.col("ts_ms").alias("since"), "expires_ms")
    # the table has one entry for a domain, so the list is as long as the domain has labels at most
    hit = above.join(live, "d").groupBy("domain").agg(F.collect_list(entry).alias("_entries"))
    force = F.filter("_entries", lambda e: (F.col("ts_ms") >= e["since"]) & (F.col("ts_ms") < e["expires_ms"]))
    return events.join(hit, "domain", "left").withColumn("blocked_by", F.array_max(force)["d"]).drop("_entries")


def feedback_stream(events: DataFrame, classify, allowed: DataFrame, table: KeyedTable, out: str, checkpoint: str, ttl_ms: int = 7 * 86_400_000):
    """A writer that blocks the events of each batch by the list as the batch before left it, then adds what the batch flags.

    classify(events) gives signals. Batch n reads the version below n and publishes n; a batch that is run again after a
    failure reads the same version, so its results are the same, and a batch that has been published adds nothing more.
    Verdicts are written to out/batch=<n>, again for a batch that is repeated.
    """

    def step(df: DataFrame, batch: int) -> None:
        held = table.read(before=batch)
        blocked(df, held).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        table.upsert(entries(classify(df), allowed, ttl_ms).where("reason = 'added'").drop("reason"), batch)
        table.clean()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
