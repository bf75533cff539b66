"""Sinks: partitioned archive with a manifest, dead letters, idempotent appends, keyed upserts, NDJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.keyed import BUCKETS, KeyedTable, maybe


ARCHIVED = "year int, month int, part string, n long, first_ms long, last_ms long"


def archive(audit: DataFrame, path: str, batch: int, lookup: tuple[str, ...] = ("request_id", "subject_id")) -> DataFrame:
    """Write audit rows (event_ts_ms) as zstd Parquet by year and month; returns the manifest, which gets the batch's months.

    A month's rows of a batch are the folder of a digest of their contents, so a batch that is written again takes the same
    place and is in the manifest once. Files are sorted by time; the columns of lookup, where there, get bloom filters, so
    a search by one of them reads the row groups that may have it. Neither rows nor the manifest are read again as a whole.
    """
    own = audit.withColumn("at", F.timestamp_millis("event_ts_ms")).withColumns({"year": F.year("at"), "month": F.month("at"), "_h": F.xxhash64(*audit.columns)}).drop("at")
    own = own.persist()
    try:
        mixed = F.bit_xor(F.xxhash64("_h", F.lit(1)))
        months = own.groupBy("year", "month").agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.col("_h").cast("decimal(20,0)")), mixed), 256).alias("part"), F.count("*").alias("n"), F.min("event_ts_ms").alias("first_ms"), F.max("event_ts_ms").alias("last_ms"))
        months = audit.sparkSession.createDataFrame(months.withColumn("part", F.substring("part", 1, 12)).collect(), ARCHIVED)  # one row for a month
        rows = own.drop("_h").join(F.broadcast(months.select("year", "month", "part")), ["year", "month"])
        # a busy month is as many tasks as it has ranges of time
        out = rows.repartitionByRange("year", "month", "event_ts_ms").sortWithinPartitions("year", "month", "event_ts_ms").write.partitionBy("year", "month", "part")
        out = out.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", 8 << 20)
        for c in lookup:
            if c in audit.columns:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", 100_000)
        out.mode("overwrite").parquet(f"{path}/rows")
        table = KeyedTable(audit.sparkSession, f"{path}/months", ("year", "month", "part"), "last_ms", 1)
        table.upsert(months, batch)
    finally:
        own.unpersist()
    return table.read()


def archived(spark, path: str) -> DataFrame:
    """The archive's rows; filters on year and month prune folders, those on lookup columns row groups."""
    return spark.read.parquet(f"{path}/rows")


def audit_by(spark, path: str, column: str, value, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Rows of the archive with a value, oldest first. The manifest tells which months can have the times asked for."""
    months = KeyedTable(spark, f"{path}/months", ("year", "month", "part"), "last_ms", 1).read()
    low, high = F.lit(since_ms if since_ms is not None else -(2**62)), F.lit(until_ms if until_ms is not None else 2**62)
    parts = [r["part"] for r in months.where((F.col("last_ms") >= low) & (F.col("first_ms") < high)).select("part").distinct().collect()]
    own = archived(spark, path).where(F.col("part").isin(parts) & (F.col(column) == value) & (F.col("event_ts_ms") >= low) & (F.col("event_ts_ms") < high))
    return own.orderBy("event_ts_ms")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not there yet; rows that repeat a key are written once."""
    fresh, have = rows.dropDuplicates([key]), maybe(rows.sparkSession, path)
    if have is not None:
        fresh = fresh.join(have.select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def upsert_latest(rows: DataFrame, path: str, keys: list[str], version: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Keep the latest row of each key: only the buckets of the batch's keys are written, older data is cleaned up."""
    table = KeyedTable(rows.sparkSession, path, tuple(keys), version, buckets)
    table.upsert(rows, batch_id)
    table.clean()


def latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table, or the newest before a batch."""
    return KeyedTable(spark, path, (), "").read(before)


def alive(table: DataFrame, now_ms: int, ttl_ms: int = 86_400_000, ts: str = "ts_ms") -> DataFrame:
    """Rows whose time to live has not run out."""
    return table.where(F.col(ts) + ttl_ms > now_ms)


def ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
