"""Smaller functions: stable uuids, addresses, languages by preference, content contributions, recent trust."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the DNS namespace of version-5 uuids.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 uuid of a name, from its SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


@F.pandas_udf(T.StringType())
def canonical_ip(value: pd.Series) -> pd.Series:
    """IPv4 and IPv6 addresses in their shortest form; null for anything else."""

    def one(x):
        try:
            return str(ipaddress.ip_address(x.strip()))
        except (ValueError, AttributeError):
            return None

    return value.map(one)


def languages(header: Column) -> Column:
    """The languages of an Accept-Language header, the preferred first (ties in their order); those with q=0 are left out."""

    def rated(p, i):
        q = F.coalesce(F.nullif(F.regexp_extract(p, r"q=([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0))
        return F.struct((-q).alias("order"), i.alias("place"), F.lower(F.trim(F.substring_index(p, ";", 1))).alias("name"))

    parts = F.filter(F.transform(F.split(header, ","), rated), lambda x: (x["order"] < 0) & (x["name"] != ""))
    return F.transform(F.array_sort(parts), lambda x: x["name"])


def content_terms(body: Column, words: list[str], most: int = 5) -> Column:
    """The first scam words of a text, in alphabetical order."""
    return F.slice(F.filter(F.array(*[F.lit(w) for w in sorted(words)]), lambda w: F.contains(F.lower(body), w)), 1, most)


def recent_trust(sms: DataFrame, within: int = 86_400_000) -> DataFrame:
    """sms with rcs_verified_recent: whether the sender has had a verified message within the closed window."""
    w = Window.partitionBy("sender").orderBy("ts_ms").rangeBetween(-within, 0)
    return sms.withColumn("rcs_verified_recent", F.coalesce(F.max(F.col("rcs_verified").cast("int")).over(w) == 1, F.lit(False)))


def sessions(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Runs of a key's events that are at most gap_ms apart: key, first_ms, last_ms, n. (An extra: batch and stream.)"""
    w = Window.partitionBy(key).orderBy("ts_ms")
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n")).drop("run")


def review_fields(report: DataFrame) -> Column:
    """How many fields of a report row ask for review."""
    return F.size(F.filter(F.array(*[F.col(c).cast("string") for c in report.columns]), lambda x: F.coalesce(x, F.lit("")).startswith("[REVIEW"))).cast("long")
