"""Vendor records to canonical events: kinds, keys, ids, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vendor kinds and what they are called here.
VOICE_KINDS = {"CALL_START": "call_start", "CALL_END": "call_end", "REGISTRATION": "registration", "REGISTER": "registration", "HANDOVER": "handover", "HANDOFF": "handover"}
MOMO_KINDS = {
    "P2P": "p2p_transfer", "P2P_TRANSFER": "p2p_transfer", "DEPOSIT": "cash_in", "CASH_IN": "cash_in", "WITHDRAWAL": "cash_out", "CASH_OUT": "cash_out",
    "BILL": "bill_payment", "MERCHANT": "merchant_payment", "BANK_TRANSFER": "bank_transfer", "INTL_REMIT": "international_remittance", "REVERSAL": "reversal",
}


def kind(value: Column, names: dict[str, str]) -> Column:
    """The canonical kind, whatever the case; null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.upper(F.trim(value)))


def event_id(prefix: str, vendor_id: Column, *natural: Column) -> Column:
    """The vendor's id, 32 characters of it, else a digest of the natural key in which nulls are empty."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in natural])
    own = F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key, 256), 1, 24))
    return F.when(F.coalesce(vendor_id, F.lit("")) != "", F.substring(vendor_id, 1, 32)).otherwise(own)


def truthy(*values: Column) -> Column:
    """Whether the first of the fields that is there says yes."""
    return F.coalesce(F.lower(F.coalesce(*values)).isin("true", "1", "yes"), F.lit(False))


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): the latter as base64 of their JSON with the reason's place kept open."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).select(F.base64(F.to_json(F.struct("*")).cast("binary")).alias("value"), F.lit("invalid").alias("reason"))


def dead_letter_topic(topic: str) -> str:
    """'.dlq' goes before the version: a.v1 -> a.dlq.v1."""
    name, _, version = topic.rpartition(".")
    return f"{name}.dlq.{version}" if name else f"{topic}.dlq"


def msisdn(value: Column) -> Column:
    """Ghanaian numbers in their international form; others must be + and 8 to 15 digits; else null."""
    v = F.regexp_replace(F.trim(value), r"[\s()-]", "")
    return F.when(v.rlike(r"^0[0-9]{9}$"), F.concat(F.lit("+233"), F.substring(v, 2, 9))).when(v.rlike(r"^\+[0-9]{8,15}$"), v)


def voice(raw: DataFrame) -> DataFrame:
    """raw: vendor_id, event_type, caller, callee, ts_ms, imei."""
    given = F.when(F.coalesce("vendor_id", F.lit("")) != "", F.concat(F.lit("voice_"), F.substring("vendor_id", 1, 32)))
    derived = event_id("voice", F.lit(None).cast("string"), F.col("caller"), F.col("callee"), F.col("event_type"), F.col("ts_ms"))
    return raw.select(F.coalesce(given, derived).alias("event_id"), kind(F.col("event_type"), VOICE_KINDS).alias("kind"), "caller", "callee", "ts_ms", "imei", F.col("caller").alias("partition_key"))


def momo(raw: DataFrame) -> DataFrame:
    """raw: vendor_id, event_type, txn_id, sender, recipient, amount_minor, currency, counterparty, ts_ms."""
    return raw.select(
        event_id("momo", F.col("vendor_id"), F.col("txn_id"), F.col("event_type"), F.col("ts_ms")).alias("event_id"), kind(F.col("event_type"), MOMO_KINDS).alias("kind"), "sender", "recipient", "amount_minor",
        F.upper("currency").alias("currency"), F.lower("counterparty").alias("counterparty_kind"), "ts_ms", F.coalesce("sender", "recipient", "txn_id").alias("partition_key"),
    )
