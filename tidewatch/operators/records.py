"""Records between the stages: graph windows, relevance, audit, attribution, reports, federation requests, reload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.graph import identifier_hash

EXTRACTED = ("Number", "Wallet", "Device", "Account")


def extract_window(nodes: DataFrame, edges: DataFrame, since_ms: int, most: int = 5000, kinds: tuple[str, ...] = EXTRACTED) -> DataFrame:
    """Edges since a time that start at one of the first `most` nodes (by kind and id) of the kinds, in their direction."""
    own = nodes.where(F.col("kind").isin(*kinds)).select("kind", "id").distinct().orderBy("kind", "id").limit(most)
    recent = edges.where(F.col("ts_ms") >= since_ms).dropDuplicates(["kind", "src_id", "dst_id", "ts_ms"])
    return recent.join(own.select(F.col("kind").alias("src_kind"), F.col("id").alias("src_id")), ["src_kind", "src_id"], "left_semi")


def agent_of(kind: Column, sender: Column, recipient: Column) -> Column:
    """Whose float a transaction moves: the recipient's for cash-ins and merchant payments, else the sender's."""
    return F.when(kind.isin("cash_in", "merchant_payment"), recipient).otherwise(sender)


def relevant(momo: DataFrame) -> DataFrame:
    """Agent-channel transactions with their agent and counterparty."""
    own = momo.where("channel = 'agent'").withColumn("agent", agent_of(F.col("kind"), F.col("sender_wallet"), F.col("recipient_wallet"))).where("agent is not null")
    other = F.when(F.col("agent") == F.col("sender_wallet"), F.coalesce("recipient_wallet", "account_hash")).otherwise(F.col("sender_wallet"))
    return own.withColumn("counterparty", other)


def to_rescore(mutations: DataFrame) -> DataFrame:
    """Distinct nodes whose upsert asks for a new score."""
    return mutations.where("op = 'upsert_node' and kind in ('Number', 'Wallet', 'Device')").select("kind", "key").distinct()


def url_of(kind: Column, subject_kind: Column, subject_id: Column, evidence: Column) -> Column:
    """The URL that a signal is about, from its evidence, else its subject; null for signals about something else."""
    about = kind.contains("url") | (subject_kind == "url")
    return F.when(about, F.coalesce(F.try_element_at(evidence, F.lit("url_match")), F.when(subject_kind == "url", subject_id)))


def attribution(evidence: Column) -> Column:
    """The numeric entries of an evidence map."""
    numbers = F.transform_values(evidence, lambda k, v: v.try_cast("double"))
    return F.map_filter(numbers, lambda k, v: v.isNotNull())


def audit_record(df: DataFrame, action: str, purpose: str, subject: str, metadata: list[str]) -> DataFrame:
    """One audit row for each row; metadata values as strings, nulls left out. A purpose must be named."""
    if not purpose:
        raise ValueError("no purpose is active")
    own = F.map_filter(F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]), lambda k, v: v.isNotNull())
    return df.select(F.lit(action).alias("action"), F.lit(purpose).alias("purpose"), F.col(subject).cast("string").alias("subject_id"), "tenant_id", F.col("ts_ms").alias("event_ts_ms"), own.alias("metadata"))


def scoped(df: DataFrame, tenant_id: str, purpose: str) -> DataFrame:
    """The only way to personal rows: one tenant's, for a named purpose."""
    if not tenant_id or not purpose:
        raise ValueError("a tenant and a purpose are required")
    return df.where(F.col("tenant_id") == tenant_id)


# Confidence of a report by where it comes from.
CONFIDENCE = {"report": 0.6, "block": 0.5}


def report_events(reports: DataFrame) -> DataFrame:
    """Customer and enterprise reports (source, indicator, given) as intelligence; an enterprise names its own confidence."""
    known = F.try_element_at(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    return reports.withColumn("confidence", F.coalesce(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("given")))))


def federation_lookup(requests: DataFrame, flags: DataFrame, most: int = 500) -> DataFrame:
    """Flags for the hashes of each request; requests with more than `most` hashes are refused, unknown hashes dropped."""
    size = requests.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return requests.join(size.select("request_id"), "request_id", "left_semi").join(flags, "identifier_hash")


def held_motifs(members: DataFrame, motifs: DataFrame) -> DataFrame:
    """ring, motif_id for motifs all of whose members belong to the ring: by counting those that do."""
    size = motifs.groupBy("motif_id").agg(F.count_distinct("id").alias("need"))
    have = motifs.select("motif_id", "id").distinct().join(members, "id").groupBy("motif_id", "ring").agg(F.count("*").alias("have"))
    return have.join(size, "motif_id").where("have = need").select("ring", "motif_id")


def hashed(df: DataFrame, kind: str, column: str, salt: str) -> DataFrame:
    return df.withColumn("identifier_hash", identifier_hash(F.lit(kind), F.col(column), salt))


class Reloading:
    """A policy that each micro-batch reads anew: a changed file is validated and used, the last ten fingerprints kept."""

    def __init__(self, load: Callable[[], tuple]):
        from tidewatch.operators import policy

        self._load, self._policy, self.rules, self.default, self.history = load, policy, (), policy.DEFAULT, []
        self.refresh()

    def refresh(self) -> bool:
        rules, default = self._load()
        mark = self._policy.fingerprint(rules, default)
        if self.history and self.history[-1] == mark:
            return False
        if not all(r.action and r.tier for r in [*rules, default]):
            raise ValueError("a rule has no action or tier")
        self.rules, self.default, self.history = rules, default, [*self.history, mark][-10:]
        return True
