"""First-match decision policy: rules as data, a generated CASE for evaluation, dispatch and reload."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    tier: str
    window_s: int
    signal_kind: str | None = None
    motif: str | None = None
    severity_in: tuple[str, ...] | None = None
    score_gte: float | None = None
    subject_kind: str | None = None
    evidence: tuple[str, ...] = field(default=())


# The default policy, in order.
DEFAULT_RULES = (
    Rule("verified-business-suppress", "investigation.queue", "tier3", 86400, evidence=("verified_business",)),
    Rule("aml-watchlist-tier1-critical", "momo.freeze_account", "tier1", 86400, "aml.watchlist_match", severity_in=("critical",)),
    Rule("aml-watchlist-tier1-high", "momo.send_with_care", "tier1", 86400, "aml.watchlist_match", severity_in=("high",)),
    Rule("aml-watchlist-tier3", "investigation.queue", "tier3", 86400, "aml.watchlist_match", severity_in=("medium", "low")),
    Rule("voice-velocity-burst-tier1", "volte.tag_suspected_spam", "tier1", 21600, "voice.velocity_burst", severity_in=("critical", "high")),
    Rule("sms-known-bad-body-tier1", "sms.block", "tier1", 86400, "sms.known_bad_body"),
    Rule("sms-malicious-url-tier1", "url.block", "tier1", 21600, "sms.malicious_url", severity_in=("critical", "high")),
    Rule("momo-mule-friction-tier1", "momo.send_with_care", "tier1", 3600, "momo.mule_velocity", severity_in=("critical", "high")),
    Rule("otp-during-call-tier1", "otp.hold_and_alert", "tier1", 300, "otp.during_call", severity_in=("critical", "high")),
    Rule("voice-sms-momo-24h-motif-tier1", "investigation.escalate", "tier1", 3600, motif="voice_sms_momo_24h", score_gte=0.7),
    Rule("sms-template-smishing-tier2", "customer.alert_smishing", "tier2", 21600, "sms.template_smishing"),
    Rule("device-imei-churn-tier2", "customer.do_i_know_you_prompt", "tier2", 86400, "device.imei_churn"),
    Rule("momo-high-value-velocity-tier2", "momo.review_limit", "tier2", 14400, "momo.high_value_velocity"),
    Rule("sms-known-bad-template-tier2", "customer.alert_smishing", "tier2", 21600, "sms.known_bad_template"),
)
DEFAULT = Rule("default", "investigation.queue", "tier3", 0)


def from_dict(policy: dict) -> tuple[list[Rule], Rule]:
    """The rules and the default of a policy document."""
    def rule(x: dict, name: str) -> Rule:
        m = x.get("match", {})
        some = lambda k: tuple(m[k]) if m.get(k) else None
        return Rule(x.get("id", name), x["action"], x["tier"], int(x.get("suppression_window_s", 0)), m.get("signal_kind"), m.get("motif"), some("severity_in"), m.get("score_gte"), m.get("subject_kind"), some("evidence_truthy") or ())

    return [rule(x, f"rule-{i}") for i, x in enumerate(policy.get("rules", []))], rule(policy["default"], "default")


def fingerprint(rules: Sequence[Rule], default: Rule = DEFAULT) -> str:
    """Changes with anything in any rule, predicates included."""
    return hashlib.sha256(json.dumps([asdict(r) for r in [*rules, default]], sort_keys=True).encode()).hexdigest()[:16]


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def signal_predicate(r: Rule, evidence: str = "evidence") -> Column:
    conds = [F.lit(r.motif is None)]
    if r.signal_kind:
        conds.append(F.col("signal_kind") == r.signal_kind)
    if r.severity_in:
        conds.append(F.col("severity").isin(*r.severity_in))
    if r.score_gte is not None:
        conds.append(F.col("score") >= r.score_gte)
    if r.subject_kind:
        conds.append(F.col("subject_kind") == r.subject_kind)
    conds += [F.coalesce(F.lower(F.try_element_at(evidence, F.lit(e))).isin("true", "1"), F.lit(False)) for e in r.evidence]
    return F.coalesce(_all(conds), F.lit(False))


def motif_predicate(r: Rule) -> Column:
    """Severity and subject do not matter for motifs; rules of signals or evidence never match."""
    if r.signal_kind or r.evidence:
        return F.lit(False)
    conds = [F.col("motif") == r.motif] if r.motif else []
    if r.score_gte is not None:
        conds.append(F.col("confidence") >= r.score_gte)
    return F.coalesce(_all(conds), F.lit(False))


def decide(events: DataFrame, predicate, rules: Sequence[Rule] = DEFAULT_RULES, default: Rule = DEFAULT) -> DataFrame:
    """events with rule_id, action, tier and window_s of the first rule that matches.

    The ordered rules become one CASE: no join, and it stops at the first match. Rules are few, so the plan stays small.
    """
    picked = None
    for r in rules:
        value = F.lit(r.id)
        picked = F.when(predicate(r), value) if picked is None else picked.when(predicate(r), value)
    rule_id = picked.otherwise(default.id) if picked is not None else F.lit(default.id)
    table = {r.id: r for r in [*rules, default]}
    look = lambda name: F.element_at(F.create_map(*[y for k, r in table.items() for y in (F.lit(k), F.lit(getattr(r, name)))]), F.col("rule_id"))
    return events.withColumn("rule_id", rule_id).withColumns({"action": look("action"), "tier": look("tier"), "window_s": look("window_s")})


def dispatch(decided: DataFrame) -> DataFrame:
    """Where each decision goes: the audit topic always, and its tier's."""
    return decided.withColumn("topic", F.explode(F.array(F.lit("decisions.audit"), F.concat(F.lit("decisions."), F.col("tier")))))
