"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from tidewatch.plans import actions, base, content, extras, features, graph, learned, records, scoring, serving

_ = actions, content, extras, features, graph, learned, records, scoring, serving


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark, sf_dir: str):
    """Wallet features, scores and decisions in one plan."""
    return base.QUERIES["policy_signals"](spark, sf_dir)
