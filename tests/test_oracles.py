"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans.registry import oracle_sql, queries

# Queries that the smallest tables leave without rows.
MAY_BE_EMPTY = {"agent_collusion", "fund_flow", "agent_phantom", "motif_bust_out", "motif_voice_sms_momo", "motif_voice_then_momo", "agent_float", "motif_sms_url", "audit_range", "cross_opco", "otp_during_call", "blocklist_check", "report_csa"}


def rows(df):
    cols = sorted(df.columns)

    def cell(z):
        if pd.isna(z):
            return "null"
        return repr(round(float(z), 6)) if isinstance(z, numbers.Real) and not isinstance(z, bool) else str(z)

    return cols, sorted(tuple(cell(z) for z in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = rows(queries()[name](spark, small).toPandas()), rows(con.sql(oracle_sql()[name]).df())
    assert got == want
    assert got[1] or name in MAY_BE_EMPTY


def test_every_query_is_named():
    assert len(queries()) > 120
    assert set(oracle_sql()) <= set(queries())
