"""Registered queries against their SQL answers on the small tables.

A representative set runs by default; FILIGREE_ALL=1 runs every query.
"""

import os
import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from filigree.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
DEFAULT = (
    "drawdown_screen", "price_returns", "price_gaps", "duplicate_bars", "latest_known_asof", "same_filing_pair", "growth", "ttm_growth", "ttm_eps", "leverage_change",
    "balance_sheet", "issuer_market_cap", "upsert_status", "identity_merge", "p95_seconds", "upper_median_seconds", "request_peak", "filing_items", "evidence_sections",
    "companyfacts_counts", "submissions_flatten", "stream_tick_bars", "metrics",
)
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    def text(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    out = df[sorted(df.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


NAMES = sorted(n for n, q in REGISTRY.items() if q.sql) if os.environ.get("FILIGREE_ALL") else DEFAULT


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = plain(entry_point.queries()[name](spark, SF).toPandas())
    want = plain(con.execute(entry_point.oracle_sql()[name]).fetchdf())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["drawdown_screen", "line_selection", "ttm_growth", "upsert_table", "request_peak", "filing_items", "integrity_report"])
def test_plans_have_no_python_and_no_cross_join(spark, name):
    plan = entry_point.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_scans_read_only_what_they_need(spark):
    plan = entry_point.queries()["last_sync"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_entry(spark):
    assert entry_point.entry(spark).columns[:2] == ["ticker", "cik"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
