"""What the derived tables must hold: each documented state occurs in the answers of the queries that tell states apart."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
NONE = "none"
STATES = {
    "ttm_revenue": (
        "coalesce(basis, 'none') || ' ' || state || ' ' || coalesce(reason, 'none')",
        {"FY OK none", "FY+YTD-YTD_PRIOR OK none", "FY+YTD-YTD_PRIOR MISSING_INPUT PRIOR_YEAR_YTD_MISSING", "FY NOT_COMPARABLE TTM_PERIODS_MISALIGNED"},
    ),
    "ttm_growth": (
        "state || ' ' || coalesce(reason, 'none')",
        {
            "OK none", "NOT_COMPARABLE RESTATED_COMPONENT", "NOT_COMPARABLE TTM_PERIODS_MISALIGNED", "MISSING_INPUT PRIOR_YEAR_NOT_IN_SAME_FILING",
            "MISSING_INPUT PRIOR_YEAR_YTD_MISSING", "MISSING_INPUT PRIOR_FISCAL_YEAR_MISSING",
        },
    ),
    "ttm_eps": (
        "state || ' ' || coalesce(reason, 'none')",
        {"OK none", "MISSING_INPUT SPLIT_GUARD_UNAVAILABLE", "NOT_COMPARABLE POSSIBLE_SPLIT_BASIS_CHANGE", "MISSING_INPUT PRIOR_YEAR_YTD_MISSING"},
    ),
    "ttm_components": ("role || ' ' || basis", {"fiscal_year FY", "fiscal_year FY+YTD-YTD_PRIOR", "current_ytd FY+YTD-YTD_PRIOR", "prior_year_ytd FY+YTD-YTD_PRIOR"}),
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(STATES))
def test_every_state_occurs(con, name):
    told, wanted = STATES[name]
    got = {r[0] for r in con.execute(f"SELECT DISTINCT {told} FROM ({entry_point.oracle_sql()[name]})").fetchall()}
    assert wanted <= got, wanted - got


def test_restated_and_composed_values_are_flagged(con):
    flags = {f for (row,) in con.execute(f"SELECT DISTINCT flags FROM ({entry_point.oracle_sql()['ttm_revenue']})").fetchall() for f in (row or "").split(",")}
    assert {"RESTATED_PERIOD", "COMPOSED:FY+YTD-YTD_PRIOR"} <= flags


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries when the corpus folders are gone, with and without the pipeline's file."""
    root = pathlib.Path(entry_point.__file__).parent
    for k, keep in enumerate((True, False)):
        copy = tmp_path / str(k)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if keep else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in {**q, **s}))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 100
        assert out[1] == "False"
