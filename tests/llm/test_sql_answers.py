"""Registered queries against their SQL answers."""

import duckdb
import pandas as pd
import pytest

from filigree.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def plain(df):
    out = df[sorted(df.columns)].astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, SF).toPandas()), plain(con.execute(SQL[name]).fetchdf()))
