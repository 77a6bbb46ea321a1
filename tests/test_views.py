"""The derived tables: how they are dealt, and that every order counts."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from filigree.operators import facts as X
from filigree.plans import queries as Q
from filigree.plans.views import Inputs
from filigree.sources.staging import stage

SHUFFLE = "Exchange hashpartitioning"


@pytest.fixture
def sf_dir(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    days = [datetime.date(2000, 2, 3), datetime.date(2000, 11, 30), datetime.date(2001, 5, 6), datetime.date(2001, 12, 1)]
    orders = [(k, 1 + k % 2, "FOP"[k % 3], 100.0 + k, days[k // 2 % 4], f"{1 + k % 5}-X") for k in range(16)]
    write("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string")
    write("customer", [(1, 0, "BUILDING"), (2, 1, "MACHINERY")], "c_custkey long, c_nationkey long, c_mktsegment string")
    write("nation", [(0, 0), (1, 1)], "n_nationkey long, n_regionkey long")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_shuffled_before_they_are_unfolded_only(spark, sf_dir):
    facts = Inputs(spark, sf_dir).facts()
    assert _plan(X.periods(X.line_facts(facts))).count(SHUFFLE) == _plan(facts).count(SHUFFLE)


def test_columns_beside_facts_are_joined_before_they_are_unfolded(spark, sf_dir):
    facts = Inputs(spark, sf_dir).facts()
    beside = spark.createDataFrame([("0001000001", "a"), ("0001000001", "b"), (None, "c")], "cik string, x string")
    wide = Inputs(spark, sf_dir).facts(beside=beside)
    expected = facts.join(beside, "cik").select(wide.columns)
    assert sorted(wide.collect(), key=str) == sorted(expected.collect(), key=str) and wide.count() > 0
    plan = Q.fact_documents(Inputs(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("posexplode")].count("Join Inner") == 1  # the constants of each value


def test_shared_periods_and_quotes_are_written_once(spark, sf_dir):
    days = [datetime.date(2000, 3, 1), datetime.date(2001, 5, 1), None]
    items = [(k, 1, k % 3 if k % 5 else None, 1 + k % 2, 100.0 + k, 0.1, 0.1, "O", "N", 1.0, days[k % 3]) for k in range(12)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_tax double, l_discount double, l_linestatus string, l_returnflag string, l_quantity double, l_shipdate date"
    spark.createDataFrame(items, schema).write.parquet(f"{sf_dir}/lineitem.parquet")
    i = Inputs(spark, sf_dir)
    shared = i.shared()
    for made, kept in ((i.facts(), shared.facts()), (i.facts(True), shared.facts(True)), (i.quotes(), shared.quotes()), (i.bars().select("security_id").distinct(), shared.listed())):
        assert sorted(made.collect(), key=str) == sorted(kept.collect(), key=str) and made.columns == kept.columns
    assert SHUFFLE not in _plan(shared.facts()) + _plan(shared.quotes())


def test_stored_facts_are_in_buckets(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    stored = i.stored_facts()
    assert sorted(stored.collect()) == sorted(i.facts().collect())
    assert SHUFFLE not in _plan(X.with_anchors(X.periods(X.line_facts(stored))))
    assert SHUFFLE in _plan(stage(i.facts()).groupBy("cik").agg(F.count("*")))


def test_fiscal_year_labels_of_every_year(spark, sf_dir):
    got = {(r.cik, r.period_end, r.fiscal_year) for r in Q.REGISTRY["fiscal_year_labels"](spark, sf_dir).collect()}
    assert got == {(cik, f"{y}-12-31", y) for cik in ("0001000001", "0001000002", "0000000001", "0000000002") for y in (2000, 2001)}


def test_methods_on_facts_are_small_enough_to_be_compiled(spark, sf_dir, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("ttm_components", "line_selection"):
            Q.REGISTRY[name](spark, sf_dir).explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000  # bytes; longer methods are interpreted
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
