"""Bars, freshness, valuation and the whole snapshot."""

import datetime as dt

import pytest
from helpers import as_dict, d, one

from filigree import api
from filigree.operators import bars as B
from filigree.operators import market as MK
from filigree.operators import quality as Q
from filigree.plans import needs as N
from filigree.plans import snapshot as S
from filigree.reference_data import METRIC
from filigree.sources.tables import Tables

AS_OF = "2025-06-30"


def bar(sid, day, close, high=None, low=None, **more):
    return {"security_id": sid, "trade_date": d(day) if isinstance(day, str) else day, "open": close, "high": close if high is None else high,
            "low": close if low is None else low, "close": close, "volume": 1, "source_id": 1, **more}


def daily(sid, days, last="2025-06-30", price=100.0, **more):
    end = d(last)
    return [bar(sid, end - dt.timedelta(k), price, **more) for k in range(days)]


def metrics(table, *rows, as_of=AS_OF):
    return one(B.price_metrics(table("price_daily", *rows), as_of))


def test_window_minimum_partial_and_full(table):
    assert metrics(table, *daily(1, 19)).high_52w.reason == "INSUFFICIENT_HISTORY"
    assert metrics(table, *daily(1, 20)).high_52w.flags == ["PARTIAL_WINDOW"]
    assert metrics(table, *daily(1, 240)).high_52w.flags == []


def test_window_is_365_days_back_inclusive_and_blind_to_the_future(table):
    rows = daily(1, 30)
    edge, before = bar(1, "2024-06-30", 150.0, high=200.0), bar(1, "2024-06-29", 150.0, high=300.0)
    m = metrics(table, *rows, edge, before, bar(1, "2025-07-05", 999.0))
    assert m.high_52w.value == 200.0 and m.last_close == 100.0 and str(m.newest_bar) == "2025-07-05"
    assert m.drawdown_from_52w_high.value == pytest.approx(-0.5)


def test_returns_are_anchored_to_the_calendar(table):
    rows = [bar(1, "2025-06-30", 110.0), bar(1, "2025-05-30", 100.0), bar(1, "2025-03-10", 50.0)]
    m = metrics(table, *rows)
    assert m.price_return_1m.value == pytest.approx(0.1) and m.price_return_1m.flags == ["PRICE_RETURN_EXCLUDES_DIVIDENDS"]
    assert m.price_return_3m.reason == "BASE_PRICE_STALE" and m.price_return_1y.reason == "INSUFFICIENT_HISTORY"


def test_null_last_close(table):
    m = metrics(table, *daily(1, 30, last="2025-06-29"), {"security_id": 1, "trade_date": d("2025-06-30")})
    assert m.last_close is None and m.last_known_close == 100.0
    assert m.drawdown_from_52w_high.reason == "PRICE_MISSING" and m.price_return_1m.reason == "INSUFFICIENT_HISTORY"


@pytest.mark.parametrize(
    ("row", "problem"),
    [
        ({"trade_date": None}, "BAD_DATE"), ({"close": None}, "NO_POSITIVE_CLOSE"), ({"close": float("nan")}, "NO_POSITIVE_CLOSE"), ({"close": 0.0}, "NO_POSITIVE_CLOSE"),
        ({"open": -1.0}, "NON_POSITIVE_PRICE"), ({"high": 9.0, "low": 11.0}, "HIGH_BELOW_LOW"), ({"close": 10.002}, "CLOSE_OUTSIDE_RANGE"),
        ({"close": 10.0005}, None), ({"volume": -1}, "NEGATIVE_VOLUME"), ({"high": None, "low": None, "open": None}, None),
    ],
)
def test_bar_checks(table, row, problem):
    assert one(B.with_problem(table("price_daily", {**bar(1, "2025-01-02", 10.0), **row}))).problem == problem


def test_gaps(table):
    days = ["2025-01-03", "2025-01-13", "2025-01-21"]  # 5 and 5 weekdays between; then a long one
    rows = [bar(1, x, 1.0) for x in [*days, "2025-02-14"]]
    got = B.gaps(table("price_daily", *rows)).collect()
    assert [(str(r.trade_date), r.business_days) for r in got] == [("2025-01-21", 17)]


def test_rebase_needs_five_overlaps(table):
    old = table("price_daily", *daily(1, 5), *daily(2, 4), *daily(3, 6))
    new = table("price_daily", *daily(1, 5, price=10.0), *daily(2, 4, price=10.0), *daily(3, 6, price=100.05))
    got = as_dict(B.split_rebase(old, new), "security_id")
    assert got[1]["rebased"] and got[1]["median_ratio"] == pytest.approx(0.1)
    assert not got[2]["rebased"] and not got[3]["rebased"]


SECURITIES = [
    {"security_id": 1, "cik": "0000000001", "ticker": "AAA", "name": "A", "sector": "Technology", "industry": "Semis", "sector_source": "nasdaq", "sic": "3674", "sic_source": "sec"},
    {"security_id": 2, "cik": "0000000001", "ticker": "AAB"}, {"security_id": 3, "cik": "0000000002", "ticker": "BBB"}, {"security_id": 4, "cik": None, "ticker": "CCC"},
]


def quote(sid, day, cap):
    return {"security_id": sid, "quote_date": d(day), "last_price": 1.0, "market_cap": cap, "year_high": 100.0, "source_id": 1}


def tables(table, facts, **more):
    fact_rows = facts(("Revenues", 50, "2024-01-01", "2024-12-31", "2025-02-01", "b"), ("Revenues", 40, "2023-01-01", "2023-12-31", "2025-02-01", "b"))
    base = dict(
        securities=table("securities", *SECURITIES), facts=fact_rows, bars=table("price_daily", *daily(1, 300), *daily(3, 300, last="2025-05-30")),
        quotes=table("market_quotes", quote(1, "2025-06-20", 1000.0), quote(1, "2025-01-01", 5.0), quote(2, "2025-06-30", 2000.0), quote(3, "2025-06-30", None)),
        sources=table("sources", {"source_id": 1, "provider": "sec", "dataset": "companyfacts", "parameters": '{"cik": "0000000002"}', "retrieved_at": dt.datetime(2025, 1, 1),
                                  "detail": '{"notes": ["UNSUPPORTED_TAXONOMY:ifrs-full"]}', "is_fallback": False}),
    )
    return Tables(**{**base, **more})


def test_snapshot(table, facts):
    v = as_dict(api.listing_views(tables(table, facts), AS_OF, max_age_days=None), "ticker")
    assert set(v) == {"AAA", "AAB", "BBB"}
    a, b = v["AAA"], v["BBB"]
    assert a["issuer_market_cap"]["value"] == 1000.0
    assert a["issuer_market_cap"]["flags"] == ["MULTI_CLASS_ALL_SHARES_AT_PRIMARY_PRICE", "QUOTE_STALE:10D"]
    assert v["AAB"]["issuer_market_cap"] == a["issuer_market_cap"]
    assert a["price_to_sales"]["value"] == 20.0 and a["price_to_sales_ttm"]["value"] == 20.0
    assert a["price_to_earnings"]["reason"] == "EPS_TTM:NO_ANNUAL_VALUE" and a["price_to_earnings"]["flags"] == ["MULTI_CLASS_PER_SHARE_BASIS_UNVERIFIED"]
    assert v["AAB"]["price_to_earnings"]["reason"] == "PRICE_MISSING" and v["AAB"]["high_52w"]["reason"] == "INSUFFICIENT_HISTORY"
    assert b["revenue_growth_yoy"]["reason"] == "UNSUPPORTED_TAXONOMY:ifrs-full"
    assert b["price_to_sales"]["reason"] == "UNSUPPORTED_TAXONOMY:ifrs-full"
    assert b["price_to_sales"]["flags"] == ["MARKET_CAP:PRIMARY_LISTING_MARKET_CAP_MISSING"]
    assert a["cap_check"]["reason"] == "MULTI_CLASS_ISSUER" and b["cap_check"]["reason"] == "FACTS_UNAVAILABLE:UNSUPPORTED_TAXONOMY:ifrs-full"
    assert a["year_high_diff"] == 0.0


def test_stale_inputs_block_their_metrics(table, facts):
    v = as_dict(api.listing_views(tables(table, facts), AS_OF), "ticker")
    assert v["BBB"]["price_return_1m"]["reason"] == "STALE_PRICE_DATA:last_bar=2025-05-30"
    assert v["AAB"]["high_52w"]["reason"] == "NO_PRICE_DATA"
    assert v["AAA"]["issuer_market_cap"]["reason"] == "STALE_QUOTE:quote_date=2025-06-20"
    assert v["AAA"]["revenue_growth_yoy"]["state"] == "OK" and v["AAA"]["high_52w"]["state"] == "OK"


def test_point_in_time_hides_later_rows(table, facts):
    t = tables(table, facts)
    seen = as_dict(api.listing_views(t, "2025-01-15", max_age_days=None, point_in_time=True), "ticker")["AAA"]
    assert seen["issuer_market_cap"]["value"] == 5.0 and seen["revenue_growth_yoy"]["reason"] == "NO_ANNUAL_REVENUE_OR_NET_INCOME"
    assert str(seen["newest_bar"]) <= "2025-01-15"


def test_primary_listing_designation(spark, table):
    s = table("securities", *SECURITIES)
    named = spark.createDataFrame([("AAA", "AAB"), ("BBB", "ZZZ")], "ticker string, primary_ticker string")
    got = as_dict(MK.primary_listings(s, named), "cik")
    assert (got["0000000001"]["primary_ticker"], got["0000000001"]["designation"]) == ("AAB", "DESIGNATED")
    assert (got["0000000002"]["primary_ticker"], got["0000000002"]["designation"]) == ("BBB", "FALLBACK_DESIGNATED_PRIMARY_NOT_LOADED")


def test_screen_end_to_end(table, facts):
    t = tables(table, facts)
    spec = {"classification": {"taxonomy": "nasdaq", "sector": "technology"}, "criteria": [{"metric": "revenue_growth_yoy", "op": "gt", "value": 15, "unit": "percent"}]}
    got = as_dict(api.screen(t, spec, AS_OF), "ticker")
    assert got["AAA"]["status"] == "MATCH" and got["AAB"]["status"] == "UNEVALUABLE"
    assert got["BBB"]["exclusion_reason"].startswith("MISSING_DATA: classification")
    price = as_dict(api.screen(t, {"criteria": [{"metric": "drawdown_from_52w_high", "op": "gte", "value": -10, "unit": "percent"}]}, AS_OF), "ticker")
    assert {k: x["status"] for k, x in price.items()} == {"AAA": "MATCH", "AAB": "UNEVALUABLE", "BBB": "UNEVALUABLE"}


def test_metrics_api_and_validation(spark, table, facts):
    t = tables(table, facts)
    long = api.metrics(t, AS_OF, symbols=spark.createDataFrame([("AAA",)], "ticker string"))
    assert long.count() == 34 and api.catalog(spark).count() == 34
    assert {r.ticker for r in api.universe(t).collect()} == {"AAA", "AAB", "BBB", "CCC"}
    filings = table("filings", {"accession_no": "a", "cik": "0000000001", "form": "10-K", "filing_date": d("2025-02-01")})
    bundle = api.validation(tables(table, facts, filings=filings))
    counts = as_dict(bundle["integrity"], "check_name")
    assert counts["securities_without_cik"]["violations"] == 1 and counts["filings_without_source"]["violations"] == 1
    assert counts["duplicate_price_keys"]["violations"] == 0 and len(counts) == 19
    assert as_dict(bundle["table_counts"], "table_name")["securities"]["rows"] == 4


def test_multi_class_and_roles(spark, table):
    s = table("securities", *SECURITIES)
    assert {r.ticker for r in Q.multi_class(s).collect()} == {"AAA", "AAB"}
    roles = spark.createDataFrame([("1", "A", ["adr"]), ("1", "B", []), ("2", "C", ["large_tech"])], "cik string, ticker string, roles array<string>")
    assert [r.cik for r in Q.industrial_issuers(roles).collect()] == ["2"]


def test_no_python_in_the_plan(table, facts):
    plan = S.long_metrics(S.listing_views(tables(table, facts), AS_OF, reuse=False))._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_views_of_some_metrics_equal_the_full_ones(spark, table, facts):
    """Whatever is asked for, alone or together, is what the whole snapshot says."""
    t = tables(table, facts)
    names = [*N.Needs.all().metrics()]
    singles = ("price_to_earnings", "cap_check", "debt_to_equity_change_yoy")
    for age, groups in ((None, [[n] for n in singles]), (7, [names[::3], names[1::3], names[2::3]])):
        full = as_dict(api.listing_views(t, AS_OF, max_age_days=age), "ticker")
        for some in groups:
            got = as_dict(api.listing_views(t, AS_OF, max_age_days=age, metrics=some), "ticker")
            assert got.keys() == full.keys()
            for ticker, row in got.items():
                assert {m: row[m] for m in some} == {m: full[ticker][m] for m in some}, (age, some, ticker)


def test_a_plan_holds_only_what_its_metrics_rest_on(spark, table, facts):
    t = tables(table, facts)
    plan = lambda *m: S.listing_views(t, AS_OF, reuse=False, metrics=m)._jdf.queryExecution().optimizedPlan().toString()
    margin = plan("net_margin")
    assert "NetIncomeLoss" in margin and "Revenues" in margin
    for absent in ("GrossProfit", "LongTermDebt", "EarningsPerShareDiluted", "trade_date", "last_price", "EntityCommonStock"):
        assert absent not in margin, absent
    price = plan("drawdown_from_52w_high", "price_return_1y")
    assert "trade_date" in price and "filed_date" not in price and "quote_date" not in price
    cap = plan("issuer_market_cap")
    assert "quote_date" in cap and "trade_date" not in cap and "filed_date" not in cap
    eps = plan("price_to_earnings")
    assert "EarningsPerShareDiluted" in eps and "WeightedAverage" in eps and "Revenues" not in eps and "quote_date" not in eps


def test_every_metric_has_needs():
    assert set(N.GRAPH) == {*METRIC, *N.CHECKS}
    assert N.Needs.of(["price_to_sales_ttm"]).metrics() == ("revenue_ttm", "issuer_market_cap", "price_to_sales_ttm")
    with pytest.raises(ValueError, match="no_such"):
        N.Needs.of(["no_such"])
