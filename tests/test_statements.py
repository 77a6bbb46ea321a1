"""Line selection, same-filing pairs and trailing twelve months on hand-made facts."""

import pytest
from helpers import as_dict, one
from pyspark.sql import functions as F

from filigree.operators import facts as X
from filigree.operators import fundamentals as FD
from filigree.operators import ttm as TT
from filigree.plans import snapshot as S

RFC = "RevenueFromContractWithCustomerExcludingAssessedTax"
Y24 = ("2024-01-01", "2024-12-31")
Y23 = ("2023-01-01", "2023-12-31")


def selection(df, line="revenue"):
    p = X.with_anchors(X.periods(X.line_facts(df)))
    rows = [r.sel for r in X.selected_lines(p).where(F.col("line") == line).collect()]
    return rows[0] if rows else None


def test_priority_confirmation_and_conflict(facts):
    s = selection(facts((RFC, 100, *Y24, "2025-02-01", "a"), ("Revenues", 100.5, *Y24, "2025-02-01", "a")))
    assert (s.value, s.tag, s.flags, s.problem) == (100.0, RFC, ["CONFIRMED_BY:Revenues"], None)
    s = selection(facts((RFC, 100, *Y24, "2025-02-01", "a"), ("Revenues", 102, *Y24, "2025-02-01", "a")))
    assert s.value is None and s.problem == f"TAG_CONFLICT:{RFC}!=Revenues"
    s = selection(facts(("SalesRevenueNet", 7, *Y24, "2025-02-01", "a")))
    assert (s.value, s.tag) == (7.0, "SalesRevenueNet")


def test_latest_vintage_and_restatement(facts):
    s = selection(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 90, *Y24, "2025-06-01", "b")))
    assert (s.value, s.accession, s.flags) == (90.0, "b", ["RESTATED_PERIOD"])
    s = selection(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 100, *Y24, "2025-02-01", "b")))
    assert (s.accession, s.flags) == ("b", [])


def test_wrong_unit_and_unknown_tags_are_ignored(facts):
    assert selection(facts(("Revenues", 100, *Y24, "2025-02-01", "a", "EUR"), ("Assets", 1, *Y24, "2025-02-01", "a"))) is None


def test_point_in_time(facts):
    df = facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 90, *Y24, "2025-06-01", "b"))
    before = X.latest_known(X.line_facts(df, as_of="2025-03-01"))
    assert one(before).value == 100.0
    assert X.latest_known(X.line_facts(df, as_of="2024-03-01")).count() == 0


def test_pair_needs_one_filing_with_both_years(facts):
    def pair(df):
        lf, p = S.statement_frames(df)
        return X.annual_pairs(X.tag_pairs(lf, X.pair_anchors(p))).collect()

    split = facts(("Revenues", 120, *Y24, "2025-02-01", "b"), ("Revenues", 100, *Y23, "2024-02-01", "a"))
    assert pair(split) == []
    both = facts(("Revenues", 120, *Y24, "2025-02-01", "b"), ("Revenues", 100, *Y23, "2025-02-01", "b"),
                 ("Revenues", 99, *Y23, "2024-02-01", "a"), ("Revenues", 130, *Y24, "2025-06-01", "c"))
    (row,) = pair(both)
    assert (row.pair.now.value, row.pair.prior.value, row.pair.now.accession) == (120.0, 100.0, "b")


def issuer(spark, df, as_of="2025-12-01"):
    return one(S.issuer_fundamentals(df, df.select("cik").distinct(), as_of, reuse=False))


def test_facts_are_joined_with_listed_issuers_before_anything_is_grouped(spark, facts, monkeypatch):
    rows = [("Revenues", 120, *Y24, "2025-02-01", "b"), ("Revenues", 100, *Y23, "2025-02-01", "b"), ("StockholdersEquity", 9, None, "2024-12-31", "2025-02-01", "b")]
    df = facts(*rows).unionAll(facts(*rows, cik="0000000002")).unionAll(facts(*rows, cik=None))
    issuers = spark.createDataFrame([("0000000002",), ("0000000003",)], "cik string")
    plain = S.issuer_fundamentals(df, issuers, "2025-12-01").collect()
    kept, staged = S.stage, []
    monkeypatch.setattr(S, "stage", lambda frame, *more: staged.append(kept(frame, *more)) or staged[-1])
    listed = issuers.unionAll(issuers).unionAll(spark.createDataFrame([(None,)], "cik string"))
    made = S.issuer_fundamentals(df, issuers, "2025-12-01", listed=listed).collect()
    assert sorted(made, key=str) == sorted(plain, key=str) and {r.cik for r in made} == {"0000000002", "0000000003"}
    assert {r.cik for frame in staged[1:] for r in frame.select("cik").collect()} == {"0000000002"}


def test_annual_metrics(spark, facts):
    rows = [("Revenues", 120, *Y24), ("Revenues", 100, *Y23), ("GrossProfit", 60, *Y24), ("GrossProfit", 40, *Y23),
            ("NetCashProvidedByUsedInOperatingActivities", 30, *Y24), ("NetCashProvidedByUsedInOperatingActivities", 20, *Y23),
            ("PaymentsToAcquirePropertyPlantAndEquipment", 10, *Y24), ("PaymentsToAcquirePropertyPlantAndEquipment", -5, *Y23)]
    r = issuer(spark, facts(*[(*x, "2025-02-01", "b") for x in rows]))
    assert r.revenue_growth_yoy.value == pytest.approx(0.2)
    assert r.gross_margin.value == 0.5 and r.gross_margin_change_yoy.value == pytest.approx(0.1)
    assert r.fcf.value == 20.0 and r.fcf_growth_yoy.value == pytest.approx(20 / 15 - 1)
    assert r.net_margin.reason == "NOT_REPORTED" and r.net_margin_change_yoy.reason == "NO_FILING_REPORTS_BOTH_YEARS"
    assert r.revenue_ttm.value == 120.0 and r.total_debt.reason == "NO_BALANCE_SHEET"
    assert r.debt_to_equity_fy.reason == "DEBT_COMPONENT_ABSENT:current_portion_long_term_debt,long_term_debt" or r.debt_to_equity_fy.state == "MISSING_INPUT"


def test_inputs_from_different_filings(spark, facts):
    r = issuer(spark, facts(
        ("Revenues", 120, *Y24, "2025-02-01", "b"), ("Revenues", 100, *Y23, "2025-02-01", "b"),
        ("GrossProfit", 60, *Y24, "2025-05-01", "c"), ("GrossProfit", 40, *Y23, "2025-05-01", "c"),
        ("NetCashProvidedByUsedInOperatingActivities", 30, *Y24, "2025-02-01", "b"),
        ("PaymentsToAcquirePropertyPlantAndEquipment", 10, *Y24, "2025-05-01", "c"),
    ))
    assert (r.gross_margin_change_yoy.state, r.gross_margin_change_yoy.reason) == ("NOT_COMPARABLE", "MARGIN_INPUTS_FROM_DIFFERENT_FILINGS")
    assert r.fcf.value == 20.0 and r.fcf.flags == ["MIXED_FILINGS"]
    assert r.fcf_growth_yoy.reason == "CAPEX_OR_CFO_PAIR_MISSING"


def test_no_annual_line(spark, facts):
    r = issuer(spark, facts(("StockholdersEquity", 5, None, "2024-12-31", "2025-02-01", "a")))
    assert r.revenue_growth_yoy.reason == "NO_ANNUAL_REVENUE_OR_NET_INCOME"
    assert r.debt_to_equity_fy.reason == "NO_ANNUAL_REVENUE_OR_NET_INCOME"
    assert r.revenue_ttm.reason == "NO_ANNUAL_VALUE" and r.shares_outstanding.reason == "NOT_REPORTED"
    assert r.total_debt.reason.startswith("DEBT_COMPONENT_ABSENT")


def test_leverage_reads_one_filing_only(spark, facts):
    sheet = [("LongTermDebtCurrent", 10), ("LongTermDebtNoncurrent", 30), ("StockholdersEquity", 80)]
    rows = [("Revenues", 120, *Y24, "2025-02-01", "b"), ("Revenues", 100, *Y23, "2025-02-01", "b")]
    rows += [(t, v, None, "2024-12-31", "2025-02-01", "b") for t, v in sheet]
    rows += [(t, v / 2 if t != "StockholdersEquity" else v, None, "2023-12-31", "2025-02-01", "b") for t, v in sheet]
    rows += [("StockholdersEquity", 1, None, "2024-12-31", "2025-08-01", "z")]
    r = issuer(spark, facts(*rows))
    assert r.debt_to_equity_fy.value == 0.5 and r.debt_to_equity_prior_fy.value == 0.25
    assert r.debt_to_equity_change_yoy.value == 0.25 and r.debt_to_equity.value == 40.0


Q1 = ("2025-01-01", "2025-03-31")
P1 = ("2024-01-01", "2024-03-31")


def ttm(df, line="revenue"):
    return one(TT.choose_ttm(TT.ttm_outcomes(TT.ttm_parts(X.periods(X.line_facts(df)), (line,)))))


def test_ttm_composition(facts):
    t = ttm(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 30, *Q1, "2025-05-01", "b"), ("Revenues", 20, *P1, "2025-05-01", "b")))
    assert (t.ttm.value, t.basis, t.ttm.flags) == (110.0, "FY+YTD-YTD_PRIOR", ["COMPOSED:FY+YTD-YTD_PRIOR"])
    t = ttm(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 20, *P1, "2025-05-01", "b")))
    assert (t.ttm.value, t.basis) == (100.0, "FY")


def test_ttm_takes_the_longest_year_to_date(facts):
    t = ttm(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 30, *Q1, "2025-05-01", "b"), ("Revenues", 20, *P1, "2025-05-01", "b"),
                  ("Revenues", 70, "2025-01-01", "2025-06-30", "2025-08-01", "c"), ("Revenues", 45, "2024-01-01", "2024-06-30", "2025-08-01", "c")))
    assert t.ttm.value == 125.0


def test_ttm_reasons(facts):
    t = ttm(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 30, *Q1, "2025-05-01", "b")))
    assert (t.ttm.state, t.ttm.reason) == ("MISSING_INPUT", "PRIOR_YEAR_YTD_MISSING")
    t = ttm(facts(("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 30, "2025-04-01", "2025-06-30", "2025-08-01", "b")))
    assert (t.ttm.state, t.ttm.reason) == ("NOT_COMPARABLE", "TTM_PERIODS_MISALIGNED")


def test_ttm_falls_through_missing_tags_only(facts):
    rows = [(RFC, 100, *Y24, "2025-02-01", "a"), (RFC, 30, *Q1, "2025-05-01", "b"), ("Revenues", 101, *Y24, "2025-02-01", "a")]
    assert ttm(facts(*rows)).ttm.value == 101.0
    rows[1] = (RFC, 30, "2025-04-01", "2025-06-30", "2025-08-01", "b")
    assert ttm(facts(*rows)).ttm.reason == "TTM_PERIODS_MISALIGNED"


def test_ttm_growth(spark, facts):
    base = [("Revenues", 100, *Y24, "2025-02-01", "a"), ("Revenues", 80, *Y23, "2025-02-01", "a"), ("Revenues", 30, *Q1, "2025-05-01", "b"),
            ("Revenues", 20, *P1, "2025-05-01", "b"), ("Revenues", 20, *P1, "2024-05-01", "p"), ("Revenues", 10, "2023-01-01", "2023-03-31", "2024-05-01", "p")]
    r = issuer(spark, facts(*base))
    assert r.revenue_growth_ttm_yoy.value == pytest.approx(110 / 90 - 1)
    assert r.revenue_growth_ttm_yoy.flags == ["TTM_COMPONENTS_FROM_SEVERAL_FILINGS"]
    restated = [*base[:4], ("Revenues", 21, *P1, "2024-05-01", "p"), base[5]]
    r = issuer(spark, facts(*restated))
    assert (r.revenue_growth_ttm_yoy.state, r.revenue_growth_ttm_yoy.reason) == ("NOT_COMPARABLE", "RESTATED_COMPONENT")


@pytest.mark.parametrize(("shares", "reason"), [(1000, None), (10000, "POSSIBLE_SPLIT_BASIS_CHANGE"), (None, "SPLIT_GUARD_UNAVAILABLE")])
def test_eps_split_guard(spark, facts, shares, reason):
    w, e = "WeightedAverageNumberOfDilutedSharesOutstanding", "EarningsPerShareDiluted"
    rows = [(e, 4, *Y24, "2025-02-01", "a", "USD/shares"), (e, 1.5, *Q1, "2025-05-01", "b", "USD/shares"), (e, 1, *P1, "2025-05-01", "b", "USD/shares"),
            (w, 1000, *Y24, "2025-02-01", "a", "shares")]
    if shares:
        rows.append((w, shares, *Q1, "2025-05-01", "b", "shares"))
    r = issuer(spark, facts(*rows))
    assert r.diluted_eps_ttm.reason == reason
    if reason is None:
        assert r.diluted_eps_ttm.value == 4.5 and "PER_SHARE_SUM_OF_PERIODS" in r.diluted_eps_ttm.flags


def test_share_counts(spark, facts):
    s = "EntityCommonStockSharesOutstanding"

    def cell(as_of, *rows):
        got = X.share_counts(X.line_facts(facts(*rows)))
        return one(got.select(FD.shares_outstanding(F.col("shares_end"), F.col("shares_low"), F.col("shares_high"), as_of).alias("c"))).c

    ok = (s, 1000, None, "2025-01-31", "2025-02-01", "a", "shares")
    assert cell("2025-06-01", ok).value == 1000.0
    assert cell("2027-06-01", ok).reason == "STALE_SHARES:2025-01-31"
    assert cell("2025-06-01", ok, (s, 2000, None, "2025-01-31", "2025-02-01", "b", "shares")).reason == "MULTI_CLASS_AMBIGUOUS"
    assert cell("2025-06-01", ok, (s, 2000, None, "2025-01-31", "2025-03-01", "b", "shares")).value == 2000.0


def test_fiscal_year_label_is_that_of_the_first_filing(facts):
    p = X.periods(X.line_facts(facts(("Revenues", 1, *Y23, "2024-02-01", "a"), ("Revenues", 1, *Y23, "2025-02-01", "b"))))
    assert one(X.fiscal_year_labels(p)).fiscal_year == 2024
    assert as_dict(X.fiscal_year_coverage(p, ("revenue",)), "cik")["0000000001"]["revenue"] == 1
