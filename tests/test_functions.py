"""Truth tables of metric, date and text functions."""

import pytest
from pyspark.sql import functions as F

from filigree.cell import unpack
from filigree.functions import dates as D
from filigree.functions import metrics as M
from filigree.functions import text as T


def cells(spark, rows, schema, build):
    """[(state, value, reason, flags)] of a cell over every row, in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    got = df.select("i", build().alias("c")).select("i", *unpack(F.col("c"))).orderBy("i").collect()
    return [(r["state"], r["value"], r["reason"], r["flags"]) for r in got]


def c(name):
    return F.col(name)


def test_growth(spark):
    rows = [(120.0, 100.0), (0.0, 100.0), (5.0, 0.0), (5.0, -1.0), (-5.0, -1.0), (0.0, -1.0), (-5.0, 1.0), (None, 1.0),
            (1.0, float("nan")), (float("inf"), 1.0)]
    got = cells(spark, rows, "a double, b double", lambda: M.growth_rate(c("a"), c("b")))
    assert [(g[0], g[2]) for g in got] == [
        ("OK", None), ("OK", None), ("ZERO_DENOMINATOR", "ZERO_BASE"), ("NOT_MEANINGFUL", "SIGN_CHANGE"),
        ("NOT_MEANINGFUL", "NEGATIVE_BASE"), ("NOT_MEANINGFUL", "NEGATIVE_BASE"), ("NOT_MEANINGFUL", "SIGN_CHANGE"),
        ("MISSING_INPUT", "MISSING_VALUE"), ("MISSING_INPUT", "MISSING_VALUE"), ("MISSING_INPUT", "MISSING_VALUE"),
    ]
    assert got[0][1] == pytest.approx(0.2) and got[1][1] == -1.0 and got[2][1] is None


def test_margin_and_ratios(spark):
    got = cells(spark, [(-5.0, 10.0), (1.0, 0.0), (1.0, -2.0), (None, 1.0)], "a double, b double", lambda: M.margin(c("a"), c("b")))
    assert [g[2] for g in got] == [None, "ZERO_REVENUE", "NEGATIVE_REVENUE", "MISSING_VALUE"]
    assert got[0][1] == -0.5
    got = cells(spark, [(10.0, 2.0), (10.0, 0.0), (10.0, -1.0), (0.0, 1.0), (10.0, None)], "a double, b double",
                lambda: M.price_to_earnings(c("a"), c("b")))
    assert [g[2] for g in got] == [None, "ZERO_EPS", "NEGATIVE_EARNINGS", "PRICE_MISSING", "EPS_MISSING"]
    got = cells(spark, [(10.0, 2.0), (None, 2.0), (10.0, None), (10.0, 0.0), (10.0, -1.0)], "a double, b double",
                lambda: M.price_to_sales(c("a"), c("b")))
    assert [g[2] for g in got] == [None, "MARKET_CAP_MISSING", "REVENUE_MISSING", "ZERO_REVENUE", "NEGATIVE_REVENUE"]
    got = cells(spark, [(10.0, 4.0), (10.0, None)], "a double, b double", lambda: M.gross_profit_from_components(c("a"), c("b")))
    assert got == [("OK", 6.0, None, "DERIVED_GROSS_PROFIT"), ("MISSING_INPUT", None, "COST_OF_REVENUE_NOT_REPORTED", "")]


def test_free_cash_flow_uses_the_magnitude_of_capex(spark):
    got = cells(spark, [(10.0, 4.0), (10.0, -4.0), (None, 4.0), (10.0, None)], "a double, b double", lambda: M.free_cash_flow(c("a"), c("b")))
    assert [(g[1], g[2]) for g in got] == [
        (6.0, None), (6.0, None), (None, "OPERATING_CASH_FLOW_MISSING"), (None, "CAPEX_NOT_REPORTED"),
    ]


@pytest.mark.parametrize(
    ("short", "current", "long", "leases", "present", "evidence", "expected"),
    [
        (1.0, 2.0, 3.0, 4.0, True, False, ("OK", 10.0, None, "")),
        (None, 2.0, 3.0, None, True, False, ("OK", 5.0, None, "SHORT_TERM_DEBT_NOT_REPORTED,FINANCE_LEASES_NOT_REPORTED")),
        (1.0, None, None, None, True, False,
         ("MISSING_INPUT", None, "DEBT_COMPONENT_ABSENT:current_portion_long_term_debt,long_term_debt", "")),
        (1.0, 0.0, 0.0, None, True, False, ("OK", 1.0, None, "FINANCE_LEASES_NOT_REPORTED")),
        (None, None, None, None, False, False, ("MISSING_INPUT", None, "NO_BALANCE_SHEET", "")),
        (None, -1.0, 3.0, None, False, False, ("NOT_MEANINGFUL", None, "NEGATIVE_DEBT_COMPONENT", "")),
        (None, None, None, None, True, True, ("OK", 0.0, None, "EXPLICIT_NO_DEBT_EVIDENCE")),
        (5.0, None, None, None, True, True, ("NOT_MEANINGFUL", None, "CONTRADICTORY_NO_DEBT_EVIDENCE", "")),
    ],
)
def test_total_debt(spark, short, current, long, leases, present, evidence, expected):
    got = cells(
        spark, [(short, current, long, leases, present, evidence)],
        "s double, c double, l double, f double, p boolean, e boolean",
        lambda: M.total_debt(c("s"), c("c"), c("l"), leases=c("f"), balance_sheet_present=c("p"), no_debt_evidence=c("e")),
    )
    assert got == [expected]


def test_net_debt_and_equity_ratio(spark):
    df = spark.createDataFrame([(0, 10.0, 3.0, None, 4.0), (1, None, 3.0, 1.0, 4.0), (2, 10.0, None, 1.0, -4.0), (3, 10.0, 1.0, 1.0, 0.0)],
                               "i int, debt double, cash double, sti double, eq double")
    df = df.withColumn("d", M.total_debt(F.lit(0.0), F.col("debt"), F.lit(0.0), balance_sheet_present=F.lit(True)))
    df = df.withColumn("n", M.net_debt(F.col("d"), F.col("cash"), F.col("sti"))).withColumn("r", M.debt_to_equity(F.col("d"), F.col("eq")))
    got = df.select("i", *unpack(F.col("n"), "n_"), *unpack(F.col("r"), "r_")).orderBy("i").collect()
    assert [(g.n_state, g.n_value, g.n_reason) for g in got] == [
        ("OK", 7.0, None), ("MISSING_INPUT", None, "DEPENDS_ON_UNDEFINED_INPUT"), ("MISSING_INPUT", None, "CASH_NOT_REPORTED"),
        ("OK", 8.0, None),
    ]
    assert "ASSUMED_ZERO:short_term_investments" in got[0].n_flags
    assert [(g.r_state, g.r_reason) for g in got] == [
        ("OK", None), ("MISSING_INPUT", "DEPENDS_ON_UNDEFINED_INPUT"), ("NOT_MEANINGFUL", "NEGATIVE_EQUITY"), ("ZERO_DENOMINATOR", "ZERO_EQUITY"),
    ]


def test_missing_wins_over_other_states(spark):
    df = spark.range(1).select(
        M.margin(F.lit(1.0), F.lit(0.0)).alias("zero"), M.margin(F.lit(None), F.lit(1.0)).alias("gone"), M.margin(F.lit(1.0), F.lit(2.0)).alias("fine")
    )
    got = df.select(
        M.level_change(F.col("zero"), F.col("gone"))["state"], M.level_change(F.col("fine"), F.col("zero"))["state"],
        M.level_change(F.col("fine"), F.col("fine"))["value"],
    ).collect()[0]
    assert tuple(got) == ("MISSING_INPUT", "ZERO_DENOMINATOR", 0.0)


def test_drawdown(spark):
    got = cells(spark, [(65.0, 100.0), (101.0, 100.0), (100.0, 100.0), (None, 1.0), (1.0, 0.0)], "a double, b double",
                lambda: M.drawdown_from_high(c("a"), c("b")))
    assert [g[2] for g in got] == [None, "CLOSE_ABOVE_HIGH", None, "PRICE_MISSING", "PRICE_MISSING"]
    assert got[0][1] == pytest.approx(-0.35) and got[2][1] == 0.0


def test_issuer_market_cap(spark):
    got = cells(spark, [(5.0, 1), (5.0, 2), (None, 2), (0.0, 1)], "a double, n bigint", lambda: M.issuer_market_cap(c("a"), c("n")))
    assert got == [
        ("OK", 5.0, None, ""), ("OK", 5.0, None, "MULTI_CLASS_ALL_SHARES_AT_PRIMARY_PRICE"),
        ("MISSING_INPUT", None, "PRIMARY_LISTING_MARKET_CAP_MISSING", ""), ("MISSING_INPUT", None, "PRIMARY_LISTING_MARKET_CAP_MISSING", ""),
    ]


@pytest.mark.parametrize(
    ("start", "end", "kind"),
    [
        (None, "2024-12-31", "INSTANT"), ("2024-01-01", "2024-03-31", "QUARTER"), ("2024-01-01", "2024-06-30", "HALF_YEAR_YTD"),
        ("2024-01-01", "2024-09-30", "NINE_MONTH_YTD"), ("2023-10-01", "2024-09-28", "FISCAL_YEAR"),
        ("2024-01-01", "2025-01-04", "FISCAL_YEAR"), ("2024-01-01", "2024-02-10", "OTHER"), ("2024-01-01", "2025-03-01", "OTHER"),
    ],
)
def test_period_kind(spark, start, end, kind):
    df = spark.range(1).select(D.period_kind(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("k"))
    assert df.collect()[0].k == kind


def test_comparable_periods(spark):
    def reason(*p):
        return spark.range(1).select(D.comparable_year_over_year(*[F.lit(x).cast("date") for x in p])["reason"].alias("r")).collect()[0].r

    assert reason("2024-01-01", "2024-12-31", "2023-01-01", "2023-12-31") is None
    assert reason("2024-01-01", "2024-12-31", "2023-07-01", "2023-12-31") == "PERIOD_LENGTH_MISMATCH"
    assert reason("2024-01-01", "2024-12-31", "2022-01-01", "2022-12-31") == "NOT_ONE_YEAR_APART"
    assert reason("2024-01-01", "2024-02-10", "2023-01-01", "2023-02-10") == "PERIOD_LENGTH_MISMATCH"


@pytest.mark.parametrize(
    ("as_of", "horizon", "expected"),
    [("2026-03-31", {"months": 1}, "2026-02-28"), ("2024-03-31", {"months": 1}, "2024-02-29"), ("2024-02-29", {"years": 1}, "2023-02-28"),
     ("2026-01-15", {"months": 3}, "2025-10-15"), ("2026-01-15", {"days": 7}, "2026-01-08")],
)
def test_anchor_dates_clamp_to_month_ends(spark, as_of, horizon, expected):
    assert str(spark.range(1).select(D.anchor_date(as_of, **horizon).alias("x")).collect()[0].x) == expected


def test_business_days_against_counting(spark):
    import datetime as dt

    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(a), base + dt.timedelta(b)) for a in range(0, 14) for b in range(a, a + 25)]
    df = spark.createDataFrame(rows, "a date, b date")
    for r in df.select("a", "b", D.business_days_between(F.col("a"), F.col("b")).alias("n")).collect():
        days = [r.a + dt.timedelta(k) for k in range(1, (r.b - r.a).days)]
        assert r.n == sum(x.weekday() < 5 for x in days), r


def test_date_spellings(spark):
    df = spark.createDataFrame([("0926", "Jun 2026", "2026-10-01T00:00:00"), ("0229", "2026-02", " 2026-10-01"), ("1301", "Smarch 2026", "10/01/2026"), (" ", "June 2026", "")],
                               "a string, b string, c string")
    got = df.select(D.fiscal_year_end(F.col("a")).alias("a"), D.month_year(F.col("b")).cast("string").alias("b"), D.iso_date(F.col("c")).cast("string").alias("c")).collect()
    assert [tuple(g.a) if g.a else None for g in got] == [(9, 26), (2, 29), None, None]
    assert [g.b for g in got] == ["2026-06-30", "2026-02-28", None, "2026-06-30"]
    assert [g.c for g in got] == ["2026-10-01", "2026-10-01", None, None]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("320193", "0000320193"), (" CIK0000320193 ", "0000320193"), ("cik: 7", "0000000007"), ("000000000000007", "0000000007"), ("9999999999", "9999999999"),
     ("10000000000", None), ("0", None), ("", None), ("-5", None), ("3.5", None), ("12a", None)],
)
def test_normalize_cik(spark, raw, expected):
    assert spark.range(1).select(T.normalize_cik(F.lit(raw)).alias("x")).collect()[0].x == expected


def test_symbols(spark):
    df = spark.createDataFrame([("brk.b",), ("BRK/B",), (" aapl ",), ("BAC-PL",), ("",), ("TOO LONG A TICKER",)], "s string")
    got = [r.x for r in df.select(T.canonical_symbol(F.col("s")).alias("x")).collect()]
    assert got == ["BRK-B", "BRK-B", "AAPL", "BAC-PL", None, None]
    assert spark.range(1).select(T.provider_symbol(F.lit("BRK-B"), "cboe").alias("x")).collect()[0].x == "BRK.B"
    with pytest.raises(ValueError):
        T.provider_symbol(F.lit("A"), "nowhere")


def test_keys_keep_absent_parts(spark):
    row = spark.range(1).select(
        T.fact_key(F.lit("1"), F.lit("us-gaap"), F.lit("Cash"), F.lit("USD"), F.lit(None), F.lit("2024-12-31"), F.lit(None)).alias("k"),
        T.holder_key(F.lit(None), F.lit("  Vanguard |  Group  ")).alias("h"), T.holder_key(F.lit("7"), F.lit("x")).alias("c"),
        T.identity_text(F.lit("a|b")).alias("bad"),
    ).collect()[0]
    assert tuple(row) == ("1|us-gaap|Cash|USD||2024-12-31|", "vanguard group", "0000000007", None)


@pytest.mark.parametrize(
    ("value", "text"),
    [(1.5e12, "$1.50T"), (-2.345e9, "-$2.35B"), (1e6, "$1.00M"), (1234.0, "$1.23K"), (12.5, "$12.50"), (0.0, "$0.00")],
)
def test_money(spark, value, text):
    assert spark.range(1).select(T.money(F.lit(value)).alias("x")).collect()[0].x == text


def test_render(spark):
    df = spark.range(1).select(
        M.growth_rate(F.lit(112.34), F.lit(100.0)).alias("g"), M.growth_rate(F.lit(1.0), F.lit(0.0)).alias("z"), M.price_to_sales(F.lit(1234.5), F.lit(1.0)).alias("p")
    )
    got = df.select(
        T.render_metric(F.col("g"), F.lit("revenue_growth_yoy"), F.lit("fraction")), T.render_metric(F.col("z"), F.lit("revenue_growth_yoy"), F.lit("fraction")),
        T.render_metric(F.col("p"), F.lit("price_to_sales"), F.lit("ratio")), T.render_metric(F.col("g"), F.lit("gross_margin"), F.lit("fraction")),
    ).collect()[0]
    assert tuple(got) == ("+12.3%", "N/A (ZERO_DENOMINATOR: ZERO_BASE)", "1,234.50x", "12.3%")
