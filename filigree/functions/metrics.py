"""Metric definitions as Column expressions. Every function returns a metric cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cell import (
    NOT_COMPARABLE,
    NOT_MEANINGFUL,
    ZERO_DENOMINATOR,
    absent,
    blocked_by,
    flag_array,
    missing,
    ok,
    usable,
)

__all__ = [
    "growth_rate", "margin", "gross_profit_from_components", "level_change", "free_cash_flow", "total_debt",
    "net_debt", "debt_to_equity", "price_to_sales", "price_to_earnings", "price_return", "drawdown_from_high",
    "issuer_market_cap", "window_extreme", "lookback_return", "consistent_report_period", "benchmark_relative",
]

PRICE_ONLY_FLAG = "PRICE_RETURN_EXCLUDES_DIVIDENDS"
# Windows and tolerances.
MAX_ANCHOR_GAP_DAYS = 7
MIN_WINDOW_DAYS = 20
FULL_WINDOW_DAYS = 240
HIGH_TOLERANCE = 1e-9


def growth_rate(current: Column, prior: Column, flags: Column | None = None) -> Column:
    now, base = usable(current), usable(prior)
    return (
        F.when(now.isNull() | base.isNull(), missing("MISSING_VALUE"))
        .when(base == 0, absent(ZERO_DENOMINATOR, "ZERO_BASE"))
        .when((base < 0) & (now <= 0), absent(NOT_MEANINGFUL, "NEGATIVE_BASE"))
        .when((base < 0) | (now < 0), absent(NOT_MEANINGFUL, "SIGN_CHANGE"))
        .otherwise(ok(F.try_divide(now, base) - 1, flags))
    )


def margin(numerator: Column, revenue: Column) -> Column:
    top, rev = usable(numerator), usable(revenue)
    return (
        F.when(top.isNull() | rev.isNull(), missing("MISSING_VALUE"))
        .when(rev == 0, absent(ZERO_DENOMINATOR, "ZERO_REVENUE"))
        .when(rev < 0, absent(NOT_MEANINGFUL, "NEGATIVE_REVENUE"))
        .otherwise(ok(F.try_divide(top, rev)))
    )


def gross_profit_from_components(revenue: Column, cost_of_revenue: Column) -> Column:
    rev, cost = usable(revenue), usable(cost_of_revenue)
    return F.when(rev.isNull() | cost.isNull(), missing("COST_OF_REVENUE_NOT_REPORTED")).otherwise(
        ok(rev - cost, flag_array("DERIVED_GROSS_PROFIT"))
    )


def level_change(now: Column, prior: Column) -> Column:
    """Difference of two metric cell columns (margin change, leverage change)."""
    return F.coalesce(blocked_by(now, prior), ok(now["value"] - prior["value"]))


def free_cash_flow(operating_cash_flow: Column, capex: Column, flags: Column | None = None) -> Column:
    cfo, spent = usable(operating_cash_flow), usable(capex)
    return (
        F.when(cfo.isNull(), missing("OPERATING_CASH_FLOW_MISSING"))
        .when(spent.isNull(), missing("CAPEX_NOT_REPORTED"))
        .otherwise(ok(cfo - F.abs(spent), flags))
    )


def total_debt(
    short_term: Column,
    current_portion: Column,
    long_term: Column,
    *,
    balance_sheet_present: Column,
    leases: Column | None = None,
    no_debt_evidence: Column | None = None,
) -> Column:
    """Sum of the debt lines. The two long-term lines are required, the others optional and flagged.

    Zero is never read out of absence: only reported zeros, or explicit evidence of no debt, give 0.
    """
    short, current, long = usable(short_term), usable(current_portion), usable(long_term)
    lease = usable(F.lit(None) if leases is None else leases)
    evidence = F.lit(False) if no_debt_evidence is None else no_debt_evidence
    parts = (current, long, short, lease)
    negative = F.least(*[F.coalesce(p, F.lit(0.0)) for p in parts]) < 0
    zero = F.lit(0.0)
    total = (F.coalesce(current, zero) + F.coalesce(long, zero)) + F.coalesce(short, zero) + F.coalesce(lease, zero)
    absent_core = F.concat_ws(
        ",",
        F.when(current.isNull(), "current_portion_long_term_debt"),
        F.when(long.isNull(), "long_term_debt"),
    )
    flags = flag_array(
        F.when(short.isNull(), "SHORT_TERM_DEBT_NOT_REPORTED"),
        F.when(lease.isNull(), "FINANCE_LEASES_NOT_REPORTED"),
    )
    return (
        F.when(negative, absent(NOT_MEANINGFUL, "NEGATIVE_DEBT_COMPONENT"))
        .when(~balance_sheet_present, missing("NO_BALANCE_SHEET"))
        .when(evidence & (total > 0), absent(NOT_MEANINGFUL, "CONTRADICTORY_NO_DEBT_EVIDENCE"))
        .when(evidence, ok(0.0, flag_array("EXPLICIT_NO_DEBT_EVIDENCE")))
        .when(absent_core != "", missing(F.concat(F.lit("DEBT_COMPONENT_ABSENT:"), absent_core)))
        .otherwise(ok(total, flags))
    )


def net_debt(debt: Column, cash: Column, short_term_investments: Column) -> Column:
    held, invested = usable(cash), usable(short_term_investments)
    flags = F.concat(debt["flags"], flag_array(F.when(invested.isNull(), "ASSUMED_ZERO:short_term_investments")))
    return F.coalesce(
        blocked_by(debt),
        F.when(held.isNull(), missing("CASH_NOT_REPORTED")).otherwise(
            ok(debt["value"] - (held + F.coalesce(invested, F.lit(0.0))), flags)
        ),
    )


def debt_to_equity(debt: Column, equity: Column) -> Column:
    eq = usable(equity)
    return F.coalesce(
        blocked_by(debt),
        F.when(eq.isNull(), missing("EQUITY_NOT_REPORTED"))
        .when(eq == 0, absent(ZERO_DENOMINATOR, "ZERO_EQUITY"))
        .when(eq < 0, absent(NOT_MEANINGFUL, "NEGATIVE_EQUITY"))
        .otherwise(ok(F.try_divide(debt["value"], eq), debt["flags"])),
    )


def price_to_sales(market_cap: Column, revenue: Column) -> Column:
    cap, rev = usable(market_cap), usable(revenue)
    return (
        F.when(cap.isNull() | (cap <= 0), missing("MARKET_CAP_MISSING"))
        .when(rev.isNull(), missing("REVENUE_MISSING"))
        .when(rev == 0, absent(ZERO_DENOMINATOR, "ZERO_REVENUE"))
        .when(rev < 0, absent(NOT_MEANINGFUL, "NEGATIVE_REVENUE"))
        .otherwise(ok(F.try_divide(cap, rev)))
    )


def price_to_earnings(price: Column, eps: Column, flags: Column | None = None) -> Column:
    px, earned = usable(price), usable(eps)
    return (
        F.when(px.isNull() | (px <= 0), missing("PRICE_MISSING", flags))
        .when(earned.isNull(), missing("EPS_MISSING", flags))
        .when(earned == 0, absent(ZERO_DENOMINATOR, "ZERO_EPS", flags))
        .when(earned < 0, absent(NOT_MEANINGFUL, "NEGATIVE_EARNINGS", flags))
        .otherwise(ok(F.try_divide(px, earned), flags))
    )


def price_return(close_now: Column, close_then: Column) -> Column:
    now, then = usable(close_now), usable(close_then)
    return F.when(now.isNull() | then.isNull() | (then <= 0), missing("PRICE_MISSING")).otherwise(
        ok(F.try_divide(now, then) - 1, flag_array(PRICE_ONLY_FLAG))
    )


def lookback_return(
    last_close: Column, base_close: Column, base_date: Column, anchor: Column, max_gap_days: int = MAX_ANCHOR_GAP_DAYS
) -> Column:
    """Return from the base close at or before ``anchor`` to the last close."""
    return (
        F.when(last_close.isNull(), missing("PRICE_MISSING"))
        .when(base_date.isNull(), missing("INSUFFICIENT_HISTORY"))
        .when(F.datediff(anchor, base_date) > max_gap_days, missing("BASE_PRICE_STALE"))
        .otherwise(price_return(last_close, base_close))
    )


def drawdown_from_high(close: Column, high: Column) -> Column:
    c, h = usable(close), usable(high)
    return (
        F.when(c.isNull() | h.isNull() | (h <= 0) | (c <= 0), missing("PRICE_MISSING"))
        .when(c > h * (1 + HIGH_TOLERANCE), absent(NOT_MEANINGFUL, "CLOSE_ABOVE_HIGH"))
        .otherwise(ok(F.try_divide(c, h) - 1))
    )


def window_extreme(extreme: Column, days: Column) -> Column:
    """52-week high or low from its aggregate and the number of days behind it."""
    return F.when(F.coalesce(days, F.lit(0)) < MIN_WINDOW_DAYS, missing("INSUFFICIENT_HISTORY")).otherwise(
        ok(extreme, flag_array(F.when(days < FULL_WINDOW_DAYS, "PARTIAL_WINDOW")))
    )


def issuer_market_cap(primary_cap: Column, listings: Column, *more_flags: Column) -> Column:
    """The designated primary listing's cap. Listings are never summed."""
    cap = usable(primary_cap)
    return (
        F.when(listings < 1, missing("NO_LISTINGS"))
        .when(cap.isNull() | (cap <= 0), missing("PRIMARY_LISTING_MARKET_CAP_MISSING"))
        .otherwise(ok(cap, flag_array(F.when(listings > 1, "MULTI_CLASS_ALL_SHARES_AT_PRIMARY_PRICE"), *more_flags)))
    )


def consistent_report_period(rows: Column, undated: Column, first: Column, last: Column) -> Column:
    """May holder rows be summed? From count, undated count and the first and last report date."""
    return (
        F.when((F.coalesce(rows, F.lit(0)) == 0) | (undated > 0), missing("REPORT_DATE_MISSING"))
        .when(first != last, absent(NOT_COMPARABLE, "MIXED_REPORT_PERIODS"))
        .otherwise(ok(1.0))
    )


def benchmark_relative(own: Column, benchmark: Column) -> Column:
    """Own return minus the benchmark's (both columns), same date and horizon; a side without a value passes its reason on."""
    blocked = F.when(own["state"] != "OK", absent(own["state"], own["reason"])).when(
        benchmark["state"] != "OK", absent(benchmark["state"], benchmark["reason"])
    )
    return F.coalesce(blocked, ok(own["value"] - benchmark["value"]))
