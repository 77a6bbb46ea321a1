"""Daily bars: checks, repeats, gaps, re-bases, 52-week ranges and anchored returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cell import OK, absent, flag_array, missing, usable
from ..functions import dates as D
from ..functions import metrics as M
from ..reference_data import RETURN_HORIZONS
from .keyed import last_per_key, repeats_per_key

# Price tolerances and thresholds.
RANGE_TOLERANCE = 0.0001
GAP_BUSINESS_DAYS = 5
REBASE_TOLERANCE = 0.001
REBASE_MIN_OVERLAP = 5
WINDOW_DAYS = 365
BAR_KEY = ["security_id", "trade_date"]
BAR_PAYLOAD = ["open", "high", "low", "close", "volume"]


def bar_problem() -> Column:
    """Why a row is not a plausible bar; NULL when it is one. The first failing check names it."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (
        F.when(F.col("trade_date").isNull(), "BAD_DATE")
        .when(c.isNull() | (c <= 0), "NO_POSITIVE_CLOSE")
        .when((o <= 0) | (h <= 0) | (lo <= 0), "NON_POSITIVE_PRICE")
        .when(h < lo, "HIGH_BELOW_LOW")
        .when((c > h * (1 + RANGE_TOLERANCE)) | (c < lo * (1 - RANGE_TOLERANCE)), "CLOSE_OUTSIDE_RANGE")
        .when(F.col("volume") < 0, "NEGATIVE_VOLUME")
    )


def with_problem(rows: DataFrame) -> DataFrame:
    clean = rows.withColumns({c: usable(F.col(c)) for c in ("open", "high", "low", "close")})
    return clean.withColumn("problem", bar_problem())


def accepted(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """Plausible bars, one per security and date: the last arrival wins."""
    good = with_problem(rows).where(F.col("problem").isNull())
    return last_per_key(good, BAR_KEY, arrival, BAR_PAYLOAD)


def rejects(rows: DataFrame) -> DataFrame:
    return with_problem(rows).where(F.col("problem").isNotNull())


def reject_counts(rows: DataFrame) -> DataFrame:
    return rejects(rows).groupBy("security_id", F.col("problem").alias("reason")).agg(F.count("*").alias("rows"))


def duplicate_bars(rows: DataFrame, arrival: list[str]) -> DataFrame:
    good = with_problem(rows).where(F.col("problem").isNull())
    return repeats_per_key(good, BAR_KEY, arrival, BAR_PAYLOAD)


def gaps(bars: DataFrame, threshold: int = GAP_BUSINESS_DAYS) -> DataFrame:
    """Consecutive bars with more than ``threshold`` weekdays between them.

    Bars are unique per security and date, so a window partition is bounded by the calendar.
    """
    w = Window.partitionBy("security_id").orderBy("trade_date")
    pairs = bars.select("security_id", "trade_date", F.lead("trade_date").over(w).alias("next_date"))
    far = pairs.where(F.datediff("next_date", "trade_date") > threshold + 1)
    return far.withColumn("business_days", D.business_days_between(F.col("trade_date"), F.col("next_date"))).where(
        F.col("business_days") > threshold
    )


def split_rebase(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upper median of new/stored closes per security, and whether it shows a re-based history.

    The upper median is the lower one of the reversed order. Values per security are
    bounded by its dates, since both sides are unique per security and date.
    """
    old = stored.where(F.col("close") != 0).select(*BAR_KEY, F.col("close").alias("old_close"))
    ratios = new.where(F.col("close") != 0).join(old, BAR_KEY).withColumn(
        "ratio", F.try_divide(F.col("close"), F.col("old_close"))
    )
    return (
        ratios.groupBy("security_id")
        .agg(
            F.count("*").alias("overlap"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio DESC)").alias("median_ratio"),
        )
        .withColumn(
            "rebased",
            (F.col("overlap") >= REBASE_MIN_OVERLAP) & (F.abs(F.col("median_ratio") - 1) > REBASE_TOLERANCE),
        )
    )


def last_bars(bars: DataFrame) -> DataFrame:
    """Newest bar per listing; its close may be absent."""
    return bars.groupBy("security_id").agg(
        F.max("trade_date").alias("last_bar"), F.max_by("close", "trade_date").alias("last_close")
    )


def listing_aggregates(bars: DataFrame, as_of) -> DataFrame:
    """Everything the price metrics of one date need, in one aggregate per listing.

    All aggregates merge partial results, so a listing with very many rows does not
    end up in one task. Bars after ``as_of`` only count for ``newest_bar``.
    """
    day = F.lit(as_of).cast("date")
    date = F.when(F.col("trade_date") <= day, F.col("trade_date"))
    close, high, low = (usable(F.col(c)) for c in ("close", "high", "low"))
    known = F.when(close.isNotNull(), date)
    traded = F.when(F.coalesce(F.col("close"), F.lit(0.0)) != 0, date)
    in_window = F.col("trade_date").between(F.date_sub(day, WINDOW_DAYS), day)
    aggs = [
        F.max("trade_date").alias("newest_bar"),
        F.max(date).alias("last_bar"),
        F.max_by("close", date).alias("last_close"),
        F.max_by("close", known).alias("last_known_close"),
        F.max_by("close", traded).alias("last_traded_close"),
        F.max(F.when(in_window, high)).alias("high_max"),
        F.count(F.when(in_window, high)).alias("high_days"),
        F.min(F.when(in_window, low)).alias("low_min"),
        F.count(F.when(in_window, low)).alias("low_days"),
        F.max(F.when(in_window, close)).alias("close_max"),
        F.min(F.when(in_window, close)).alias("close_min"),
        F.count(F.when(in_window, close)).alias("close_days"),
    ]
    for name, horizon in RETURN_HORIZONS.items():
        at = F.when(F.col("trade_date") <= D.anchor_date(day, **horizon), known)
        aggs += [F.max(at).alias(f"{name}_date"), F.max_by("close", at).alias(f"{name}_close")]
    return bars.groupBy("security_id").agg(*aggs)


def window_metrics(agg: DataFrame) -> DataFrame:
    return agg.withColumns(
        {
            "high_52w": M.window_extreme(F.col("high_max"), F.col("high_days")),
            "low_52w": M.window_extreme(F.col("low_min"), F.col("low_days")),
            "high_52w_close": M.window_extreme(F.col("close_max"), F.col("close_days")),
            "low_52w_close": M.window_extreme(F.col("close_min"), F.col("close_days")),
        }
    )


def drawdown_metrics(windows: DataFrame) -> DataFrame:
    last = F.col("last_close")
    return windows.withColumns(
        {
            "drawdown_from_52w_high": M.drawdown_from_high(last, F.col("high_52w.value")),
            "drawdown_from_52w_closing_high": M.drawdown_from_high(last, F.col("high_52w_close.value")),
        }
    )


def return_metrics(agg: DataFrame, as_of) -> DataFrame:
    return agg.withColumns(
        {
            name: M.lookback_return(
                F.col("last_known_close"), F.col(f"{name}_close"), F.col(f"{name}_date"),
                D.anchor_date(as_of, **horizon),
            )
            for name, horizon in RETURN_HORIZONS.items()
        }
    )


def price_metrics(bars: DataFrame, as_of) -> DataFrame:
    """Six returns, 52-week range and drawdowns per listing."""
    return return_metrics(drawdown_metrics(window_metrics(listing_aggregates(bars, as_of))), as_of)


def price_to_earnings(last_close: Column, eps: Column, multi_class: Column) -> Column:
    """P/E at the listing's last close; an EPS without a value passes its state on."""
    has_price = usable(last_close) > 0
    reason = F.concat(F.lit("EPS_TTM:"), F.coalesce(eps["reason"], F.lit("None")))
    flags = flag_array(F.when(multi_class, "MULTI_CLASS_PER_SHARE_BASIS_UNVERIFIED"))
    return F.when(
        (eps["state"] != OK) & (has_price | (last_close < 0)), absent(eps["state"], reason, flags)
    ).otherwise(M.price_to_earnings(last_close, F.when(eps["state"] == OK, eps["value"]), flags))


def no_bars() -> dict[str, Column]:
    """Cells of a listing without any bar."""
    out = {name: missing("PRICE_MISSING") for name in RETURN_HORIZONS}
    out |= {name: missing("INSUFFICIENT_HISTORY") for name in ("high_52w", "high_52w_close")}
    out |= {name: missing("PRICE_MISSING") for name in ("drawdown_from_52w_high", "drawdown_from_52w_closing_high")}
    return out
