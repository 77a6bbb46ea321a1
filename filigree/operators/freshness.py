"""Stale prices and quotes never count as current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cell import missing
from ..reference_data import LISTING_METRICS, QUOTE_METRICS

# Fixed value: default age limit in calendar days.
MAX_PRICE_AGE_DAYS = 7


def is_stale(last: Column, as_of, max_age_days: int | None) -> Column:
    if max_age_days is None:
        return last.isNull()
    return last.isNull() | (F.datediff(F.lit(as_of).cast("date"), last) > max_age_days)


def freshness_record(rows: DataFrame, as_of, max_age_days: int | None = MAX_PRICE_AGE_DAYS) -> DataFrame:
    """Adds ages and block switches; ``rows`` has ``last_bar`` and ``quote_date``."""
    day = F.lit(as_of).cast("date")
    on = max_age_days is not None
    return rows.withColumns(
        {
            "as_of": day,
            "price_age_days": F.datediff(day, F.col("last_bar")),
            "quote_age_days": F.datediff(day, F.col("quote_date")),
            "price_metrics_blocked": is_stale(F.col("last_bar"), as_of, max_age_days) & F.lit(on),
            "quote_metrics_blocked": is_stale(F.col("quote_date"), as_of, max_age_days) & F.lit(on),
        }
    )


def _blocked(date: Column, none: str, stale: str) -> Column:
    return missing(F.when(date.isNull(), none).otherwise(F.concat(F.lit(stale), date.cast("string"))))


def block_listing(rows: DataFrame, as_of, max_age_days: int | None = MAX_PRICE_AGE_DAYS, names=LISTING_METRICS) -> DataFrame:
    """Replaces price metrics of listings whose newest bar is too old."""
    if max_age_days is None:
        return rows
    last = F.col("last_bar")
    stale = is_stale(last, as_of, max_age_days)
    why = _blocked(last, "NO_PRICE_DATA", "STALE_PRICE_DATA:last_bar=")
    return rows.withColumns({n: F.when(stale, why).otherwise(F.col(n)) for n in names if n in rows.columns})


def block_issuer(rows: DataFrame, as_of, max_age_days: int | None = MAX_PRICE_AGE_DAYS, names=QUOTE_METRICS) -> DataFrame:
    """Replaces quote-dependent issuer metrics when the primary listing's quote is too old."""
    if max_age_days is None:
        return rows
    quoted = F.col("quote_date")
    stale = is_stale(quoted, as_of, max_age_days)
    why = _blocked(quoted, "NO_QUOTE", "STALE_QUOTE:quote_date=")
    return rows.withColumns({n: F.when(stale, why).otherwise(F.col(n)) for n in names if n in rows.columns})
