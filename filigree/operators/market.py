"""Quotes, primary listings, issuer valuation and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cell import OK, flag_array, missing
from ..functions import metrics as M

# Fixed value: a quote older than this many days flags the market cap.
QUOTE_STALE_DAYS = 5


def newest_quotes(quotes: DataFrame, as_of=None) -> DataFrame:
    """Newest quote per listing; ``as_of`` hides later ones."""
    if as_of is not None:
        quotes = quotes.where(F.col("quote_date") <= F.lit(as_of).cast("date"))
    return (
        quotes.groupBy("security_id")
        .agg(F.max_by(F.struct("last_price", "market_cap", "year_high", "year_low"), "quote_date").alias("q"),
             F.max("quote_date").alias("quote_date"))
        .select("security_id", "quote_date", "q.*")
    )


def primary_listings(securities: DataFrame, designations: DataFrame | None = None) -> DataFrame:
    """Per issuer: primary ticker, how it was chosen, number of listings.

    ``designations`` (ticker, primary_ticker) names primary listings; without one the first
    ticker in the alphabet is used and the choice says so.
    """
    listed = securities.where(F.col("cik").isNotNull())
    if designations is None:
        listed = listed.withColumn("primary_ticker", F.lit(None).cast("string"))
    else:
        listed = listed.join(designations.select("ticker", "primary_ticker"), "ticker", "left")
    per_issuer = listed.groupBy("cik").agg(
        F.count("*").alias("listings"),
        F.min("ticker").alias("first_ticker"),
        F.min_by("primary_ticker", F.when(F.col("primary_ticker").isNotNull(), F.col("ticker"))).alias("designated"),
        F.max(F.col("multi_class_role") if "multi_class_role" in securities.columns else F.lit(False)).alias("multi_role"),
    )
    loaded = listed.select("cik", F.col("ticker").alias("designated"), F.lit(True).alias("loaded")).distinct()
    chosen = per_issuer.join(loaded, ["cik", "designated"], "left")
    how = F.when(F.col("designated").isNull(), "UNDESIGNATED_FIRST_LISTING").when(
        F.col("loaded").isNull(), "FALLBACK_DESIGNATED_PRIMARY_NOT_LOADED"
    ).otherwise("DESIGNATED")
    return chosen.select(
        "cik",
        F.when(F.col("loaded"), F.col("designated")).otherwise(F.col("first_ticker")).alias("primary_ticker"),
        how.alias("designation"),
        "listings",
        ((F.col("listings") > 1) | F.coalesce("multi_role", F.lit(False))).alias("multi_class"),
    )


def issuer_quotes(securities: DataFrame, primaries: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per issuer the newest quote of its primary listing."""
    primary = primaries.join(
        securities.select("cik", F.col("ticker").alias("primary_ticker"), "security_id"), ["cik", "primary_ticker"]
    )
    joined = primary.join(quotes, "security_id", "left")
    # a ticker may be stored twice for an issuer; one of them stands for it
    return joined.groupBy("cik").agg(
        F.min_by(
            F.struct("primary_ticker", "designation", "listings", "multi_class", "security_id", "quote_date",
                     "market_cap"),
            "security_id",
        ).alias("p")
    ).select("cik", "p.*").withColumnRenamed("security_id", "primary_security_id")


def market_cap(cap: Column, listings: Column, quote_date: Column, as_of) -> Column:
    """Issuer market cap with a flag when its quote is old."""
    age = F.datediff(F.lit(as_of).cast("date"), quote_date)
    stale = F.when(age > QUOTE_STALE_DAYS, F.concat(F.lit("QUOTE_STALE:"), age.cast("string"), F.lit("D")))
    return M.issuer_market_cap(cap, listings, stale)


def ok_value(c: Column) -> Column:
    return F.when(c["state"] == OK, c["value"])


VALUATION_METRICS = ("price_to_sales", "price_to_sales_ttm")


def valuation_metrics(row: DataFrame, unavailable: Column, wanted=VALUATION_METRICS) -> DataFrame:
    """Price-to-sales ratios, those that are wanted. ``unavailable`` names why an issuer has no fundamentals (NULL: it has)."""
    gone, made = unavailable.isNotNull(), {}
    if "price_to_sales" in wanted:
        cap = F.col("issuer_market_cap")
        cap_flag = flag_array(F.when(cap["state"] != OK, F.concat(F.lit("MARKET_CAP:"), cap["reason"])))
        made["price_to_sales"] = (
            F.when(gone, missing(unavailable, cap_flag))
            .when(cap["state"] != OK, missing("MARKET_CAP_MISSING", cap_flag))
            .otherwise(M.price_to_sales(cap["value"], F.col("revenue")["value"]))
        )
    if "price_to_sales_ttm" in wanted:
        made["price_to_sales_ttm"] = F.when(gone, missing(unavailable)).otherwise(
            M.price_to_sales(ok_value(F.col("issuer_market_cap")), ok_value(F.col("revenue_ttm")))
        )
    return row.withColumns(made)


def year_high_difference(high: Column, provider_high: Column) -> Column:
    """Own 52-week high against the provider's, where both exist."""
    return F.when((high["state"] == OK) & (provider_high != 0), F.try_divide(high["value"], provider_high) - 1)


def market_cap_check(
    cap: Column, shares: Column, last_traded_close: Column, multi_class: Column, unavailable: Column
) -> Column:
    """STRUCT<eligible, reason, ratio_minus_one>: quoted cap against close x cover-page shares."""
    reason = (
        F.when(multi_class, "MULTI_CLASS_ISSUER")
        .when(unavailable.isNotNull(), F.concat(F.lit("FACTS_UNAVAILABLE:"), unavailable))
        .when(cap["state"] != OK, F.concat(F.lit("MARKET_CAP:"), cap["reason"]))
        .when(shares["state"] != OK, F.concat(F.lit("SHARES_UNRELIABLE:"), shares["reason"]))
        .when(last_traded_close.isNull(), "NO_CLOSE")
    )
    ratio = F.try_divide(cap["value"], last_traded_close * shares["value"]) - 1
    return F.struct(
        reason.isNull().alias("eligible"),
        reason.alias("reason"),
        F.when(reason.isNull(), ratio).alias("ratio_minus_one"),
    )
