"""Filing events and evidence rows. Items stay rows; nothing is gathered per company."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cell import OK
from ..functions import text as T
from ..functions.metrics import consistent_report_period
from ..reference_data import (
    AUTOMATIC_SALE_WORDING,
    CURRENT_REPORT_FORMS,
    EXHIBITS_ITEM,
    FILING_SECTIONS,
    FORM4_CLASS,
    FORM4_WORDING,
    FORM_SECTION,
    ITEM_SECTION,
    ITEM_TITLES,
    MARKET_SIGNAL_CLASSES,
    METRIC,
    SECTION_CAVEATS,
    SECTIONS,
    WEB_ONLY_SECTIONS,
)
from ..sources.documents import resolve


def constant_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def _look_up(d: dict[str, str], key: Column) -> Column:
    return F.try_element_at(constant_map(d), key)


# --- filings -------------------------------------------------------------------------------------------------------


def placements(form: Column, items: Column) -> Column:
    """ARRAY<STRUCT<section, codes>> of one filing; empty for forms that are not evidence.

    A current report goes to the section of each of its items. The exhibits item never
    places a filing, and a report whose items are all unmapped goes to 'other'.
    """
    f = F.upper(F.trim(form))
    codes = F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    placing = F.filter(codes, lambda c: c != EXHIBITS_ITEM)

    def section_of(code: Column) -> Column:
        return F.coalesce(_look_up(ITEM_SECTION, code), F.lit("other"))

    def placed(section: Column, of: Column) -> Column:
        return F.struct(section.alias("section"), of.alias("codes"))

    none = F.array().cast("array<string>")
    by_item = F.transform(
        F.array_distinct(F.transform(placing, section_of)),
        lambda s: placed(s, F.filter(placing, lambda c: section_of(c) == s)),
    )
    current = F.when(F.size(placing) > 0, by_item).otherwise(F.array(placed(F.lit("other"), codes)))
    out = F.when(f.isin(*CURRENT_REPORT_FORMS), current)
    for section, forms in FORM_SECTION.items():
        out = out.when(f.isin(*forms), F.array(placed(F.lit(section), none)))
    return F.coalesce(out, F.array().cast("array<struct<section:string,codes:array<string>>>"))


def filing_items(filings: DataFrame, companies: DataFrame, since=None) -> DataFrame:
    """One evidence row per filing and section, with id, dates, text, URL and caveat."""
    rows = filings.where(F.col("filing_date").isNotNull())
    if since is not None:
        rows = rows.where(F.col("filing_date") >= F.lit(since).cast("date"))
    rows = rows.join(companies.select("cik", "ticker"), "cik").select(
        "*", F.explode(placements(F.col("form"), F.col("items"))).alias("p")
    )
    codes = F.array_join("p.codes", ",")
    titles = F.array_join(
        F.transform("p.codes", lambda c: F.concat(c, F.lit(" "), F.coalesce(_look_up(ITEM_TITLES, c), F.lit("item")))), "; "
    )
    content = F.concat(
        F.lit("Form "), "form", F.lit(" filed "), F.col("filing_date").cast("string"),
        F.when(F.size("p.codes") > 0, F.concat(F.lit(" (items: "), titles, F.lit(")"))).otherwise(""),
    )
    return rows.select(
        T.item_id(F.col("p.section"), F.col("ticker"), F.col("accession_no"), codes).alias("item_id"),
        F.col("p.section").alias("section"),
        "ticker",
        "cik",
        F.coalesce("report_date", "filing_date").alias("as_of"),
        F.col("filing_date").alias("filed"),
        content.alias("content"),
        codes.alias("codes"),
        "accession_no",
        T.filing_url(F.col("cik"), F.col("accession_no"), F.col("primary_document")).alias("url"),
        _look_up(SECTION_CAVEATS, F.col("p.section")).alias("caveat"),
    )


def events_report(symbols: DataFrame, ticker_map: DataFrame, filings: DataFrame, since) -> DataFrame:
    """Filing items of every symbol that resolves to exactly one issuer."""
    resolved = resolve(symbols, ticker_map).where(F.col("cik").isNotNull())
    return filing_items(filings, resolved, since)


def filing_window(filings: DataFrame, since) -> DataFrame:
    """Per issuer what its filing list covered, and how many filings since then had an unclassified form."""
    skipped = (F.col("filing_date") >= F.lit(since).cast("date")) & (F.size(placements(F.col("form"), F.col("items"))) == 0)
    return filings.where(F.col("filing_date").isNotNull()).groupBy("cik").agg(
        F.min("filing_date").alias("oldest"),
        F.max("filing_date").alias("newest"),
        F.count_if(skipped).alias("not_classified"),
    )


def skipped_forms(filings: DataFrame, since) -> DataFrame:
    rows = filings.where(F.col("filing_date") >= F.lit(since).cast("date"))
    rows = rows.where(F.size(placements(F.col("form"), F.col("items"))) == 0)
    return rows.groupBy("cik", "form").agg(F.count("*").alias("filings"))


# --- metric evidence -------------------------------------------------------------------------------------------------

# Metrics per section and item title.
METRIC_ITEMS = (
    ("price", "Price returns", (
        "price_return_1m", "price_return_3m", "price_return_6m", "price_return_1y", "price_return_3y", "price_return_5y")),
    ("price", "52-week range", (
        "drawdown_from_52w_high", "drawdown_from_52w_closing_high", "high_52w", "high_52w_close")),
    ("fundamentals", "Growth", ("revenue_growth_yoy", "eps_growth_yoy", "fcf_growth_yoy", "revenue_growth_ttm_yoy")),
    ("fundamentals", "Margins", (
        "gross_margin", "operating_margin", "net_margin", "gross_margin_change_yoy", "operating_margin_change_yoy",
        "net_margin_change_yoy")),
    ("fundamentals", "Cash flow and earnings", ("fcf", "revenue_ttm", "diluted_eps_ttm")),
    ("balance_sheet", "Balance sheet and leverage", (
        "total_debt", "net_debt", "debt_to_equity", "debt_to_equity_fy", "debt_to_equity_prior_fy",
        "debt_to_equity_change_yoy", "shares_outstanding")),
    ("valuation", "Valuation", ("issuer_market_cap", "price_to_sales", "price_to_sales_ttm", "price_to_earnings")),
)


def metric_items(views: DataFrame, as_of) -> DataFrame:
    """One evidence row per listing, section and title, with its text and the metrics that have no value.

    Issuers without fundamentals get no fundamental items; nothing is made up for them.
    """
    day = F.lit(as_of).cast("date")
    items = []
    for section, title, names in METRIC_ITEMS:
        names = [n for n in names if n in views.columns]
        if not names:
            continue
        shown = [F.concat(F.lit(n.replace("_", " ") + " "), T.render_metric(F.col(n), F.lit(n), F.lit(METRIC[n][2]))) for n in names]
        gaps = F.filter(
            F.array(*[
                F.when(F.col(n)["state"] != OK, F.concat_ws(" ", F.lit(n), F.col(n)["state"], F.col(n)["reason"])) for n in names
            ]),
            lambda g: g.isNotNull(),
        )
        date = F.col("last_bar") if section == "price" else day
        items.append(
            F.struct(
                F.lit(section).alias("section"),
                F.lit(title).alias("title"),
                date.alias("as_of"),
                F.concat(F.lit(title + ": "), F.concat_ws("; ", *shown)).alias("content"),
                F.array_join(gaps, "; ").alias("missing"),
            )
        )
    rows = views.select("ticker", "cik", F.col("unavailable") if "unavailable" in views.columns else F.lit(None).alias("unavailable"),
                        F.inline(F.array(*items)))
    rows = rows.where(F.col("unavailable").isNull() | ~F.col("section").isin("fundamentals", "balance_sheet"))
    ident = T.item_id(F.col("section"), F.col("ticker"), F.col("title"), F.col("as_of"))
    return rows.select(ident.alias("item_id"), "section", "title", "ticker", "cik", "as_of", "content", "missing")


def metric_item_counts(listings: DataFrame) -> DataFrame:
    """How many rows ``metric_items`` has per issuer and section, from the listings (cik, unavailable) alone: no metric is computed."""
    titles = Counter(section for section, _, _ in METRIC_ITEMS)
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("n")) for s, n in titles.items()])
    rows = listings.select("cik", "unavailable", F.inline(sections))
    rows = rows.where(F.col("unavailable").isNull() | ~F.col("section").isin("fundamentals", "balance_sheet"))
    return rows.groupBy("cik", "section").agg(F.sum("n").alias("items"))


def section_counts(filings: DataFrame, metrics: DataFrame, annual: DataFrame, companies: DataFrame) -> DataFrame:
    """Evidence rows per issuer and section: filing items, metric items (counted), annual figures and the company's identity."""
    one = F.lit(1).cast("bigint").alias("items")
    parts = (
        filings.select("cik", "section", one), metrics.select("cik", "section", "items"),
        annual.select("cik", F.lit("earnings").alias("section"), one), companies.select("cik", F.lit("identity").alias("section"), one),
    )
    return reduce(DataFrame.unionByName, parts).groupBy("cik", "section").agg(F.sum("items").alias("items"))


ANNUAL_LINES = ("revenue", "net_income_to_common", "diluted_eps", "operating_cash_flow", "capex")


def annual_report_items(lines: DataFrame) -> DataFrame:
    """Latest fiscal-year figures per issuer, from its line selections; issuers without any are left out."""

    def piece(line: str) -> Column:
        value = F.col(line)["value"]
        shown = F.concat(F.lit("$"), F.format_number(value, 2)) if line == "diluted_eps" else T.money(value)
        return F.when(value.isNotNull(), F.concat(F.lit(line.replace("_", " ") + " "), shown))

    known = F.concat_ws("; ", *[piece(line) for line in ANNUAL_LINES])
    filed = F.coalesce(*[F.when(F.col(line)["value"].isNotNull(), F.col(line)["filed"]) for line in ANNUAL_LINES])
    rows = lines.where(known != "")
    return rows.select(
        "cik", F.col("fy_end").alias("as_of"), filed.alias("filed"),
        F.concat(F.lit("Latest fiscal year reported: "), known).alias("content"),
    )


def section_status(companies: DataFrame, item_counts: DataFrame, *, collected=True) -> DataFrame:
    """All 16 sections of every company with their item count and status.

    ``item_counts`` has (cik, section, items); ``companies`` may have ``unavailable`` (why no fundamentals exist).
    """
    gone = F.col("unavailable") if "unavailable" in companies.columns else F.lit(None).cast("string")
    skeleton = companies.select(
        "cik", "ticker", gone.alias("unavailable"), F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section")
    )
    rows = skeleton.join(item_counts, ["cik", "section"], "left")
    n = F.coalesce("items", F.lit(0)).cast("bigint")
    status = (
        F.when(F.col("section").isin(*WEB_ONLY_SECTIONS), "NOT_COLLECTED")
        .when(F.col("section").isin("fundamentals", "balance_sheet") & F.col("unavailable").isNotNull(), "UNSUPPORTED")
        .when(n > 0, "OK")
        .when(F.col("section").isin("price", "fundamentals", "balance_sheet"), "UNAVAILABLE")
        .when(F.col("section").isin(*FILING_SECTIONS) & F.lit(not collected), "NOT_COLLECTED")
        .otherwise("NONE_FOUND")
    )
    return rows.select("ticker", "cik", "section", n.alias("items"), status.alias("status"))


# --- insiders and holders --------------------------------------------------------------------------------------------


def classify_form4(code: Column) -> Column:
    return F.coalesce(_look_up(FORM4_CLASS, F.upper(F.trim(code))), F.lit("UNKNOWN"))


def classify_form4_wording(text: Column) -> Column:
    """The class of a transaction given in words; only the exact wordings count."""
    t = F.trim(text)
    return F.when(t == AUTOMATIC_SALE_WORDING, "OPEN_MARKET_SELL").otherwise(classify_form4(_look_up(FORM4_WORDING, t)))


def is_market_signal(kind: Column) -> Column:
    return kind.isin(*MARKET_SIGNAL_CLASSES)


def insider_classes(ownership: DataFrame) -> DataFrame:
    """Transactions, shares and the market signal per issuer and class."""
    kind = classify_form4(F.col("transaction_code"))
    return (
        ownership.groupBy("cik", kind.alias("transaction_class"))
        .agg(F.count("*").alias("transactions"), F.sum("shares").alias("shares"))
        .withColumn("market_signal", is_market_signal(F.col("transaction_class")))
    )


def holder_totals(holders: DataFrame) -> DataFrame:
    """Sum of holders' shares per issuer, only where all rows share one report date."""
    agg = holders.groupBy("cik").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("as_of_date").isNull()).alias("undated"),
        F.min("as_of_date").alias("first"),
        F.max("as_of_date").alias("last"),
        F.sum("shares").alias("shares"),
    )
    rows = agg.withColumn("c", consistent_report_period(F.col("rows"), F.col("undated"), F.col("first"), F.col("last")))
    return rows.select(
        "cik", "rows", F.col("c.state").alias("state"), F.col("c.reason").alias("reason"),
        F.when(F.col("c.state") == OK, F.col("shares")).alias("shares"),
    )
