"""Entry points: what a user calls. Every function returns lazy DataFrames.

    from filigree import api
    t = api.open_tables(spark, "/warehouse")
    api.screen(t, {"criteria": [{"metric": "fcf", "op": "gt", "value": 0}]}, as_of="2026-10-02")
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bars as B
from .operators import evidence as EV
from .operators import freshness as FR
from .operators import quality as Q
from .operators import screen as SC
from .operators import upsert as U
from .plans import snapshot as S
from .plans.queries import universe_overview
from .reference_data import METRIC, catalog_frame
from .sources import documents as DOC
from .sources import provenance as PV
from .sources import tables as TB

Tables = TB.Tables
open_tables = TB.read_tables


def catalog(spark: SparkSession) -> DataFrame:
    """The 34 metrics a screen may name."""
    return catalog_frame(spark)


def validate_screen(spec: dict) -> SC.Screen:
    """The checked specification; raises ``ScreenError`` for anything unusable."""
    return SC.parse_screen(spec)


def resolve(symbols: DataFrame, ticker_map_documents: DataFrame) -> DataFrame:
    """Symbols to issuers: RESOLVED, NOT_IN_MAP, AMBIGUOUS or CONTRADICTED."""
    return DOC.resolve(symbols, DOC.parse_ticker_map(ticker_map_documents))


def normalise_facts(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Company-facts documents to (fact rows, points per status and reason, unsupported issuers)."""
    parsed = DOC.parse_companyfacts(documents)
    points = DOC.fact_points(parsed)
    return DOC.stored_facts(points), DOC.point_counts(points), DOC.taxonomy_coverage(parsed)


def normalise_filings(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions documents to (issuer profiles, filing rows)."""
    parsed = DOC.parse_submissions(documents)
    return parsed.drop("recent"), DOC.submission_filings(parsed)


def normalise_prices(rows: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Provider price rows to (bars, rejects per reason, repeated dates)."""
    typed = DOC.price_rows(rows)
    return B.accepted(typed, arrival), B.reject_counts(typed), B.duplicate_bars(typed, arrival)


def normalise_quotes(rows: DataFrame) -> DataFrame:
    return DOC.quote_rows(rows)


def upsert(stored: DataFrame, batch: DataFrame, table: str, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(status per key, new table) of a batch against a stored table."""
    return U.upsert_table(stored, batch, table, arrival)


def universe(tables: Tables) -> DataFrame:
    """What is stored: one row per listing with its data dates."""
    return universe_overview(tables)


def listing_views(tables: Tables, as_of, *, max_age_days=FR.MAX_PRICE_AGE_DAYS, point_in_time: bool = False, metrics=None) -> DataFrame:
    """One row per listing, one cell column per metric; ``metrics`` names the wanted ones, and only what they rest on is read.

    ``point_in_time`` hides filings, quotes and bars after ``as_of``; without it the newest
    stored facts and quotes are used whatever ``as_of`` is.
    """
    return S.listing_views(tables, as_of, max_age_days=max_age_days, point_in_time=point_in_time, metrics=metrics)


def metrics(tables: Tables, as_of, *, symbols: DataFrame | None = None, **options) -> DataFrame:
    """One row per listing and metric; ``symbols`` restricts the listings reported, not the issuers' inputs."""
    views = listing_views(tables, as_of, **options)
    if symbols is not None:
        views = views.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
    units = {name: row[2] for name, row in METRIC.items()}
    long = S.long_metrics(views)
    return long.withColumn("unit", F.try_element_at(EV.constant_map(units), F.col("metric")))


def screen(tables: Tables, spec: dict | str | SC.Screen, as_of=None, **options) -> DataFrame:
    """Status, counts and reasons per listing. Only what the criteria rest on is read: a screen on prices alone never reads a fact.

    ``spec`` is a checked screen, a dict or JSON text.
    """
    checked = spec if isinstance(spec, SC.Screen) else SC.parse_screen(json.loads(spec) if isinstance(spec, str) else spec)
    views = S.listing_views(tables, checked.as_of or as_of, metrics=SC.metrics_of(checked), **options)
    return SC.run_screen(views, checked)


def evidence(tables: Tables, as_of, *, since, companies: DataFrame, annual: DataFrame | None = None) -> dict[str, DataFrame]:
    """Filing items, metric items and section statuses of all companies (cik, ticker).

    ``annual`` holds each issuer's latest fiscal-year lines; with it, annual figures count as earnings evidence.
    """
    views = listing_views(tables, as_of)
    filings = EV.filing_items(tables.filings, companies, since)
    metric_rows = EV.metric_items(views, as_of)
    lines = EV.annual_report_items(annual) if annual is not None else companies.limit(0)
    counted = metric_rows.groupBy("cik", "section").agg(F.count("*").alias("items"))
    counts = EV.section_counts(filings, counted, lines, companies)
    known = companies
    if tables.sources is not None:
        known = companies.join(PV.fundamentals_coverage(tables.sources), "cik", "left")
    return {"filings": filings, "metrics": metric_rows, "sections": EV.section_status(known, counts)}


def filing_events(symbols: DataFrame, ticker_map: DataFrame, filings: DataFrame, since) -> DataFrame:
    return EV.events_report(symbols, ticker_map, filings, since)


def validation(tables: Tables) -> dict[str, DataFrame]:
    """Table counts, integrity counts, retrieval summary and listings."""
    stored = {
        "securities": tables.securities, "financial_facts": tables.facts, "price_daily": tables.bars,
        "market_quotes": tables.quotes, "filings": tables.filings, "sources": tables.sources,
    }
    return {
        "table_counts": TB.table_counts({k: v for k, v in stored.items() if v is not None}),
        "integrity": Q.integrity_report(
            tables.securities, tables.facts, tables.bars, tables.quotes, tables.filings, tables.sources
        ),
        "sources": PV.source_summary(tables.sources),
        "securities": tables.securities,
    }
