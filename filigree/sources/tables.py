"""Stored tables: schemas and the set of frames a computation reads."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column names and types of the stored tables.
SCHEMAS = {
    "sources": (
        "source_id bigint, provider string, dataset string, url string, retrieved_at timestamp_ntz, "
        "content_hash string, detail string, command string, parameters string, provider_version string, "
        "as_of timestamp_ntz, is_fallback boolean"
    ),
    "securities": (
        "security_id bigint, cik string, ticker string, name string, exchange string, security_type string, "
        "sector string, industry string, sic string, is_active boolean, sector_source string, sic_source string"
    ),
    "financial_facts": (
        "cik string, taxonomy string, concept string, unit string, value double, period_start date, period_end date, "
        "fiscal_year int, fiscal_period string, form string, filed_date date, accession_no string, frame string, "
        "source_id bigint"
    ),
    "price_daily": (
        "security_id bigint, trade_date date, open double, high double, low double, close double, adj_close double, "
        "volume bigint, source_id bigint"
    ),
    "market_quotes": (
        "security_id bigint, quote_date date, last_price double, market_cap double, year_high double, "
        "year_low double, source_id bigint"
    ),
    "filings": (
        "accession_no string, cik string, form string, filing_date date, report_date date, primary_document string, "
        "description string, url string, source_id bigint"
    ),
    "earnings": (
        "cik string, fiscal_year int, fiscal_period string, report_date date, eps_actual double, eps_estimate double, "
        "revenue_actual double, revenue_estimate double, source_id bigint"
    ),
    "ownership": (
        "cik string, holder_type string, holder_key string, holder_name string, holder_cik string, as_of_date date, "
        "accession_no string, line_no int, shares double, value_usd double, shares_change double, "
        "transaction_code string, form string, transaction_price double, shares_owned_after double, "
        "acquired_disposed string, is_derivative boolean, security_title string, ownership_nature string, "
        "is_10b5_1 boolean, source_id bigint"
    ),
    "events": (
        "cik string, event_type string, source_ref string, event_date date, title string, summary string, url string, "
        "accession_no string, source_id bigint"
    ),
}

# Business key of each table: reloading a row with the same key never adds one.
KEYS = {
    "securities": ["ticker", "cik"],
    "financial_facts": ["cik", "taxonomy", "concept", "unit", "period_start", "period_end", "accession_no"],
    "price_daily": ["security_id", "trade_date"],
    "market_quotes": ["security_id", "quote_date"],
    "filings": ["accession_no"],
    "earnings": ["cik", "fiscal_year", "fiscal_period"],
    "ownership": ["cik", "holder_type", "holder_key", "as_of_date", "accession_no", "line_no"],
    "events": ["cik", "event_type", "source_ref"],
}


@dataclass(frozen=True)
class Tables:
    """The frames behind one computation; only those it uses are ever read."""

    securities: DataFrame
    facts: DataFrame | None = None
    bars: DataFrame | None = None
    quotes: DataFrame | None = None
    filings: DataFrame | None = None
    sources: DataFrame | None = None
    ownership: DataFrame | None = None
    designations: DataFrame | None = None
    #: Number of buckets where ``facts`` is a table bucketed by cik; tables made of it are kept in as many.
    fact_buckets: int | None = None

    def known_by(self, as_of) -> Tables:
        """The same tables as they were on ``as_of``: no later filing, quote, bar or retrieval."""
        day = F.lit(as_of).cast("date")

        def cut(df: DataFrame | None, column: str) -> DataFrame | None:
            return None if df is None else df.where(F.col(column).cast("date") <= day)

        return replace(
            self,
            facts=cut(self.facts, "filed_date"),
            bars=cut(self.bars, "trade_date"),
            quotes=cut(self.quotes, "quote_date"),
            filings=cut(self.filings, "filing_date"),
            sources=cut(self.sources, "retrieved_at"),
        )


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, names=("financial_facts", "price_daily", "market_quotes", "sources")) -> Tables:
    field = {"financial_facts": "facts", "price_daily": "bars", "market_quotes": "quotes"}
    frames = {field.get(n, n): read_table(spark, root, n) for n in names}
    return Tables(read_table(spark, root, "securities"), **frames)


# --- named reads --------------------------------------------------------------------------------------------------


def securities_of(securities: DataFrame, *, ticker: str | None = None, cik: str | None = None) -> DataFrame:
    """All listings with a ticker or of an issuer; a ticker need not be unique."""
    if ticker is not None:
        return securities.where(F.col("ticker") == ticker.strip().upper()).orderBy("security_id")
    return securities.where(F.col("cik") == cik).orderBy("ticker", "security_id")


def price_history(bars: DataFrame, security_id: int) -> DataFrame:
    return bars.where(F.col("security_id") == security_id).orderBy("trade_date")


def facts_of(facts: DataFrame, cik: str) -> DataFrame:
    return facts.where(F.col("cik") == cik).orderBy("concept", "period_end", "filed_date", "accession_no")


def filings_of(filings: DataFrame, cik: str) -> DataFrame:
    return filings.where(F.col("cik") == cik).orderBy(F.col("filing_date").desc(), "accession_no")


def recent(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def listings_of_requested(securities: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every stored listing of each issuer that has a requested ticker, the unrequested ones included."""
    issuers = securities.join(symbols.select("ticker"), "ticker", "left_semi").where(F.col("cik").isNotNull()).select("cik")
    return securities.join(issuers.distinct(), "cik", "left_semi")


def requested_universe(securities: DataFrame, symbols: DataFrame) -> DataFrame:
    """Requested symbols against stored listings: STORED, STORED_WITHOUT_CIK or NOT_STORED."""
    stored = securities.groupBy("ticker").agg(F.max(F.col("cik").isNotNull()).alias("has_cik"))
    status = F.when(F.col("has_cik").isNull(), "NOT_STORED").when(~F.col("has_cik"), "STORED_WITHOUT_CIK").otherwise("STORED")
    return symbols.select("ticker").distinct().join(stored, "ticker", "left").select("ticker", status.alias("status"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_ordered(df: DataFrame, path: str, *order: str | Column) -> None:
    """A table whose files, in order of their names, hold its rows in order: ranges of the keys, each sorted by one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """An ordered table with ``position``, each row's place in it (from 0). Only the files' row counts meet in one task."""
    rows = spark.read.parquet(path)
    placed = rows.select(*rows.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", before.alias("_before"))
    return placed.join(starts, "_file").select(*rows.columns, (F.col("_before") + F.col("_index")).alias("position"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
