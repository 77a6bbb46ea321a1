"""All metrics of all issuers and listings at one date, as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cell import CELL_TYPE, missing
from ..operators import bars as B
from ..operators import facts as X
from ..operators import freshness as FR
from ..operators import fundamentals as FD
from ..operators import market as MK
from ..operators import ttm as T
from ..reference_data import DEBT_LINES, ISSUER_METRICS, LISTING_METRICS
from ..sources.provenance import fundamentals_coverage
from ..sources.staging import stage
from ..sources.tables import Tables
from . import needs as N
from .needs import Needs

ALL = Needs.all()
FUNDAMENTAL_METRICS = tuple(m for m in ISSUER_METRICS if m not in FR.QUOTE_METRICS)


def statement_frames(facts: DataFrame, *, lines=None, as_of=None, reuse: bool = False, anchors: bool = True, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(line facts, periods, with each issuer's year end and sheet date unless ``anchors`` is off).

    ``reuse`` stores the reduced period table because several branches read it, in as many ``buckets`` by issuer as the facts.
    """
    lf = X.line_facts(facts, lines=lines, as_of=as_of)
    periods = X.with_anchors(X.periods(lf)) if anchors else X.periods(lf)
    return lf, stage(periods, "cik", buckets) if reuse else periods


def ttm_metrics(periods, by_tag_pairs, needs: Needs) -> DataFrame:
    """Per issuer: TTM revenue, TTM of the year before, their growth, guarded TTM EPS and the facts behind them, as far as they are needed."""
    lines = needs.lines(N.TTM)
    chosen = T.choose_ttm(T.ttm_outcomes(T.ttm_parts(periods, lines)))
    parts = []
    facts = F.struct("tag", "basis", "fy", "cur", "prior")
    if "revenue_ttm" in needs:
        revenue = chosen.where(F.col("line") == "revenue")
        cells = [F.col("ttm").alias("revenue_ttm"), facts.alias("_ttm_revenue")]
        if "revenue_growth_ttm_yoy" in needs:
            revenue = T.prior_year_ttm(revenue, by_tag_pairs)
            cells.insert(1, T.ttm_growth(F.col("ttm"), F.col("ttm_prior")).alias("revenue_growth_ttm_yoy"))
        parts.append(revenue.select("cik", *cells))
    if "diluted_eps_ttm" in needs:
        eps = T.share_guard(chosen.where(F.col("line") == "diluted_eps"), periods)
        parts.append(eps.select("cik", F.col("ttm").alias("diluted_eps_ttm"), facts.alias("_ttm_eps")))
    return reduce(lambda a, b: a.join(b, "cik", "full_outer"), parts)


def issuer_fundamentals(facts: DataFrame, issuers: DataFrame | None, as_of, *, reuse: bool = True, needs: Needs | None = None, buckets: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """One row per issuer with every metric that needs no price, and the line selections behind them.

    Without ``issuers`` there is a row for each issuer that reports one of the lines read. With ``needs`` only what those metrics rest on is read, and only they are made.
    ``listed`` has the ``cik`` of all ``issuers``: where several branches read the facts, the join with the issuers is done on the facts already.
    """
    needs = needs or ALL
    annual, sheet, paired, ttm = (needs.lines(k) for k in (N.ANNUAL, N.SHEET, N.PAIR, N.TTM))
    parts: list[DataFrame] = []
    read = needs.period_lines()
    labels = None
    if read:
        branches = sum(map(bool, (annual or sheet, paired, ttm))) + 1
        anchored = bool(annual or sheet or paired)
        if listed is not None and reuse and branches > 2:
            facts = facts.join(stage(listed.distinct()), "cik", "left_semi")
        _, periods = statement_frames(facts, lines=read, reuse=reuse and branches > 2, anchors=anchored, buckets=buckets)
        if anchored:
            parts.append(periods.groupBy("cik").agg(F.first("fy_end").alias("fy_end"), F.first("sheet_end").alias("sheet_end")))
        if annual or sheet:
            parts.append(X.pivot_lines(X.selected_lines(periods, (*annual, *sheet)), (*annual, *sheet)))
        by_tag = None
        if paired:
            by_tag = X.tag_pairs(X.line_facts(facts, lines=paired), X.pair_anchors(periods, paired))
            readers = 1 + (N.FILING_SHEETS in needs) + ("revenue_growth_ttm_yoy" in needs)
            if reuse and readers > 1:
                by_tag = stage(by_tag, "cik", buckets)  # one row per issuer and tag, read by several branches
            pairs = X.annual_pairs(by_tag)
            parts.append(X.pivot_lines(pairs, paired, value="pair", prefix="pair_"))
            if N.FILING_SHEETS in needs:
                parts.append(FD.leverage(FD.filing_sheets(X.line_facts(facts, lines=(*DEBT_LINES, "equity")), pairs)))
        if ttm:
            parts.append(ttm_metrics(periods, by_tag, needs))
        if needs == ALL:
            labels = X.fiscal_year_labels(periods.where(F.col("line") == "revenue")).select("cik", F.col("period_end").alias("fy_end"), "fiscal_year")
    if N.SHARES in needs:
        parts.append(X.share_counts(X.line_facts(facts, lines=("shares_outstanding",))))
    row = reduce(lambda a, b: a.join(b, "cik", "left"), parts if issuers is None else [issuers, *parts])
    if labels is not None:
        row = row.join(labels, ["cik", "fy_end"], "left")
    row = FD.balance_sheet(FD.annual_metrics(row, needs.metrics()), needs.metrics())
    if N.FILING_SHEETS in needs:
        row = FD.fill_leverage(row)
    no_ttm = missing("NO_ANNUAL_VALUE")
    filled = {}
    if "revenue_growth_ttm_yoy" in needs:
        filled["revenue_growth_ttm_yoy"] = F.coalesce(F.when(F.col("revenue_ttm").isNull(), no_ttm), F.col("revenue_growth_ttm_yoy"))
    filled |= {m: F.coalesce(F.col(m), no_ttm) for m in ("revenue_ttm", "diluted_eps_ttm") if m in needs}
    if N.SHARES in needs:
        filled["shares_outstanding"] = FD.shares_outstanding(F.col("shares_end"), F.col("shares_low"), F.col("shares_high"), as_of)
    return row.withColumns(filled)


def issuer_metrics(tables: Tables, as_of, *, reuse: bool = True, needs: Needs | None = None) -> DataFrame:
    """Every issuer metric (or those in ``needs``), one row per issuer that has a listing."""
    needs = needs or ALL
    if N.QUOTES in needs:
        primaries = MK.primary_listings(tables.securities, tables.designations)
        row = MK.issuer_quotes(tables.securities, primaries, MK.newest_quotes(tables.quotes))
    elif N.LISTINGS in needs:
        row = MK.primary_listings(tables.securities, tables.designations)
    else:
        row = tables.securities.where(F.col("cik").isNotNull()).select("cik").distinct()
    made = [m for m in needs.metrics() if m in FUNDAMENTAL_METRICS]
    if needs.statements():
        row = issuer_fundamentals(tables.facts, row, as_of, reuse=reuse, needs=needs, buckets=tables.fact_buckets, listed=tables.securities.select("cik"))
    if tables.sources is not None and needs.statements():
        row = row.join(fundamentals_coverage(tables.sources), "cik", "left")
    else:
        row = row.withColumn("unavailable", F.lit(None).cast("string"))
    gone = F.col("unavailable")
    row = row.withColumns({m: F.when(gone.isNotNull(), missing(gone)).otherwise(F.col(m)) for m in made})
    if "issuer_market_cap" in needs:
        row = row.withColumn("issuer_market_cap", MK.market_cap(F.col("market_cap"), F.col("listings"), F.col("quote_date"), as_of))
    return MK.valuation_metrics(row, gone, needs.metrics())


def listing_views(tables: Tables, as_of, *, max_age_days=FR.MAX_PRICE_AGE_DAYS, point_in_time=False, reuse=True, metrics=None) -> DataFrame:
    """One row per listing with every metric of the listing and of its issuer, stale ones blocked.

    ``metrics`` names those that are wanted (and the checks ``year_high_diff``, ``cap_check``): then lines, pairs, quotes and bars that
    they do not rest on are neither read nor joined.
    """
    needs = ALL if metrics is None else Needs.of(metrics)
    if point_in_time:
        tables = tables.known_by(as_of)
    rows = tables.securities.where(F.col("cik").isNotNull())
    if N.BARS in needs:
        rows = rows.join(B.price_metrics(tables.bars, as_of), "security_id", "left")
        rows = rows.withColumns({m: F.coalesce(F.col(m), c) for m, c in B.no_bars().items()})
    if "year_high_diff" in needs:
        provider = MK.newest_quotes(tables.quotes).select("security_id", F.col("year_high").alias("provider_year_high"))
        rows = rows.join(provider, "security_id", "left")
    if needs.issuers():
        rows = rows.join(issuer_metrics(tables, as_of, reuse=reuse, needs=needs), "cik")
    made = {}
    if "price_to_earnings" in needs:
        made["price_to_earnings"] = B.price_to_earnings(F.col("last_close"), F.col("diluted_eps_ttm"), F.col("multi_class"))
    if "year_high_diff" in needs:
        made["year_high_diff"] = MK.year_high_difference(F.col("high_52w"), F.col("provider_year_high"))
    if "cap_check" in needs:
        made["cap_check"] = F.when(
            F.col("security_id") == F.col("primary_security_id"),
            MK.market_cap_check(F.col("issuer_market_cap"), F.col("shares_outstanding"), F.col("last_traded_close"), F.col("multi_class"), F.col("unavailable")),
        )
    if N.BARS in needs:
        made["last_bar"] = F.col("newest_bar")
    rows = rows.withColumns(made)
    if needs == ALL:
        rows = FR.freshness_record(rows, as_of, max_age_days)
    if N.BARS in needs:
        rows = FR.block_listing(rows, as_of, max_age_days)
    return FR.block_issuer(rows, as_of, max_age_days) if N.QUOTES in needs else rows


def price_views(tables: Tables, as_of, *, max_age_days=FR.MAX_PRICE_AGE_DAYS) -> DataFrame:
    """Listing rows with price metrics only: what a screen on prices needs, without touching any fact."""
    prices = B.price_metrics(tables.bars, as_of)
    rows = tables.securities.where(F.col("cik").isNotNull()).join(prices, "security_id", "left")
    rows = rows.withColumn("last_bar", F.col("newest_bar"))
    rows = rows.withColumns({m: F.coalesce(F.col(m), c) for m, c in B.no_bars().items()})
    return FR.block_listing(rows, as_of, max_age_days)


def long_metrics(views: DataFrame) -> DataFrame:
    """Listing rows as one row per metric. Issuer metrics repeat for each listing, as in a per-security report."""
    names = [m for m in (*ISSUER_METRICS, *LISTING_METRICS) if m in views.columns]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast(CELL_TYPE).alias("cell")) for m in names])
    return views.select("ticker", "cik", "security_id", F.explode(cells).alias("m")).select(
        "ticker", "cik", "security_id", "m.metric", "m.cell.*"
    )


def issuer_long(rows: DataFrame, names=ISSUER_METRICS) -> DataFrame:
    present = [m for m in names if m in rows.columns]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast(CELL_TYPE).alias("cell")) for m in present])
    return rows.select("cik", F.explode(cells).alias("m")).select("cik", "m.metric", "m.cell.*")

