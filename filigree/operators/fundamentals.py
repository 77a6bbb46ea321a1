"""Issuer metrics that need no price, as projections over wide issuer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cell import DEPENDS, NOT_COMPARABLE, absent, flag_array, missing, ok, usable
from ..functions import dates as D
from ..functions import metrics as M
from ..reference_data import DEBT_LINES, FLOW_LINES
from . import facts as X

NO_YEAR = "NO_ANNUAL_REVENUE_OR_NET_INCOME"
NO_PAIR = "NO_FILING_REPORTS_BOTH_YEARS"
MARGIN_LINES = {
    "gross_margin": "gross_profit",
    "operating_margin": "operating_income",
    "net_margin": "net_income_to_common",
}


def _problem(sel: Column) -> Column:
    return missing(F.coalesce(sel["problem"], F.lit("NOT_REPORTED")))


def _has(sel: Column) -> Column:
    return F.coalesce(sel["value"].isNotNull(), F.lit(False))


def margins(revenue: Column, top: Column) -> Column:
    return (
        F.when(~_has(revenue), _problem(revenue))
        .when(~_has(top), _problem(top))
        .otherwise(M.margin(top["value"], revenue["value"]))
    )


def free_cash_flow(cfo: Column, capex: Column) -> Column:
    mixed = flag_array(F.when(cfo["accession"] != capex["accession"], "MIXED_FILINGS"))
    return M.free_cash_flow(cfo["value"], capex["value"], mixed)


def _comparable(pair: Column) -> Column:
    """Why the two periods of a pair cannot be compared, or NULL."""
    return D.comparability_problem(
        pair["now"]["period_start"], pair["now"]["period_end"], pair["prior"]["period_start"],
        pair["prior"]["period_end"],
    )


def growth(pair: Column, problem: Column) -> Column:
    return (
        F.when(pair.isNull(), missing(NO_PAIR))
        .when(problem.isNotNull(), absent(NOT_COMPARABLE, problem))
        .otherwise(M.growth_rate(pair["now"]["value"], pair["prior"]["value"]))
    )


def _one_filing(a: Column, b: Column) -> Column:
    # both values of a pair come from one filing, so comparing the current ones is enough
    return a["now"]["accession"] == b["now"]["accession"]


def fcf_growth(cfo: Column, capex: Column) -> Column:
    now = usable(cfo["now"]["value"] - F.abs(capex["now"]["value"]))
    prior = usable(cfo["prior"]["value"] - F.abs(capex["prior"]["value"]))
    return (
        F.when(cfo.isNull() | capex.isNull(), missing("CAPEX_OR_CFO_PAIR_MISSING"))
        .when(~_one_filing(cfo, capex), absent(NOT_COMPARABLE, "CFO_AND_CAPEX_FROM_DIFFERENT_FILINGS"))
        .when(now.isNull() | prior.isNull(), missing(DEPENDS))
        .otherwise(M.growth_rate(now, prior))
    )


def margin_change(top: Column, revenue: Column, problem: Column, margin_now: Column, margin_prior: Column) -> Column:
    return (
        F.when(top.isNull() | revenue.isNull(), missing(NO_PAIR))
        .when(~_one_filing(top, revenue), absent(NOT_COMPARABLE, "MARGIN_INPUTS_FROM_DIFFERENT_FILINGS"))
        .when(problem.isNotNull(), absent(NOT_COMPARABLE, problem))
        .otherwise(M.level_change(margin_now, margin_prior))
    )


# --- annual leverage from one filing -------------------------------------------------------------------------------


def filing_sheets(lf: DataFrame, pairs: DataFrame) -> DataFrame:
    """Debt and equity selections of the filing behind each issuer's revenue pair, at both of its year ends.

    Joined on (issuer, filing), so only the rows of one filing per issuer go on.
    """
    filing = pairs.where(F.col("line") == "revenue").select(
        "cik",
        F.col("pair.now.accession").alias("accession"),
        F.col("pair.now.period_end").alias("now_end"),
        F.col("pair.prior.period_end").alias("prior_end"),
    )
    wanted = (*DEBT_LINES, "equity")
    rows = (
        lf.where((F.col("kind") == D.INSTANT) & F.col("line").isin(*wanted))
        .join(filing, ["cik", "accession"])
        .where(F.col("period_end").isin(F.col("now_end"), F.col("prior_end")))
        .withColumns(
            {
                "year": F.when(F.col("period_end") == F.col("now_end"), "now").otherwise("prior"),
                "low": F.col("value"),
                "high": F.col("value"),
            }
        )
    )
    keys = ["cik", "year", "line"]
    long = X.choose_tag(X.per_tag(rows, keys), keys)
    columns = [(year, line) for year in ("now", "prior") for line in wanted]
    picked = long.groupBy("cik").agg(
        *[
            F.expr(f"first(CASE WHEN year = '{y}' AND line = '{ln}' THEN sel END, true) AS {y}_{ln}")
            for y, ln in columns
        ]
    )
    # an issuer with a pair but no instant in that filing still gets a row
    return filing.select("cik").join(picked, "cik", "left")


def leverage(sheets: DataFrame) -> DataFrame:
    def debt(year: str) -> Column:
        lines = [F.col(f"{year}_{line}")["value"] for line in DEBT_LINES]
        return M.total_debt(*lines, balance_sheet_present=F.lit(True))

    def ratio(year: str) -> Column:
        conflict = F.coalesce(*[F.col(f"{year}_{line}")["problem"] for line in (*DEBT_LINES, "equity")])
        return F.when(conflict.isNotNull(), missing(conflict)).otherwise(
            M.debt_to_equity(F.col(f"{year}_debt"), F.col(f"{year}_equity")["value"])
        )

    staged = sheets.withColumns({"now_debt": debt("now"), "prior_debt": debt("prior")})
    out = staged.select("cik", ratio("now").alias("debt_to_equity_fy"), ratio("prior").alias("debt_to_equity_prior_fy"))
    return out.withColumn(
        "debt_to_equity_change_yoy", M.level_change(F.col("debt_to_equity_fy"), F.col("debt_to_equity_prior_fy"))
    )


# --- balance sheet at the latest date --------------------------------------------------------------------------------


BALANCE_METRICS = ("total_debt", "net_debt", "debt_to_equity")


def balance_sheet(row: DataFrame, wanted=BALANCE_METRICS) -> DataFrame:
    """Total debt, net debt and debt to equity from the selections at ``sheet_end``, as far as they are wanted."""
    if not any(m in wanted for m in BALANCE_METRICS):
        return row
    present = F.col("sheet_end").isNotNull()
    debt_conflict = F.coalesce(*[F.col(line)["problem"] for line in DEBT_LINES])
    out = row.withColumn(
        "total_debt",
        F.when(present & debt_conflict.isNotNull(), missing(F.concat(F.lit("DEBT_LINE_"), debt_conflict))).otherwise(
            M.total_debt(*[F.col(line)["value"] for line in DEBT_LINES], balance_sheet_present=present)
        ),
    )
    debt, made = F.col("total_debt"), {}
    if "net_debt" in wanted:
        cash_conflict = F.coalesce(F.col("cash")["problem"], F.col("short_term_investments")["problem"]).isNotNull()
        made["net_debt"] = F.when(cash_conflict, missing("CASH_TAG_CONFLICT")).otherwise(
            M.net_debt(debt, F.col("cash")["value"], F.col("short_term_investments")["value"])
        )
    if "debt_to_equity" in wanted:
        made["debt_to_equity"] = F.when(F.col("equity")["problem"].isNotNull(), missing("EQUITY_TAG_CONFLICT")).otherwise(
            M.debt_to_equity(debt, F.col("equity")["value"])
        )
    return out.withColumns(made)


def shares_outstanding(end: Column, low: Column, high: Column, as_of) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), end)
    return (
        F.when(end.isNull(), missing("NOT_REPORTED"))
        .when(age > X.STALE_SHARES_DAYS, missing(F.concat(F.lit("STALE_SHARES:"), end.cast("string"))))
        .when(low != high, missing("MULTI_CLASS_AMBIGUOUS"))
        .otherwise(ok(low))
    )


ANNUAL_METRICS = (
    *MARGIN_LINES, "revenue_growth_yoy", "eps_growth_yoy", "fcf", "fcf_growth_yoy", *(f"{m}_change_yoy" for m in MARGIN_LINES),
)


def annual_metrics(row: DataFrame, wanted=ANNUAL_METRICS) -> DataFrame:
    """Margins, growth, cash flow and margin changes, those that are wanted. ``row`` holds the line selections and ``pair_<line>`` columns that they need."""
    no_year = F.col("fy_end").isNull()

    def cell(expr: Column) -> Column:
        return F.when(no_year, missing(NO_YEAR)).otherwise(expr)

    def pair(line: str) -> Column:
        return F.col(f"pair_{line}")

    def changes(name: str) -> bool:
        return f"{name}_change_yoy" in wanted

    staged = {}
    if "revenue_growth_yoy" in wanted or any(map(changes, MARGIN_LINES)):
        staged["_problem_revenue"] = _comparable(pair("revenue"))
    if "eps_growth_yoy" in wanted:
        staged["_problem_diluted_eps"] = _comparable(pair("diluted_eps"))
    for name, line in MARGIN_LINES.items():
        for year in ("now", "prior") if changes(name) else ():
            staged[f"_{name}_{year}"] = M.margin(pair(line)[year]["value"], pair("revenue")[year]["value"])
    out = {name: lambda line=line: margins(F.col("revenue"), F.col(line)) for name, line in MARGIN_LINES.items()}
    out["revenue_growth_yoy"] = lambda: growth(pair("revenue"), F.col("_problem_revenue"))
    out["eps_growth_yoy"] = lambda: growth(pair("diluted_eps"), F.col("_problem_diluted_eps"))
    out["fcf"] = lambda: free_cash_flow(F.col("operating_cash_flow"), F.col("capex"))
    out["fcf_growth_yoy"] = lambda: fcf_growth(pair("operating_cash_flow"), pair("capex"))
    for name, line in MARGIN_LINES.items():
        out[f"{name}_change_yoy"] = lambda name=name, line=line: margin_change(
            pair(line), pair("revenue"), F.col("_problem_revenue"), F.col(f"_{name}_now"), F.col(f"_{name}_prior")
        )
    return row.withColumns(staged).withColumns({name: cell(made()) for name, made in out.items() if name in wanted}).drop(*staged)


LEVERAGE_METRICS = ("debt_to_equity_fy", "debt_to_equity_prior_fy", "debt_to_equity_change_yoy")


def fill_leverage(row: DataFrame) -> DataFrame:
    reason = F.when(F.col("fy_end").isNull(), NO_YEAR).otherwise(NO_PAIR)
    return row.withColumns({m: F.coalesce(F.col(m), missing(reason)) for m in LEVERAGE_METRICS})

