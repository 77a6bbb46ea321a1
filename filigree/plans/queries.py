"""Registered queries: every operator over tables derived from the given ones, with its SQL answer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cell import unpack
from ..functions import dates as D
from ..functions import metrics as M
from ..functions import text as T
from ..operators import bars as B
from ..operators import evidence as EV
from ..operators import facts as X
from ..operators import freshness as FR
from ..operators import fundamentals as FD
from ..operators import keyed as K
from ..operators import market as MK
from ..operators import quality as Q
from ..operators import screen as SC
from ..operators import ttm as TT
from ..operators import upsert as U
from ..reference_data import CORE_LINES, COVERAGE_LINES, FLOW_LINES, HANDLED_ISSUE_KINDS, METRIC, SHEET_LINES, catalog_frame, constant_frame
from ..sources import documents as DOC
from ..sources import provenance as PV
from ..sources import staging as ST
from ..sources import tables as TB
from ..sources.keyed_table import COUNTS, KeyedTable
from ..streaming import jobs as J
from . import needs as N
from . import oracle as O
from . import snapshot as S
from . import views as V
from .needs import Needs
from .views import AS_OF, Inputs

Build = Callable[[Inputs], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Build) -> Build:
        REGISTRY[name] = Query(build, sql)
        return build

    return register


def day(c: str) -> Column:
    """Dates leave a query as text."""
    return F.col(c).cast("string").alias(c)


# --- bars ----------------------------------------------------------------------------------------------------------

SCREEN_DRAWDOWN = SC.parse_screen(
    {
        "name": "drawdown",
        "criteria": [
            {"metric": "drawdown_from_52w_high", "op": "between", "low": -50, "high": -30, "unit": "percent"},
            {"metric": "price_return_1y", "op": "gt", "value": 0, "unit": "percent"},
        ],
    }
)


def _criterion_sql(metric: str, test: str) -> str:
    return f"CASE WHEN {metric}.state <> 'OK' THEN 'UNEVALUABLE' WHEN {test} THEN 'PASS' ELSE 'FAIL' END"


def _roll_up_sql(table: str, criteria: list[tuple[str, str, str]], extra: str = "") -> str:
    """Status per listing from (metric, test, condition text)."""
    cols = ", ".join(f"{_criterion_sql(m, t)} AS r{i}" for i, (m, t, _) in enumerate(criteria))
    first = "" if not extra else f"{extra} AS rc, "
    rs = [f"r{i}" for i in range(len(criteria))]
    names = (["rc"] if extra else []) + rs

    def n(res: str) -> str:
        return "(" + " + ".join(f"({r} = '{res}')::INT" for r in names) + ")"

    failed = ", ".join(
        (["CASE WHEN rc = 'FAIL' THEN 'classification in nasdaq' END"] if extra else [])
        + [f"CASE WHEN r{i} = 'FAIL' THEN '{text}' END" for i, (_, _, text) in enumerate(criteria)]
    )
    unknown = ", ".join(
        (["CASE WHEN rc = 'UNEVALUABLE' THEN 'classification (CLASSIFICATION_NOT_AVAILABLE)' END"] if extra else [])
        + [
            f"CASE WHEN r{i} = 'UNEVALUABLE' THEN '{m} ' || {m}.state || coalesce(' (' || {m}.reason || ')', '') END"
            for i, (m, _, _) in enumerate(criteria)
        ]
    )
    return f"""SELECT ticker, cik, security_id, CASE WHEN {n('FAIL')} > 0 THEN 'NO_MATCH' WHEN {n('UNEVALUABLE')} > 0
      THEN 'UNEVALUABLE' ELSE 'MATCH' END AS status,
    CASE WHEN {n('FAIL')} > 0 THEN 'FAILED: ' || concat_ws('; ', {failed})
      WHEN {n('UNEVALUABLE')} > 0 THEN 'MISSING_DATA: ' || concat_ws('; ', {unknown}) END AS exclusion_reason,
    {n('PASS')} AS criteria_passed, {n('FAIL')} AS criteria_failed, {n('UNEVALUABLE')} AS criteria_unevaluable
  FROM (SELECT *, {first}{cols} FROM {table})"""


_DRAWDOWN_CRITERIA = [
    (
        "drawdown_from_52w_high",
        "drawdown_from_52w_high.value BETWEEN -50 * 0.01::DOUBLE AND -30 * 0.01::DOUBLE",
        "drawdown_from_52w_high between -0.5 and -0.3 (inclusive)",
    ),
    ("price_return_1y", "price_return_1y.value > 0", "price_return_1y > 0.0"),
]


@query("drawdown_screen", O.compose(_roll_up_sql("price_view", _DRAWDOWN_CRITERIA), "price_view"))
def drawdown_screen(i: Inputs) -> DataFrame:
    views = S.price_views(TB.Tables(i.securities(), bars=i.bars()), AS_OF)
    return SC.run_screen(views, SCREEN_DRAWDOWN)


@query("high_low_52w", O.compose(
    "SELECT security_id, " + ", ".join(O.parts(n, n + "_") for n in ("high_52w", "low_52w", "high_52w_close", "low_52w_close"))
    + " FROM prices", "prices"))
def high_low_52w(i: Inputs) -> DataFrame:
    w = B.window_metrics(B.listing_aggregates(i.bars(), AS_OF))
    names = ("high_52w", "low_52w", "high_52w_close", "low_52w_close")
    return w.select("security_id", *[c for n in names for c in unpack(F.col(n), n + "_")])


@query("drawdown", O.compose(
    "SELECT security_id, " + O.parts("drawdown_from_52w_high", "intraday_") + ", "
    + O.parts("drawdown_from_52w_closing_high", "closing_") + " FROM prices", "prices"))
def drawdown(i: Inputs) -> DataFrame:
    w = B.drawdown_metrics(B.window_metrics(B.listing_aggregates(i.bars(), AS_OF)))
    return w.select(
        "security_id", *unpack(F.col("drawdown_from_52w_high"), "intraday_"),
        *unpack(F.col("drawdown_from_52w_closing_high"), "closing_"),
    )


@query("price_returns", O.compose(O.long_select("prices", "security_id", O.LISTING_ORDER[:6]), "prices"))
def price_returns(i: Inputs) -> DataFrame:
    rows = B.return_metrics(B.listing_aggregates(i.bars(), AS_OF), AS_OF)
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("c")) for n in B.RETURN_HORIZONS])
    return rows.select("security_id", F.explode(cells).alias("m")).select("security_id", "m.metric", *unpack(F.col("m.c")))


@query("benchmark_relative_return", O.compose(f"""
  SELECT p.security_id, CASE WHEN p.price_return_1y.state <> 'OK' THEN p.price_return_1y.state
      WHEN b.price_return_1y.state <> 'OK' THEN b.price_return_1y.state ELSE 'OK' END AS state,
    CASE WHEN p.price_return_1y.state = 'OK' AND b.price_return_1y.state = 'OK'
      THEN p.price_return_1y.value - b.price_return_1y.value END AS value,
    CASE WHEN p.price_return_1y.state <> 'OK' THEN p.price_return_1y.reason ELSE b.price_return_1y.reason END AS reason
  FROM prices p JOIN prices b ON b.security_id = 3""", "prices"))  # fmt: skip
def benchmark_relative_return(i: Inputs) -> DataFrame:
    rows = B.return_metrics(B.listing_aggregates(i.bars(), AS_OF), AS_OF).select("security_id", "price_return_1y")
    # the benchmark is one row; it is joined as an equality on a constant
    bench = rows.where(F.col("security_id") == 3).select(F.lit(1).alias("b"), F.col("price_return_1y").alias("bench"))
    both = rows.withColumn("b", F.lit(1)).join(F.broadcast(bench), "b")
    c = M.benchmark_relative(F.col("price_return_1y"), F.col("bench"))
    return both.select("security_id", c.alias("c")).select("security_id", "c.state", "c.value", "c.reason")


@query("price_gaps", O.compose("""
  SELECT security_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(next_date AS VARCHAR) AS next_date, business_days FROM (
    SELECT *, len(list_filter(generate_series(trade_date + 1, next_date - 1, INTERVAL 1 DAY), lambda d: isodow(d) < 6))::INT AS business_days
    FROM (SELECT security_id, trade_date, lead(trade_date) OVER (PARTITION BY security_id ORDER BY trade_date) AS next_date FROM v_bars)
    WHERE next_date IS NOT NULL) WHERE business_days > 5""", "v_bars"))  # fmt: skip
def price_gaps(i: Inputs) -> DataFrame:
    return B.gaps(i.bars()).select("security_id", day("trade_date"), day("next_date"), "business_days")


@query("split_rebase", O.compose("""
  SELECT security_id, count(*) AS overlap, list_sort(list(ratio))[count(*) // 2 + 1] AS median_ratio,
    count(*) >= 5 AND abs(list_sort(list(ratio))[count(*) // 2 + 1] - 1) > 0.001::DOUBLE AS rebased
  FROM (SELECT security_id, (CASE WHEN security_id = 2 THEN close * 0.1::DOUBLE ELSE close END) / close AS ratio FROM v_bars)
  GROUP BY security_id""", "v_bars"))  # fmt: skip
def split_rebase(i: Inputs) -> DataFrame:
    stored = i.bars()
    new = stored.withColumn("close", F.when(F.col("security_id") == 2, F.col("close") * 0.1).otherwise(F.col("close")))
    return B.split_rebase(stored, new)


@query("last_bar", O.compose(
    "SELECT security_id, CAST(max(trade_date) AS VARCHAR) AS last_bar, arg_max(close, trade_date) AS last_close FROM v_bars GROUP BY 1",
    "v_bars"))
def last_bar(i: Inputs) -> DataFrame:
    return B.last_bars(i.bars()).select("security_id", day("last_bar"), "last_close")


_PROBLEM_SQL = """CASE WHEN trade_date IS NULL THEN 'BAD_DATE' WHEN close IS NULL OR close <= 0 THEN 'NO_POSITIVE_CLOSE'
  WHEN open <= 0 OR high <= 0 OR low <= 0 THEN 'NON_POSITIVE_PRICE' WHEN high < low THEN 'HIGH_BELOW_LOW'
  WHEN close > high * (1 + 0.0001::DOUBLE) OR close < low * (1 - 0.0001::DOUBLE) THEN 'CLOSE_OUTSIDE_RANGE'
  WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END"""
ARRIVAL = ["arrival", "line_no", "partkey", "raw_price"]


@query("bar_rejects", O.compose(
    f"SELECT security_id, reason, count(*) AS rows FROM (SELECT *, {_PROBLEM_SQL} AS reason FROM v_raw) WHERE reason IS NOT NULL GROUP BY ALL",
    "v_raw"))
def bar_rejects(i: Inputs) -> DataFrame:
    return B.reject_counts(i.raw_bars())


@query("reject_samples", O.compose(f"""
  SELECT security_id, reason, CAST(trade_date AS VARCHAR) AS trade_date, close, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY security_id, reason ORDER BY arrival, line_no, partkey, raw_price) AS rank
    FROM (SELECT *, {_PROBLEM_SQL} AS reason FROM v_raw) WHERE reason IS NOT NULL) WHERE rank <= 5""", "v_raw"))  # fmt: skip
def reject_samples(i: Inputs) -> DataFrame:
    rows = B.rejects(i.raw_bars()).withColumnRenamed("problem", "reason")
    top = K.top_per_key(rows, ["security_id", "reason"], [F.col(c) for c in ARRIVAL], 5)
    return top.select("security_id", "reason", day("trade_date"), "close", "rank")


@query("duplicate_bars", O.compose(f"""
  SELECT security_id, CAST(trade_date AS VARCHAR) AS trade_date, count(prev) AS repeats, count(*) FILTER (prev IS NOT NULL AND prev <> cur) AS conflicting,
    count(*) FILTER (prev IS NOT NULL AND prev <> cur) = 0 AS identical
  FROM (SELECT *, lag(cur) OVER (PARTITION BY security_id, trade_date ORDER BY arrival, line_no, partkey, raw_price) AS prev
    FROM (SELECT *, {{'o': open, 'h': high, 'l': low, 'c': close, 'v': volume}} AS cur FROM v_raw) WHERE ({_PROBLEM_SQL}) IS NULL)
  GROUP BY ALL HAVING count(prev) > 0""", "v_raw"))  # fmt: skip
def duplicate_bars(i: Inputs) -> DataFrame:
    return B.duplicate_bars(i.raw_bars(), ARRIVAL).select("security_id", day("trade_date"), "repeats", "conflicting", "identical")


@query("accepted_bars", O.compose(f"""
  SELECT security_id, CAST(trade_date AS VARCHAR) AS trade_date, open, high, low, close, volume FROM v_raw WHERE ({_PROBLEM_SQL}) IS NULL
  QUALIFY row_number() OVER (PARTITION BY security_id, trade_date ORDER BY arrival DESC, line_no DESC, partkey DESC, raw_price DESC) = 1""",
    "v_raw"))
def accepted_bars(i: Inputs) -> DataFrame:
    return B.accepted(i.raw_bars(), ARRIVAL).select("security_id", day("trade_date"), "open", "high", "low", "close", "volume")


# --- facts ---------------------------------------------------------------------------------------------------------


def _periods(i: Inputs, *lines: str, reuse: bool = False, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """(line facts, anchored periods); ``both`` are read, so the facts are derived once and stored."""
    return S.statement_frames(i.stored_facts() if both else i.facts(), lines=lines or None, reuse=reuse, buckets=i.issuer_parts())


def _pairs(i: Inputs, *lines: str) -> DataFrame:
    lf, p = _periods(i, *lines, both=True)
    return X.annual_pairs(X.tag_pairs(lf, X.pair_anchors(p)))


@query("period_kinds", O.compose("SELECT line, kind, count(*) AS facts FROM lf GROUP BY ALL", "lf"))
def period_kinds(i: Inputs) -> DataFrame:
    return X.line_facts(i.facts()).groupBy("line", "kind").agg(F.count("*").alias("facts"))


@query("latest_known_asof", O.compose("""
  SELECT cik, line, tag, kind, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, value, accession
  FROM lf WHERE line IN ('revenue', 'equity') AND filed <= DATE '2000-06-30'
  QUALIFY row_number() OVER (PARTITION BY cik, line, tag, period_start, period_end ORDER BY filed DESC, accession DESC) = 1""", "lf"))  # fmt: skip
def latest_known_asof(i: Inputs) -> DataFrame:
    lf = X.line_facts(i.facts(), lines=("revenue", "equity"), as_of="2000-06-30")
    return X.latest_known(lf).select("cik", "line", "tag", "kind", day("period_start"), day("period_end"), "value", "accession")


_DATES = ("1997-06-30", "1998-06-30", "1999-02-15", "2000-06-30", "2001-05-09")


@query("metric_history", O.compose(f"""
  SELECT CAST(d AS VARCHAR) AS as_of, cik, tag, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, value, accession
  FROM lf, (SELECT unnest([{', '.join(f"DATE '{d}'" for d in _DATES)}]) AS d) WHERE line IN ('revenue', 'net_income_to_common') AND filed <= d
  QUALIFY row_number() OVER (PARTITION BY d, cik, line, tag, period_start, period_end ORDER BY filed DESC, accession DESC) = 1""", "lf"))  # fmt: skip
def metric_history(i: Inputs) -> DataFrame:
    """What was known of every period at several dates, in one plan."""
    history = X.vintages(X.line_facts(i.facts(), lines=("revenue", "net_income_to_common")))
    return X.known_at(history, _DATES).select(day("as_of"), "cik", "tag", day("period_start"), day("period_end"), "value", "accession")


@query("restated_periods", O.compose("""
  SELECT cik, tag, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, count(DISTINCT value) > 1 AS restated
  FROM lf WHERE line IN ('revenue', 'net_income_to_common') GROUP BY cik, tag, period_start, period_end HAVING count(DISTINCT value) > 1""", "lf"))  # fmt: skip
def restated_periods(i: Inputs) -> DataFrame:
    p = X.periods(X.line_facts(i.facts(), lines=("revenue", "net_income_to_common")))
    return X.restated_periods(p).select("cik", "tag", day("period_start"), day("period_end"), F.lit(True).alias("restated"))


@query("line_selection", O.compose(
    "SELECT cik, line, value, tag, accession, form, CAST(filed AS VARCHAR) AS filed, array_to_string(flags, ',') AS flags, problem FROM sel", "sel"))
def line_selection(i: Inputs) -> DataFrame:
    _, p = _periods(i)
    s = X.selected_lines(p).select("cik", "line", "sel.*")
    return s.select("cik", "line", "value", "tag", "accession", "form", day("filed"), F.concat_ws(",", "flags").alias("flags"), "problem")


@query("latest_ends", O.compose(
    "SELECT cik, line, CAST(max(period_end) AS VARCHAR) AS latest_end FROM p WHERE kind = 'FISCAL_YEAR' GROUP BY ALL", "p"))
def latest_ends(i: Inputs) -> DataFrame:
    p = X.periods(X.line_facts(i.facts()))
    return X.latest_end(p, (D.FISCAL_YEAR,)).select("cik", "line", day("latest_end"))


@query("fiscal_year_labels", O.compose("""
  SELECT cik, line, CAST(period_end AS VARCHAR) AS period_end, fiscal_year FROM lf WHERE line = 'revenue' AND kind = 'FISCAL_YEAR'
  QUALIFY row_number() OVER (PARTITION BY cik, line, period_end ORDER BY filed, accession) = 1""", "lf").replace(V.SQL_FACTS.strip(), V.SQL_WHOLE_FACTS.strip()))  # fmt: skip
def fiscal_year_labels(i: Inputs) -> DataFrame:
    p = X.periods(X.line_facts(i.facts(whole_years=True), lines=("revenue",)))
    return X.fiscal_year_labels(p).select("cik", "line", day("period_end"), "fiscal_year")


@query("fiscal_year_coverage", O.compose(
    "SELECT cik, " + ", ".join(f"count(DISTINCT period_end) FILTER (line = '{ln}') AS {ln}" for ln in COVERAGE_LINES)
    + " FROM lf WHERE kind = 'FISCAL_YEAR' AND line IN " + O._lines(COVERAGE_LINES) + " GROUP BY cik", "lf"))
def fiscal_year_coverage(i: Inputs) -> DataFrame:
    return X.fiscal_year_coverage(X.periods(X.line_facts(i.facts(), lines=COVERAGE_LINES)), COVERAGE_LINES)


@query("same_filing_pair", O.compose("""
  SELECT cik, line, tag, now.accession AS accession, CAST(now.filed AS VARCHAR) AS filed, now.value AS value_now,
    prior.value AS value_prior, CAST(now.period_end AS VARCHAR) AS end_now, CAST(prior.period_end AS VARCHAR) AS end_prior FROM pair""", "pair"))  # fmt: skip
def same_filing_pair(i: Inputs) -> DataFrame:
    p = _pairs(i).select("cik", "line", "pair.*")
    return p.select(
        "cik", "line", "tag", F.col("now.accession").alias("accession"), F.col("now.filed").cast("string").alias("filed"),
        F.col("now.value").alias("value_now"), F.col("prior.value").alias("value_prior"),
        F.col("now.period_end").cast("string").alias("end_now"), F.col("prior.period_end").cast("string").alias("end_prior"),
    )


def _annual(i: Inputs, *lines: str) -> DataFrame:
    """Wide issuer rows with line selections and pairs of the given flow lines."""
    lf, p = _periods(i, *dict.fromkeys(("revenue", "net_income_to_common", *lines)), reuse=True, both=True)
    anchors = p.groupBy("cik").agg(F.first("fy_end").alias("fy_end"), F.first("sheet_end").alias("sheet_end"))
    picked = X.pivot_lines(X.selected_lines(p), (*FLOW_LINES, *SHEET_LINES))
    pairs = X.annual_pairs(X.tag_pairs(lf, X.pair_anchors(p)))
    row = X.pivot_lines(pairs, FLOW_LINES, value="pair", prefix="pair_")
    return anchors.join(picked, "cik", "left").join(row, "cik", "left")


def _annual_sql(names) -> str:
    return O.compose(O.long_select("annual", "cik", names), "annual")


def _cells(rows: DataFrame, names) -> DataFrame:
    return S.issuer_long(rows, names).select("cik", "metric", "state", "value", "reason", F.concat_ws(",", "flags").alias("flags"))


def _made(i: Inputs, names) -> DataFrame:
    """Metrics of every issuer that reports their lines, from those lines alone."""
    needs = Needs.of(names)
    facts = i.stored_facts() if needs.lines(N.PAIR) else i.facts()
    return _cells(S.issuer_fundamentals(facts, None, AS_OF, needs=needs, buckets=i.issuer_parts()), names)


GROWTH = ("revenue_growth_yoy", "eps_growth_yoy")
MARGINS = ("gross_margin", "operating_margin", "net_margin")
CHANGES = ("gross_margin_change_yoy", "operating_margin_change_yoy", "net_margin_change_yoy")
CASH = ("fcf", "fcf_growth_yoy")


@query("growth", _annual_sql(GROWTH))
def growth(i: Inputs) -> DataFrame:
    return _made(i, GROWTH)


@query("margins", _annual_sql(MARGINS))
def margins(i: Inputs) -> DataFrame:
    return _made(i, MARGINS)


@query("margin_change", _annual_sql(CHANGES))
def margin_change(i: Inputs) -> DataFrame:
    return _made(i, CHANGES)


@query("free_cash_flow", _annual_sql(CASH))
def free_cash_flow(i: Inputs) -> DataFrame:
    return _made(i, CASH)


@query("derived_gross_profit", O.compose(f"""
  SELECT cik, CASE WHEN revenue.value IS NULL OR operating_cash_flow.value IS NULL THEN 'MISSING_INPUT' ELSE 'OK' END AS state,
    revenue.value - operating_cash_flow.value AS value,
    CASE WHEN revenue.value IS NULL OR operating_cash_flow.value IS NULL THEN 'COST_OF_REVENUE_NOT_REPORTED' END AS reason,
    CASE WHEN revenue.value IS NULL OR operating_cash_flow.value IS NULL THEN '' ELSE 'DERIVED_GROSS_PROFIT' END AS flags
  FROM wide""", "wide"))  # fmt: skip
def derived_gross_profit(i: Inputs) -> DataFrame:
    # the derived tables hold no cost line; operating cash flow stands in for it as a second amount
    rows = _annual(i, "operating_cash_flow")
    c = M.gross_profit_from_components(F.col("revenue.value"), F.col("operating_cash_flow.value"))
    return rows.select("cik", c.alias("c")).select("cik", *unpack(F.col("c")))


LEVERAGE = ("debt_to_equity_fy", "debt_to_equity_prior_fy", "debt_to_equity_change_yoy")
SHEET = ("total_debt", "net_debt", "debt_to_equity")


@query("leverage_change", O.compose(O.long_select("lever", "cik", LEVERAGE), "lever"))
def leverage_change(i: Inputs) -> DataFrame:
    lf, p = _periods(i, "revenue", "net_income_to_common", *FD.DEBT_LINES, "equity", both=True)
    pairs = X.annual_pairs(X.tag_pairs(lf, X.pair_anchors(p)))
    return _cells(FD.leverage(FD.filing_sheets(lf, pairs)), LEVERAGE)


@query("balance_sheet", O.compose(O.long_select("sheet", "cik", SHEET), "sheet"))
def balance_sheet(i: Inputs) -> DataFrame:
    facts = i.stored_facts()
    return _cells(S.issuer_fundamentals(facts, facts.select("cik").distinct(), AS_OF, needs=Needs.of(SHEET), buckets=i.issuer_parts()), SHEET)


@query("shares_outstanding", O.compose(f"SELECT cik, {O.parts('c')} FROM (SELECT cik, {O.SHARES} AS c FROM shares)", "shares"))
def shares_outstanding(i: Inputs) -> DataFrame:
    s = X.share_counts(X.line_facts(i.facts(), lines=("shares_outstanding",)))
    c = FD.shares_outstanding(F.col("shares_end"), F.col("shares_low"), F.col("shares_high"), AS_OF)
    return s.select("cik", c.alias("c")).select("cik", *unpack(F.col("c")))


# --- trailing twelve months ------------------------------------------------------------------------------------------


def _ttm(i: Inputs, *lines: str) -> DataFrame:
    return TT.choose_ttm(TT.ttm_outcomes(TT.ttm_parts(X.periods(X.line_facts(i.facts(), lines=lines)), lines)))


@query("ttm_revenue", O.compose(f"SELECT cik, tag, basis, {O.parts('ttm')} FROM ttm_rev", "ttm_rev"))
def ttm_revenue(i: Inputs) -> DataFrame:
    t = _ttm(i, "revenue")
    # the SQL answer names the construction even where it has no value
    basis = F.when(F.col("cur").isNull(), "FY").otherwise(TT.COMPOSED)
    return t.select("cik", "tag", basis.alias("basis"), *unpack(F.col("ttm")))


@query("ttm_growth", O.compose(f"SELECT cik, {O.parts('before', 'prior_')}, {O.parts('growth')} FROM ttm_growth", "ttm_rev"))
def ttm_growth(i: Inputs) -> DataFrame:
    lf, p = _periods(i, "revenue", reuse=True)
    by_tag = X.tag_pairs(lf, X.pair_anchors(p))
    chosen = TT.choose_ttm(TT.ttm_outcomes(TT.ttm_parts(p, ("revenue",))))
    rows = TT.prior_year_ttm(chosen, by_tag).withColumn("g", TT.ttm_growth(F.col("ttm"), F.col("ttm_prior")))
    return rows.select("cik", *unpack(F.col("ttm_prior"), "prior_"), *unpack(F.col("g")))


@query("ttm_eps", O.compose(f"SELECT cik, fy_shares, cur_shares, {O.parts('ttm')} FROM ttm_eps", "ttm_eps"))
def ttm_eps(i: Inputs) -> DataFrame:
    p = X.periods(X.line_facts(i.facts(), lines=("diluted_eps", "weighted_diluted_shares")))
    t = TT.choose_ttm(TT.ttm_outcomes(TT.ttm_parts(p, ("diluted_eps",))))
    return TT.share_guard(t, p).select("cik", "fy_shares", "cur_shares", *unpack(F.col("ttm")))


def _component_sql(role: str, sign: int, point: str) -> str:
    return f"""SELECT cik, line, tag, basis, '{role}' AS role, {sign} AS sign, {point}.value AS value, {point}.accession AS accession,
      CAST({point}.period_start AS VARCHAR) AS period_start, CAST({point}.period_end AS VARCHAR) AS period_end
    FROM ttm WHERE ttm.state = 'OK' AND {point} IS NOT NULL"""


@query("ttm_components", O.compose(" UNION ALL ".join([
    _component_sql("fiscal_year", 1, "fy"), _component_sql("current_ytd", 1, "cur"), _component_sql("prior_year_ytd", -1, "prior"),
]), "ttm"))
def ttm_components(i: Inputs) -> DataFrame:
    c = TT.components(_ttm(i, *TT.TTM_LINES))
    return c.select("cik", "line", "tag", "basis", "role", "sign", "value", "accession", day("period_start"), day("period_end"))


# --- valuation -------------------------------------------------------------------------------------------------------


def _quoted(i: Inputs) -> DataFrame:
    s = i.securities()
    return MK.issuer_quotes(s, MK.primary_listings(s), MK.newest_quotes(i.quotes()))


@query("newest_quotes", O.compose(
    "SELECT security_id, CAST(quote_date AS VARCHAR) AS quote_date, last_price, market_cap, year_high FROM newest_quote", "newest_quote"))
def newest_quotes(i: Inputs) -> DataFrame:
    return MK.newest_quotes(i.quotes()).select("security_id", day("quote_date"), "last_price", "market_cap", "year_high")


@query("primary_listing", O.compose("SELECT * FROM primaries", "primaries"))
def primary_listing(i: Inputs) -> DataFrame:
    return MK.primary_listings(i.securities())


@query("designated_listing", O.compose("""
  SELECT cik, coalesce(max(ticker) FILTER (security_id = pick), min(ticker)) AS primary_ticker,
    CASE WHEN count(*) FILTER (security_id = pick) > 0 THEN 'DESIGNATED' ELSE 'UNDESIGNATED_FIRST_LISTING' END AS designation, count(*) AS listings
  FROM (SELECT *, max(security_id) FILTER (exchange = 'NYSE') OVER (PARTITION BY cik) AS pick FROM v_securities WHERE cik IS NOT NULL) GROUP BY cik""",
    "v_securities"))
def designated_listing(i: Inputs) -> DataFrame:
    s = i.securities()
    nyse = s.where((F.col("exchange") == "NYSE") & F.col("cik").isNotNull())
    pick = nyse.groupBy("cik").agg(F.max_by("ticker", "security_id").alias("primary_ticker"))
    named = s.join(pick, "cik").select("ticker", "primary_ticker")
    return MK.primary_listings(s, named).select("cik", "primary_ticker", "designation", "listings")


@query("issuer_market_cap", O.compose(
    f"SELECT cik, primary_ticker, listings, CAST(quote_date AS VARCHAR) AS quote_date, {O.parts('issuer_market_cap')} FROM issuer_cap", "issuer_cap"))
def issuer_market_cap(i: Inputs) -> DataFrame:
    rows = _quoted(i)
    c = MK.market_cap(F.col("market_cap"), F.col("listings"), F.col("quote_date"), AS_OF)
    return rows.select("cik", "primary_ticker", "listings", day("quote_date"), c.alias("c")).select(
        "cik", "primary_ticker", "listings", "quote_date", *unpack(F.col("c"))
    )


@query("price_to_sales", O.compose(O.long_select("issuer_all", "cik", ("price_to_sales", "price_to_sales_ttm")), "issuer"))
def price_to_sales(i: Inputs) -> DataFrame:
    names = ("price_to_sales", "price_to_sales_ttm")
    return _cells(S.issuer_metrics(i.tables(), AS_OF, needs=Needs.of(names)), names)


@query("price_to_earnings", O.compose(f"SELECT ticker, cik, {O.parts('price_to_earnings')} FROM view_raw", "view"))
def price_to_earnings(i: Inputs) -> DataFrame:
    v = S.listing_views(i.tables(), AS_OF, max_age_days=None, metrics=["price_to_earnings"])
    return v.select("ticker", "cik", *unpack(F.col("price_to_earnings")))


@query("market_cap_check", O.compose(f"""
  SELECT cik, reason IS NULL AS eligible, reason, CASE WHEN reason IS NULL THEN issuer_market_cap.value / (last_close * shares_outstanding.value) - 1 END AS ratio_minus_one
  FROM (SELECT *, CASE WHEN multi_class THEN 'MULTI_CLASS_ISSUER' WHEN unavailable IS NOT NULL THEN 'FACTS_UNAVAILABLE:' || unavailable
      WHEN issuer_market_cap.state <> 'OK' THEN 'MARKET_CAP:' || issuer_market_cap.reason
      WHEN shares_outstanding.state <> 'OK' THEN 'SHARES_UNRELIABLE:' || shares_outstanding.reason
      WHEN last_close IS NULL THEN 'NO_CLOSE' END AS reason FROM view_raw WHERE security_id = primary_security_id)""", "view"))  # fmt: skip
def market_cap_check(i: Inputs) -> DataFrame:
    v = S.listing_views(i.tables(), AS_OF, max_age_days=None, metrics=["cap_check"])
    return v.where(F.col("cap_check").isNotNull()).select("cik", "cap_check.*")


@query("year_high_check", O.compose("""
  SELECT s.security_id, p.high_52w.value / nq.year_high - 1 AS year_high_diff FROM v_securities s JOIN prices p USING (security_id)
  JOIN newest_quote nq USING (security_id) WHERE p.high_52w.state = 'OK' AND nq.year_high <> 0""", "v_securities", "prices", "newest_quote"))  # fmt: skip
def year_high_check(i: Inputs) -> DataFrame:
    w = B.window_metrics(B.listing_aggregates(i.bars(), AS_OF)).select("security_id", "high_52w")
    nq = MK.newest_quotes(i.quotes()).select("security_id", "year_high")
    rows = i.securities().select("security_id").join(w, "security_id").join(nq, "security_id")
    return rows.select(
        "security_id", MK.year_high_difference(F.col("high_52w"), F.col("year_high")).alias("year_high_diff")
    ).where(F.col("year_high_diff").isNotNull())


# --- all metrics, screens, freshness -----------------------------------------------------------------------------------

ALL_METRICS = (*O.ISSUER_ORDER, *O.LISTING_ORDER)


@query("metrics", O.compose(O.long_select("view", "ticker, cik, security_id", ALL_METRICS), "view"))
def metrics(i: Inputs) -> DataFrame:
    long = S.long_metrics(S.listing_views(i.tables(), AS_OF))
    return long.withColumn("flags", F.concat_ws(",", "flags"))


@query("metric_states", O.compose(
    "SELECT metric, state, count(*) AS n FROM (" + O.long_select("view", "ticker, cik, security_id", ALL_METRICS) + ") GROUP BY ALL", "view"))
def metric_states(i: Inputs) -> DataFrame:
    long = S.long_metrics(S.listing_views(i.tables(), AS_OF))
    return long.groupBy("metric", "state").agg(F.count("*").alias("n"))


@query("core_fields_missing", O.compose(
    "SELECT count(*) * 4 AS cells, sum(" + " + ".join(f"({ln}.value IS NULL)::INT" for ln in CORE_LINES)
    + ")::BIGINT AS missing, sum(" + " + ".join(f"({ln}.value IS NULL)::INT" for ln in CORE_LINES) + ") / (count(*) * 4.0::DOUBLE) AS missing_rate FROM wide",
    "wide"))
def core_fields_missing(i: Inputs) -> DataFrame:
    _, p = _periods(i, *CORE_LINES, "cash")
    picked = X.pivot_lines(X.selected_lines(p), CORE_LINES)
    issuers = i.facts().select("cik").distinct()
    return Q.missing_core(issuers.join(picked, "cik", "left"), CORE_LINES)


SCREEN_GROWTH = SC.parse_screen(
    {
        "name": "growth",
        "classification": {"taxonomy": "nasdaq", "sector": "asia", "exclude_industries": ["JAPAN"]},
        "criteria": [
            {"metric": "drawdown_from_52w_high", "op": "lte", "value": -5, "unit": "percent"},
            {"metric": "revenue_growth_yoy", "op": "gt", "value": 15, "unit": "percent"},
            {"metric": "fcf", "op": "gt", "value": 0},
            {"metric": "price_to_sales", "op": "lt", "value": 500},
            {"metric": "gross_margin_change_yoy", "op": "gt", "value": 0, "unit": "fraction"},
        ],
    }
)
_GROWTH_CRITERIA = [
    ("drawdown_from_52w_high", "drawdown_from_52w_high.value <= -5 * 0.01::DOUBLE", "drawdown_from_52w_high <= -0.05"),
    ("revenue_growth_yoy", "revenue_growth_yoy.value > 15 * 0.01::DOUBLE", "revenue_growth_yoy > 0.15"),
    ("fcf", "fcf.value > 0", "fcf > 0.0"),
    ("price_to_sales", "price_to_sales.value < 500", "price_to_sales < 500.0"),
    ("gross_margin_change_yoy", "gross_margin_change_yoy.value > 0", "gross_margin_change_yoy > 0.0"),
]
_NASDAQ = """CASE WHEN nullif(sector, 'N/A') IS NULL AND industry IS NULL THEN 'UNEVALUABLE' WHEN nullif(sector, 'N/A') IS NULL THEN 'UNEVALUABLE'
  WHEN lower(sector) <> 'asia' THEN 'FAIL' WHEN industry IS NULL THEN 'UNEVALUABLE' WHEN lower(industry) = 'japan' THEN 'FAIL' ELSE 'PASS' END"""
_GROWTH_SQL = _roll_up_sql("view", _GROWTH_CRITERIA, _NASDAQ)


@query("screen", O.compose(_GROWTH_SQL, "view"))
def screen(i: Inputs) -> DataFrame:
    return SC.run_screen(S.listing_views(i.tables(), AS_OF, metrics=SC.metrics_of(SCREEN_GROWTH)), SCREEN_GROWTH)


_SCREENS = 50


def _many_specs() -> list[tuple[str, str]]:
    def criteria(n: int) -> list[dict]:
        return [
            {"metric": "drawdown_from_52w_high", "op": "lte", "value": -n, "unit": "percent"},
            {"metric": "price_return_1y", "op": "gt", "value": n - 25, "unit": "percent"},
            {"metric": "price_return_1m", "op": "between", "low": -n, "high": n, "unit": "percent"},
            {"metric": "high_52w", "op": "gte", "value": 1000 * n},
        ]

    return [(f"s{n:02d}", json.dumps({"name": f"s{n:02d}", "criteria": criteria(n)[: 2 + n % 3]})) for n in range(_SCREENS)]


_MANY_TESTS = (
    ("drawdown_from_52w_high", "drawdown_from_52w_high.value <= -n * 0.01::DOUBLE"), ("price_return_1y", "price_return_1y.value > (n - 25) * 0.01::DOUBLE"),
    ("price_return_1m", "price_return_1m.value BETWEEN -n * 0.01::DOUBLE AND n * 0.01::DOUBLE"), ("high_52w", "high_52w.value >= 1000 * n"),
)
_MANY_COUNT = "len(list_filter(r[:2 + n % 3], lambda x: x = '{}'))"


@query("screens_at_once", O.compose(f"""
  SELECT *, CASE WHEN criteria_failed > 0 THEN 'NO_MATCH' WHEN criteria_unevaluable > 0 THEN 'UNEVALUABLE' ELSE 'MATCH' END AS status FROM (
    SELECT 's' || lpad(CAST(n AS VARCHAR), 2, '0') AS screen, security_id, ticker, cik, {_MANY_COUNT.format('PASS')} AS criteria_passed, {_MANY_COUNT.format('FAIL')} AS criteria_failed,
      {_MANY_COUNT.format('UNEVALUABLE')} AS criteria_unevaluable
    FROM (SELECT n, security_id, ticker, cik, [{', '.join(_criterion_sql(m, t) for m, t in _MANY_TESTS)}] AS r FROM price_view, range({_SCREENS}) t(n)))""", "price_view"))  # fmt: skip
def screens_at_once(i: Inputs) -> DataFrame:
    """Fifty screens from their JSON texts over all listings in one plan."""
    views = S.price_views(TB.Tables(i.securities(), bars=i.bars()), AS_OF)
    criteria = SC.criteria_table(constant_frame(i.spark, _many_specs(), "screen, spec"))
    return SC.run_screens(S.long_metrics(views), criteria)


@query("screen_order", O.compose(f"""
  SELECT ticker, cik, security_id, status, row_number() OVER (ORDER BY ticker, cik, security_id) - 1 AS position FROM ({_roll_up_sql('price_view', _DRAWDOWN_CRITERIA)})""", "price_view"))  # fmt: skip
def screen_order(i: Inputs) -> DataFrame:
    """A screen written in order of ticker and issuer, and each row's place in the files."""
    path = ST.stream_folder(i.spark, "ordered")
    TB.write_ordered(drawdown_screen(i), path, "ticker", "cik", "security_id")
    return TB.read_ordered(i.spark, path).select("ticker", "cik", "security_id", "status", "position")


@query("screen_counts", O.compose(f"""
  SELECT count(*) AS screened, count(*) FILTER (status = 'MATCH') AS matches, count(*) FILTER (status = 'NO_MATCH') AS failed,
    count(*) FILTER (status = 'UNEVALUABLE') AS missing_data_exclusions FROM ({_roll_up_sql('price_view', _DRAWDOWN_CRITERIA)})""", "price_view"))  # fmt: skip
def screen_counts(i: Inputs) -> DataFrame:
    return SC.counts(drawdown_screen(i))


@query("screen_criteria", O.compose(" UNION ALL ".join(f"""
  SELECT ticker, cik, '{m}' AS metric, '{text}' AS condition, {_criterion_sql(m, t)} AS result, {m}.state AS metric_state,
    {m}.value AS value, {m}.reason AS reason FROM price_view""" for m, t, text in _DRAWDOWN_CRITERIA), "price_view"))  # fmt: skip
def screen_criteria(i: Inputs) -> DataFrame:
    views = S.price_views(TB.Tables(i.securities(), bars=i.bars()), AS_OF)
    return SC.criteria_rows(views, SCREEN_DRAWDOWN).drop("threshold", "low", "high")


@query("classification_filters", O.compose(f"""
  SELECT ticker, {_NASDAQ} AS nasdaq, CASE WHEN sic IS NULL THEN 'UNEVALUABLE' WHEN lpad(sic, 4, '0') IN ('3674', '3578', '3580') THEN 'PASS' ELSE 'FAIL' END AS sic
  FROM v_securities""", "v_securities"))  # fmt: skip
def classification_filters(i: Inputs) -> DataFrame:
    nasdaq = SC.classification_outcome(SCREEN_GROWTH.classification)
    sic = SC.classification_outcome({"taxonomy": "sec_sic", "sic_codes": ["3674", "3578", "3580"]})
    return i.securities().select("ticker", nasdaq["result"].alias("nasdaq"), sic["result"].alias("sic"))


@query("freshness", O.compose(f"""
  SELECT security_id, CAST(newest_bar AS VARCHAR) AS last_bar, date_diff('day', newest_bar, {O.AS_OF})::INT AS price_age_days, CAST(quote_date AS VARCHAR) AS quote_date,
    date_diff('day', quote_date, {O.AS_OF})::INT AS quote_age_days, date_diff('day', newest_bar, {O.AS_OF}) > 7 AS price_metrics_blocked,
    date_diff('day', quote_date, {O.AS_OF}) > 7 AS quote_metrics_blocked
  FROM listing_agg JOIN newest_quote USING (security_id)""", "listing_agg", "newest_quote"))  # fmt: skip
def freshness(i: Inputs) -> DataFrame:
    rows = B.last_bars(i.bars()).join(MK.newest_quotes(i.quotes()).select("security_id", "quote_date"), "security_id")
    r = FR.freshness_record(rows, AS_OF)
    return r.select("security_id", day("last_bar"), "price_age_days", day("quote_date"), "quote_age_days",
                    "price_metrics_blocked", "quote_metrics_blocked")


@query("catalog", "SELECT metric, scope, unit, array_to_string(lines, ',') AS input_lines, uses_prices, listings FROM (VALUES "
       + ", ".join(f"('{n}', '{s}', '{u}', CAST({list(ls)!r} AS VARCHAR[]), {p})" for n, s, u, ls, p in METRIC.values())
       + ") AS c(metric, scope, unit, lines, uses_prices), (SELECT count(*) AS listings FROM supplier)")
def catalog(i: Inputs) -> DataFrame:
    # the catalog itself is constant; the number of listings it applies to comes from the data
    n = i.table("supplier").agg(F.count("*").alias("listings")).withColumn("k", F.lit(1))
    c = catalog_frame(i.spark).withColumn("k", F.lit(1)).join(n, "k")
    return c.select("metric", "scope", "unit", F.array_join("input_lines", ",").alias("input_lines"), "uses_prices", "listings")


@query("metric_provenance", O.compose("""
  SELECT cik, metric, string_agg(line || ':' || tag || '@' || accession, ';' ORDER BY line) AS inputs, count(*) AS n FROM (
    SELECT m.metric AS metric, unnest(m.lines) AS line FROM (SELECT unnest([""" + ", ".join(
        f"{{'metric': '{n}', 'lines': CAST({list(ls)!r} AS VARCHAR[])}}" for n, _, _, ls, _ in METRIC.values() if ls
    ) + """]) AS m)) c JOIN sel USING (line) WHERE sel.value IS NOT NULL GROUP BY cik, metric""", "sel"))
def metric_provenance(i: Inputs) -> DataFrame:
    _, p = _periods(i)
    lines = X.selected_lines(p).select("cik", "line", "sel.*").where(F.col("value").isNotNull())
    backed = catalog_frame(i.spark).select("metric", F.explode("input_lines").alias("line"))
    ref = F.concat("line", F.lit(":"), "tag", F.lit("@"), "accession")
    # at most five lines back one metric of one issuer
    return lines.join(F.broadcast(backed), "line").groupBy("cik", "metric").agg(
        F.array_join(F.array_sort(F.collect_list(ref)), ";").alias("inputs"), F.count("*").alias("n")
    )


# --- universe and provenance -------------------------------------------------------------------------------------------


@query("universe", O.compose("""
  SELECT s.ticker, s.cik, s.exchange, nullif(s.sector, 'N/A') AS nasdaq_sector, s.sic AS sec_sic, CAST(b.newest_bar AS VARCHAR) AS last_price_bar,
    CAST(nq.quote_date AS VARCHAR) AS last_quote_date, coalesce(f.n, 0) AS fact_rows, c.unavailable
  FROM v_securities s LEFT JOIN listing_agg b USING (security_id) LEFT JOIN newest_quote nq USING (security_id)
    LEFT JOIN (SELECT cik, count(*) AS n FROM v_facts GROUP BY cik) f ON f.cik = s.cik LEFT JOIN coverage c ON c.cik = s.cik""",
    "v_securities", "listing_agg", "newest_quote", "v_facts", "coverage"))
def universe(i: Inputs) -> DataFrame:
    return universe_overview(i.tables()).select(
        "ticker", "cik", "exchange", "nasdaq_sector", "sec_sic", day("last_price_bar"), day("last_quote_date"), "fact_rows", "unavailable"
    )


def universe_overview(t: TB.Tables) -> DataFrame:
    """One row per stored listing with coverage and data dates."""
    bars = t.bars.groupBy("security_id").agg(F.max("trade_date").alias("last_price_bar"))
    quotes = t.quotes.groupBy("security_id").agg(F.max("quote_date").alias("last_quote_date"))
    facts = t.facts.groupBy("cik").agg(F.count("*").alias("fact_rows"))
    rows = t.securities.join(bars, "security_id", "left").join(quotes, "security_id", "left").join(facts, "cik", "left")
    rows = rows.join(PV.fundamentals_coverage(t.sources), "cik", "left")
    return rows.withColumns(
        {
            "fact_rows": F.coalesce("fact_rows", F.lit(0)),
            "nasdaq_sector": F.when(F.col("sector_source") == "nasdaq", T.unknown_if_na(F.col("sector"))),
            "sec_sic": F.when(F.col("sic_source") == "sec", F.col("sic")),
        }
    )


@query("requested_universe", O.compose("""
  SELECT 'S' || c_custkey AS ticker, CASE WHEN s.ticker IS NULL THEN 'NOT_STORED' WHEN NOT s.has_cik THEN 'STORED_WITHOUT_CIK' ELSE 'STORED' END AS status
  FROM customer LEFT JOIN (SELECT ticker, bool_or(cik IS NOT NULL) AS has_cik FROM v_securities GROUP BY ticker) s ON s.ticker = 'S' || c_custkey""",
    "v_securities"))
def requested_universe(i: Inputs) -> DataFrame:
    wanted = i.table("customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("ticker"))
    return TB.requested_universe(i.securities(), wanted)


@query("listings_by_issuer", O.compose("""
  SELECT lpad(CAST(c_custkey + 1000000 AS VARCHAR), 10, '0') AS cik, count(s.security_id) AS listings FROM customer
  LEFT JOIN v_securities s ON s.cik = lpad(CAST(c_custkey + 1000000 AS VARCHAR), 10, '0') GROUP BY 1""", "v_securities"))  # fmt: skip
def listings_by_issuer(i: Inputs) -> DataFrame:
    return i.issuers().select("cik").join(i.securities().select("cik", "security_id"), "cik", "left").groupBy("cik").agg(
        F.count("security_id").alias("listings")
    )


@query("multi_class", O.compose(
    "SELECT cik, ticker, listings FROM (SELECT *, count(*) OVER (PARTITION BY cik) AS listings FROM v_securities WHERE cik IS NOT NULL) WHERE listings > 1",
    "v_securities"))
def multi_class(i: Inputs) -> DataFrame:
    return Q.multi_class(i.securities())


@query("price_source", O.compose("""
  SELECT security_id, source_id, provider, dataset, CAST(retrieved_at AS DATE)::VARCHAR AS retrieved_on, is_fallback
  FROM v_bars JOIN v_sources USING (source_id) QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY trade_date DESC) = 1""",
    "v_bars", "v_sources"))
def price_source(i: Inputs) -> DataFrame:
    s = PV.newest_row_source(i.bars(), i.sources(), "security_id", "trade_date")
    return s.select("security_id", "source_id", "provider", "dataset", F.col("retrieved_at").cast("date").cast("string").alias("retrieved_on"), "is_fallback")


@query("quote_source", O.compose("""
  SELECT security_id, source_id, provider, dataset, is_fallback FROM v_quotes JOIN v_sources USING (source_id)
  QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY quote_date DESC) = 1""", "v_quotes", "v_sources"))  # fmt: skip
def quote_source(i: Inputs) -> DataFrame:
    s = PV.newest_row_source(i.quotes(), i.sources(), "security_id", "quote_date")
    return s.select("security_id", "source_id", "provider", "dataset", "is_fallback")


@query("facts_source", O.compose("""
  SELECT cik, source_id, content_hash, CASE WHEN detail IS NOT NULL THEN json_extract_string(detail, '$.notes[0]') END AS note FROM v_sources
  WHERE provider = 'sec' AND dataset = 'companyfacts'
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY retrieved_at DESC, source_id DESC) = 1""", "v_sources"))  # fmt: skip
def facts_source(i: Inputs) -> DataFrame:
    s = PV.facts_retrievals(i.sources())
    return s.select("cik", "source_id", "content_hash", T.unsupported_reason(F.col("detail")).alias("note"))


@query("source_summary", O.compose("""
  SELECT provider, dataset, count(*) AS retrievals, sum(CASE WHEN is_fallback THEN 1 ELSE 0 END)::BIGINT AS fallbacks,
    count(provider_version) AS with_version, count(as_of) AS with_as_of, CAST(max(retrieved_at) AS DATE)::VARCHAR AS last_retrieved
  FROM v_sources GROUP BY ALL""", "v_sources"))  # fmt: skip
def source_summary(i: Inputs) -> DataFrame:
    s = PV.source_summary(i.sources())
    return s.withColumn("last_retrieved", F.col("last_retrieved").cast("date").cast("string"))


@query("last_sync", O.compose("SELECT CAST(max(retrieved_at) AS DATE)::VARCHAR AS last_sync FROM v_sources", "v_sources"))
def last_sync(i: Inputs) -> DataFrame:
    return i.sources().agg(F.max("retrieved_at").cast("date").cast("string").alias("last_sync"))


@query("recent_retrievals", O.compose(
    "SELECT source_id, provider, dataset FROM v_sources ORDER BY source_id DESC LIMIT 10", "v_sources"))
def recent_retrievals(i: Inputs) -> DataFrame:
    return TB.recent(i.sources().select("source_id", "provider", "dataset"), "source_id", 10)


@query("table_counts", O.compose(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM v_{v}" for n, v in (
        ("securities", "securities"), ("financial_facts", "facts"), ("price_daily", "bars"), ("market_quotes", "quotes"),
        ("filings", "filings"), ("sources", "sources"))
), "v_securities", "v_facts", "v_quotes", "v_filings", "v_sources"))
def table_counts(i: Inputs) -> DataFrame:
    return TB.table_counts(
        {"securities": i.securities(), "financial_facts": i.facts(), "price_daily": i.bars(), "market_quotes": i.quotes(),
         "filings": i.filings(), "sources": i.sources()}
    )


@query("fallback_choice", O.compose("""
  SELECT provider, is_fallback, count(*) AS bars FROM (
    SELECT 'primary' AS provider, false AS is_fallback, security_id, trade_date FROM v_bars WHERE volume > 1
    UNION ALL SELECT 'backup', true, security_id, trade_date FROM v_bars b
    WHERE NOT EXISTS (SELECT 1 FROM v_bars x WHERE x.volume > 1 AND x.security_id = b.security_id AND x.trade_date = b.trade_date)) GROUP BY ALL""",
    "v_bars"))
def fallback_choice(i: Inputs) -> DataFrame:
    bars = i.bars().select("security_id", "trade_date", "volume")
    primary = bars.where(F.col("volume") > 1).withColumn("provider", F.lit("primary"))
    both = PV.primary_else_fallback(primary, bars.withColumn("provider", F.lit("backup")), ["security_id", "trade_date"])
    return both.groupBy("provider", "is_fallback").agg(F.count("*").alias("bars"))


# --- writes ----------------------------------------------------------------------------------------------------------

STREAM_BUCKETS = 16
BATCH_KEYS = ["l_orderkey", "l_linenumber"]
BATCH_ARRIVAL = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
BATCH_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
]
_ARR = "l_partkey, l_suppkey, l_shipdate, l_extendedprice"
_ARR_DESC = "l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC"
_LAST = f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ARR_DESC}) = 1"
_STORED = f"""SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ARR}) = 1"""
_SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in BATCH_COLUMNS[3:])
_UPSERT_CTE = f"""WITH n AS ({_LAST}), o AS ({_STORED}), u AS (
  SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, o.l_linenumber) AS l_linenumber,
    CASE WHEN o.l_orderkey IS NULL THEN 'inserted' WHEN n.l_orderkey IS NULL THEN 'kept'
      WHEN o.l_partkey = n.l_partkey AND {_SAME} THEN 'unchanged' ELSE 'updated' END AS status,
    CASE WHEN o.l_orderkey IS NULL OR NOT (o.l_partkey = n.l_partkey AND {_SAME}) THEN n.l_extendedprice ELSE o.l_extendedprice END AS l_extendedprice
  FROM n FULL OUTER JOIN o USING (l_orderkey, l_linenumber)) """


def _batch(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """(stored table, incoming batch): what arrived first for early shipments, and all line items."""
    li = i.table("lineitem").select(*BATCH_COLUMNS)
    early = li.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    rest = [c for c in BATCH_COLUMNS if c not in BATCH_KEYS]
    order = F.struct(*BATCH_ARRIVAL, *[c for c in rest if c not in BATCH_ARRIVAL])
    stored = early.groupBy(*BATCH_KEYS).agg(F.min(order).alias("o")).select(*BATCH_KEYS, "o.*").select(*BATCH_COLUMNS)
    return stored, li


def _classified(i: Inputs) -> DataFrame:
    stored, li = _batch(i)
    unique = U.latest_in_batch(li, BATCH_KEYS, BATCH_ARRIVAL, BATCH_COLUMNS)
    return U.classify(stored, unique, BATCH_KEYS, BATCH_COLUMNS)


@query("dedupe_last_wins", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM ({_LAST})")
def dedupe_last_wins(i: Inputs) -> DataFrame:
    li = i.table("lineitem").select(*BATCH_COLUMNS)
    rows = U.latest_in_batch(li, BATCH_KEYS, BATCH_ARRIVAL, BATCH_COLUMNS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("repeated_keys", f"""
  SELECT l_orderkey, l_linenumber, count(prev) AS repeats, count(*) FILTER (prev <> cur) AS conflicting FROM (
    SELECT *, lag(cur) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ARR}) AS prev FROM (
      SELECT *, {{'q': l_quantity, 'f': l_returnflag}} AS cur FROM lineitem)) GROUP BY 1, 2 HAVING count(prev) > 0""")  # fmt: skip
def repeated_keys(i: Inputs) -> DataFrame:
    return K.repeats_per_key(i.table("lineitem"), BATCH_KEYS, BATCH_ARRIVAL, ["l_quantity", "l_returnflag"]).drop("identical")


@query("upsert_status", _UPSERT_CTE + "SELECT l_orderkey, l_linenumber, status FROM u")
def upsert_status(i: Inputs) -> DataFrame:
    return U.status_rows(_classified(i), BATCH_COLUMNS).select(*BATCH_KEYS, "status")


@query("upsert_table", _UPSERT_CTE + "SELECT l_orderkey, l_linenumber, l_extendedprice FROM u")
def upsert_table(i: Inputs) -> DataFrame:
    return U.merged(_classified(i), BATCH_COLUMNS).select(*BATCH_KEYS, "l_extendedprice")


@query("upsert_counts", _UPSERT_CTE + """
  SELECT count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'updated') AS updated,
    count(*) FILTER (status = 'unchanged') AS unchanged, (SELECT count(*) FROM lineitem) - count(*) FILTER (status <> 'kept') AS duplicates FROM u""")  # fmt: skip
def upsert_counts(i: Inputs) -> DataFrame:
    _, li = _batch(i)
    return U.upsert_counts(_classified(i), li)


@query("idempotent_rerun", f"SELECT 0::BIGINT AS inserted, 0::BIGINT AS updated, count(*) AS unchanged FROM ({_LAST})")
def idempotent_rerun(i: Inputs) -> DataFrame:
    stored, li = _batch(i)
    unique = U.latest_in_batch(li, BATCH_KEYS, BATCH_ARRIVAL, BATCH_COLUMNS)
    first = U.merged(U.classify(stored, unique, BATCH_KEYS, BATCH_COLUMNS, in_place=True), BATCH_COLUMNS)
    second = U.classify(first, unique, BATCH_KEYS, BATCH_COLUMNS, in_place=True)
    return second.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (U.INSERTED, U.UPDATED, U.UNCHANGED)])


_ID_STORED = """SELECT security_id, CASE WHEN exchange = 'NYSE' THEN cik END AS cik, ticker, name, sector FROM v_securities"""
_ID_BATCH = """SELECT ticker, cik, CASE WHEN exchange = 'NYSE' THEN NULL ELSE name || ' Inc' END AS name, upper(sector) AS sector FROM v_securities
  UNION ALL SELECT 'N' || s_suppkey, NULL, s_name, NULL FROM supplier"""


@query("identity_merge", O.compose(f"""
  SELECT s.security_id, b.ticker, coalesce(b.cik, s.cik) AS cik,
    CASE WHEN s.security_id IS NULL THEN 'inserted' WHEN b.cik IS NOT NULL AND s.cik IS NULL THEN 'adopted' ELSE 'matched' END AS action,
    coalesce(b.name, s.name) AS name, coalesce(b.sector, s.sector) AS sector
  FROM ({_ID_BATCH}) b LEFT JOIN ({_ID_STORED}) s ON s.ticker = b.ticker AND (s.cik IS NULL OR b.cik IS NULL OR s.cik = b.cik)""",
    "v_securities"))
def identity_merge(i: Inputs) -> DataFrame:
    s = i.securities()
    nyse = F.col("exchange") == "NYSE"
    stored = s.select("security_id", F.when(nyse, F.col("cik")).alias("cik"), "ticker", "name", "sector")
    incoming = s.select("ticker", "cik", F.when(~nyse, F.concat("name", F.lit(" Inc"))).alias("name"), F.upper("sector").alias("sector"), F.col("security_id").alias("arrival"))
    sup = i.table("supplier")
    none = F.lit(None).cast("string")
    new = sup.select(F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("ticker"), none.alias("cik"), F.col("s_name").alias("name"), none.alias("sector"), F.col("s_suppkey").alias("arrival"))
    return U.merge_identities(stored, incoming.unionByName(new), ["arrival"], ["name", "sector"])


@query("business_keys", O.compose("""
  SELECT cik || '|' || taxonomy || '|' || concept || '|' || unit || '|' || coalesce(CAST(period_start AS VARCHAR), '') || '|' || CAST(period_end AS VARCHAR)
    || '|' || coalesce(accession_no, '') AS fact_key, value FROM v_facts""", "v_facts"))  # fmt: skip
def business_keys(i: Inputs) -> DataFrame:
    c = F.col
    key = T.fact_key(c("cik"), c("taxonomy"), c("concept"), c("unit"), c("period_start"), c("period_end"), c("accession_no"))
    return i.facts().select(key.alias("fact_key"), "value")


# --- quality ---------------------------------------------------------------------------------------------------------


def _bars_for_checks(i: Inputs) -> DataFrame:
    return i.raw_bars().select("security_id", "trade_date", "open", "high", "low", "close", F.lit(None).cast("double").alias("adj_close"), "volume",
                               F.when(F.col("volume") > 0, F.col("arrival")).alias("source_id"))


def _integrity(i: Inputs) -> DataFrame:
    facts = i.facts().withColumn("source_id", F.when(F.col("form") == "10-K", F.col("fiscal_year")))
    filings = i.filings().withColumn("source_id", F.when(F.col("form") != "S-1", F.lit(1)))
    return Q.integrity_report(i.securities(), facts, _bars_for_checks(i), i.quotes(), filings, i.sources())


_INTEGRITY_SQL = """
  SELECT 'duplicate_securities' AS check_name, count(*) AS violations FROM (SELECT 1 FROM v_securities GROUP BY ticker, coalesce(cik, '') HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_price_keys', count(*) FROM (SELECT 1 FROM v_raw GROUP BY security_id, trade_date HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_fact_keys', count(*) FROM (SELECT 1 FROM v_facts GROUP BY cik, taxonomy, concept, unit, coalesce(period_start, DATE '1900-01-01'), period_end, accession_no HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_filings', count(*) FROM (SELECT 1 FROM v_filings GROUP BY accession_no HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_quote_keys', count(*) FROM (SELECT 1 FROM v_quotes GROUP BY security_id, quote_date HAVING count(*) > 1)
  UNION ALL SELECT 'prices_without_source', count(*) FROM v_raw WHERE NOT volume > 0
  UNION ALL SELECT 'facts_without_source', count(*) FROM v_facts WHERE form <> '10-K'
  UNION ALL SELECT 'filings_without_source', count(*) FROM v_filings WHERE form = 'S-1'
  UNION ALL SELECT 'quotes_without_source', count(*) FROM v_quotes WHERE source_id IS NULL
  UNION ALL SELECT 'facts_without_accession_filed_or_form', count(*) FROM v_facts WHERE accession_no IS NULL OR filed_date IS NULL OR form IS NULL
  UNION ALL SELECT 'non_finite_prices', count(*) FROM v_raw WHERE NOT (isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close))
  UNION ALL SELECT 'non_finite_facts', count(*) FROM v_facts WHERE NOT isfinite(value)
  UNION ALL SELECT 'bad_price_rows', count(*) FROM v_raw WHERE close <= 0 OR high < low OR close > high * 1.0001::DOUBLE OR close < low * 0.9999::DOUBLE
  UNION ALL SELECT 'adjusted_close_populated', 0
  UNION ALL SELECT 'unnormalised_ciks', (SELECT count(*) FROM v_securities WHERE cik IS NOT NULL AND NOT regexp_full_match(cik, '[0-9]{10}'))
    + (SELECT count(*) FROM v_facts WHERE NOT regexp_full_match(cik, '[0-9]{10}')) + (SELECT count(*) FROM v_filings WHERE NOT regexp_full_match(cik, '[0-9]{10}'))
  UNION ALL SELECT 'classification_without_source', count(*) FROM v_securities WHERE ((sector IS NOT NULL OR industry IS NOT NULL) AND sector_source IS NULL) OR (sic IS NOT NULL AND sic_source IS NULL)
  UNION ALL SELECT 'securities_without_cik', count(*) FROM v_securities WHERE cik IS NULL
  UNION ALL SELECT 'sources_missing_command_or_parameters', count(*) FROM v_sources WHERE command IS NULL OR parameters IS NULL
  UNION ALL SELECT 'sources_missing_content_hash', count(*) FROM v_sources WHERE content_hash IS NULL"""
_INTEGRITY_NEEDS = ("v_securities", "v_raw", "v_facts", "v_filings", "v_quotes", "v_sources")


@query("integrity_report", O.compose(_INTEGRITY_SQL, *_INTEGRITY_NEEDS))
def integrity_report(i: Inputs) -> DataFrame:
    return _integrity(i)


@query("p95_seconds", """
  SELECT event_type AS provider, count(*) AS n, list_sort(list(value))[CAST(ceil(0.95::DOUBLE * count(*)) AS BIGINT)] AS p95 FROM events GROUP BY 1""")  # fmt: skip
def p95_seconds(i: Inputs) -> DataFrame:
    e = i.table("events").select(F.col("event_type").alias("provider"), "value")
    r = K.exact_rank(e, ["provider"], "value", F.ceil(F.col("n") * 0.95))
    return r.withColumnRenamed("value", "p95")


@query("upper_median_seconds", """
  SELECT event_type AS provider, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1""")  # fmt: skip
def upper_median_seconds(i: Inputs) -> DataFrame:
    e = i.table("events").select(F.col("event_type").alias("provider"), "value")
    r = K.exact_rank(e, ["provider"], "value", F.floor(F.col("n") / 2) + 1)
    return r.withColumnRenamed("value", "upper_median")


@query("request_peak", """
  SELECT provider, max(n) AS peak_per_second FROM (SELECT event_type AS provider, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY provider""")  # fmt: skip
def request_peak(i: Inputs) -> DataFrame:
    return Q.request_peak(i.table("events").select(F.col("event_type").alias("provider"), "ts"))


@query("request_statistics", """
  SELECT event_type AS provider, count(*) AS requests, count(*) FILTER (json_extract_string(props, '$.k') = '3') AS http_403,
    count(*) FILTER (json_extract_string(props, '$.k') = '29') AS http_429,
    count(*)::DOUBLE / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000::DOUBLE) AS per_second FROM events GROUP BY 1""")  # fmt: skip
def request_statistics(i: Inputs) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    status = F.when(k == "3", "403").when(k == "29", "429").otherwise("200")
    return Q.request_statistics(i.table("events").select(F.col("event_type").alias("provider"), "ts", status.alias("status")))


_OUTCOMES_SQL = """(SELECT cik, ticker, cik IS NOT NULL AS identity, p.security_id IS NOT NULL AS price, nq.market_cap IS NOT NULL AS quote,
    f.cik IS NOT NULL AND c.cik IS NULL AS facts, CASE WHEN c.cik IS NOT NULL THEN 'UNSUPPORTED_TAXONOMY' WHEN f.cik IS NOT NULL THEN 'OK' ELSE 'NO_ALLOWLISTED_FACTS' END AS facts_status
  FROM v_securities s LEFT JOIN (SELECT DISTINCT security_id FROM v_bars) p USING (security_id) LEFT JOIN newest_quote nq USING (security_id)
    LEFT JOIN (SELECT DISTINCT cik FROM v_facts) f USING (cik) LEFT JOIN coverage c USING (cik))"""
_OUTCOME_NEEDS = ("v_securities", "newest_quote", "v_facts", "coverage")


def _outcomes(i: Inputs) -> DataFrame:
    s = i.securities().select("security_id", "cik", "ticker")
    bars = i.listed().withColumn("has_bar", F.lit(True))
    nq = MK.newest_quotes(i.quotes()).select("security_id", "market_cap")
    facts = i.facts().select("cik").distinct().withColumn("has_fact", F.lit(True))
    rows = s.join(bars, "security_id", "left").join(nq, "security_id", "left").join(facts, "cik", "left")
    rows = rows.join(PV.fundamentals_coverage(i.sources()), "cik", "left")
    gone, has = F.col("unavailable").isNotNull(), F.coalesce("has_fact", F.lit(False))
    return rows.select(
        "cik", "ticker", F.col("cik").isNotNull().alias("identity"), F.coalesce("has_bar", F.lit(False)).alias("price"),
        F.col("market_cap").isNotNull().alias("quote"), (has & ~gone).alias("facts"),
        F.when(gone, "UNSUPPORTED_TAXONOMY").when(has, "OK").otherwise("NO_ALLOWLISTED_FACTS").alias("facts_status"),
    )


@query("outcome_groups", O.compose(f"""
  SELECT CASE WHEN identity AND price AND quote AND facts THEN 'succeeded' WHEN identity AND price AND quote AND facts_status = 'UNSUPPORTED_TAXONOMY'
    THEN 'expected_unsupported' ELSE 'failed' END AS outcome, count(*) AS securities FROM {_OUTCOMES_SQL} GROUP BY 1""", *_OUTCOME_NEEDS))  # fmt: skip
def outcome_groups(i: Inputs) -> DataFrame:
    return _outcomes(i).groupBy(Q.outcome_group().alias("outcome")).agg(F.count("*").alias("securities"))


@query("run_rates", O.compose(f"""
  SELECT count(*) AS attempted, count(*) FILTER (identity) AS identified, count(*) FILTER (identity) / count(*)::DOUBLE AS identity_rate,
    count(cik) / count(*)::DOUBLE AS cik_rate, count(*) FILTER (identity AND price) / (count(*) FILTER (identity))::DOUBLE AS price_rate,
    count(*) FILTER (identity AND quote) / (count(*) FILTER (identity))::DOUBLE AS quote_rate,
    count(*) FILTER (identity AND facts) / (count(*) FILTER (identity) - count(*) FILTER (identity AND facts_status = 'UNSUPPORTED_TAXONOMY'))::DOUBLE AS fact_rate
  FROM {_OUTCOMES_SQL}""", *_OUTCOME_NEEDS))  # fmt: skip
def run_rates(i: Inputs) -> DataFrame:
    return Q.run_rates(_outcomes(i))


def _roles(i: Inputs) -> DataFrame:
    """Listings with roles, from the supplier's nation and balance."""
    s = i.securities().where(F.col("cik").isNotNull())
    return s.select(
        "cik", "ticker",
        F.array_compact(F.array(
            F.when(F.col("sector") == "AFRICA", "adr"), F.when(F.col("exchange") == "NYSE", "large_tech"),
            F.when(F.col("sic") == "3578", "financial"),
        )).alias("roles"),
    )


_ROLES_SQL = """(SELECT cik, ticker, list_filter([CASE WHEN sector = 'AFRICA' THEN 'adr' END, CASE WHEN exchange = 'NYSE' THEN 'large_tech' END,
    CASE WHEN sic = '3578' THEN 'financial' END], lambda r: r IS NOT NULL) AS roles FROM v_securities WHERE cik IS NOT NULL)"""


@query("industrial_issuers", O.compose(
    f"SELECT cik FROM {_ROLES_SQL} GROUP BY cik HAVING NOT bool_or(list_has_any(roles, ['financial', 'adr']))", "v_securities"))
def industrial_issuers(i: Inputs) -> DataFrame:
    return Q.industrial_issuers(_roles(i))


@query("role_coverage", O.compose(f"SELECT DISTINCT unnest(roles) AS role, ticker FROM {_ROLES_SQL}", "v_securities"))
def role_coverage(i: Inputs) -> DataFrame:
    return Q.role_coverage(_roles(i))


_SIZED = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("security_id", "cik", "ticker"))
_WORDS = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) AS w{k}" for k in range(8))


@query("manifest_digest", O.compose(f"""
  SELECT sha256(concat_ws('|', {', '.join(f'CAST(w{k} AS VARCHAR)' for k in range(8))}, CAST(rows AS VARCHAR))) AS digest, rows FROM (
    SELECT {_WORDS}, count(*) AS rows FROM (SELECT sha256({_SIZED}) AS h FROM v_securities))""",
    "v_securities"))
def manifest_digest(i: Inputs) -> DataFrame:
    return Q.digest(i.securities(), ["security_id", "cik", "ticker"])


def _warnings(i: Inputs) -> DataFrame:
    def rows(df: DataFrame, category: str, provider: str, stage: str, detail: Column) -> DataFrame:
        return df.select(F.lit(category).alias("category"), "security_id", F.lit(provider).alias("provider"), F.lit(stage).alias("stage"), detail.alias("detail"))

    raw = i.raw_bars()
    dup = B.duplicate_bars(raw, ARRIVAL).groupBy("security_id").agg(F.sum("repeats").alias("n"), F.sum("conflicting").alias("bad"))
    unlabelled = i.securities().where(T.unknown_if_na(F.col("sector")).isNull() & T.unknown_if_na(F.col("industry")).isNull())
    no_cap = MK.newest_quotes(i.quotes()).where(F.col("market_cap").isNull())
    n = F.col("n").cast("string")
    return Q.warnings(
        [
            rows(B.reject_counts(raw), "REJECTED_PRICE_ROWS", "cboe", "prices", F.concat_ws(":", "reason", F.col("rows").cast("string"))),
            rows(dup.where(F.col("bad") > 0), "CONFLICTING_DUPLICATE_PROVIDER_ROWS", "cboe", "prices", n),
            rows(dup.where(F.col("bad") == 0), "DUPLICATE_PROVIDER_ROWS", "cboe", "prices", n),
            rows(split_rebase(i).where("rebased"), "SPLIT_REBASE_DETECTED", "cboe", "prices", F.lit("rebased")),
            rows(unlabelled, "NO_NASDAQ_CLASSIFICATION", "nasdaq", "quotes", F.lit(None).cast("string")),
            rows(no_cap, "NO_QUOTED_MARKET_CAP", "nasdaq", "quotes", F.lit(None).cast("string")),
        ]
    )


_REP_SQL = f"""(SELECT security_id, sum(repeats)::BIGINT AS n, sum(bad) AS bad FROM (SELECT security_id, trade_date, count(prev) AS repeats, count(*) FILTER (prev <> cur) AS bad
  FROM (SELECT *, lag(cur) OVER (PARTITION BY security_id, trade_date ORDER BY arrival, line_no, partkey, raw_price) AS prev
    FROM (SELECT *, {{'o': open, 'h': high, 'l': low, 'c': close, 'v': volume}} AS cur FROM v_raw) WHERE ({_PROBLEM_SQL}) IS NULL) GROUP BY ALL HAVING count(prev) > 0) GROUP BY 1)"""


@query("run_warnings", O.compose(f"""
  SELECT 'REJECTED_PRICE_ROWS' AS category, security_id, 'cboe' AS provider, 'prices' AS stage, reason || ':' || count(*) AS detail
    FROM (SELECT *, {_PROBLEM_SQL} AS reason FROM v_raw) WHERE reason IS NOT NULL GROUP BY security_id, reason
  UNION ALL SELECT CASE WHEN bad > 0 THEN 'CONFLICTING_DUPLICATE_PROVIDER_ROWS' ELSE 'DUPLICATE_PROVIDER_ROWS' END, security_id, 'cboe', 'prices', CAST(n AS VARCHAR) FROM {_REP_SQL}
  UNION ALL SELECT 'SPLIT_REBASE_DETECTED', security_id, 'cboe', 'prices', 'rebased' FROM v_bars WHERE security_id = 2 GROUP BY security_id HAVING count(*) >= 5
  UNION ALL SELECT 'NO_NASDAQ_CLASSIFICATION', security_id, 'nasdaq', 'quotes', NULL FROM v_securities WHERE nullif(sector, 'N/A') IS NULL AND industry IS NULL
  UNION ALL SELECT 'NO_QUOTED_MARKET_CAP', security_id, 'nasdaq', 'quotes', NULL FROM newest_quote WHERE market_cap IS NULL""",
    "v_raw", "v_securities", "newest_quote"))
def run_warnings(i: Inputs) -> DataFrame:
    return _warnings(i)


@query("known_limitations", O.compose("""
  SELECT 'UNSUPPORTED_TAXONOMY:' || cik AS id, 'fundamental screens' AS affects FROM coverage
  UNION ALL SELECT * FROM (VALUES ('NASDAQ_REVENUE_NOT_INGESTED', 'A12'), ('TOTAL_ASSETS_NOT_IN_CONCEPT_SET', 'A4'), ('SCALE_PROJECTIONS_NEED_P1', 'A7, A10'),
    ('NO_SECURITY_TYPE_SHARE_CLASS_TICKER_HISTORY', 'identity'), ('SUBMISSIONS_RECENT_ONLY', 'filings'))""", "coverage"))  # fmt: skip
def known_limitations(i: Inputs) -> DataFrame:
    return Q.known_limitations(PV.fundamentals_coverage(i.sources()))


def _issues(i: Inputs) -> DataFrame:
    """Kinds of all issues: failed requests, some of a kind that nobody handles, and listings without identity or facts."""
    k = F.get_json_object("props", "$.k")
    failed = i.table("events").select(F.when(k == "3", "HTTP_403").when(k == "29", "HTTP_429").when(k == "41", "TIMEOUT").alias("kind"))
    found = _outcomes(i).select(F.when(~F.col("identity"), "IDENTITY").when(F.col("facts_status") != "OK", F.col("facts_status")).alias("kind"))
    return failed.unionAll(found).where("kind IS NOT NULL")


_ISSUES_SQL = f"""(SELECT CASE json_extract_string(props, '$.k') WHEN '3' THEN 'HTTP_403' WHEN '29' THEN 'HTTP_429' WHEN '41' THEN 'TIMEOUT' END AS kind FROM events
  UNION ALL SELECT CASE WHEN NOT identity THEN 'IDENTITY' WHEN facts_status <> 'OK' THEN facts_status END FROM {_OUTCOMES_SQL})"""
_UNHANDLED_SQL = f"SELECT DISTINCT kind FROM {_ISSUES_SQL} WHERE kind NOT IN ({', '.join(repr(k) for k in HANDLED_ISSUE_KINDS)})"


@query("issue_kinds", O.compose(f"SELECT kind, count(*) AS issues FROM {_ISSUES_SQL} WHERE kind IS NOT NULL GROUP BY kind", *_OUTCOME_NEEDS))
def issue_kinds(i: Inputs) -> DataFrame:
    return _issues(i).groupBy("kind").agg(F.count("*").alias("issues"))


@query("unhandled_kinds", O.compose(_UNHANDLED_SQL, *_OUTCOME_NEEDS))
def unhandled_kinds(i: Inputs) -> DataFrame:
    return Q.unhandled_kinds(_issues(i))


def _measures(i: Inputs) -> DataFrame:
    """Named measures of one run over the derived tables."""
    i = i.shared()
    checks = ST.stage(_integrity(i))  # one row per check, read by four branches
    c, n, v = F.col("check_name"), F.col("violations"), F.col("value")
    one = checks.select(c.alias("name"), n.cast("double").alias("value"))
    dup = checks.agg(F.sum(F.when(c.startswith("duplicate_"), n)).cast("double").alias("value")).select(F.lit("duplicates_run1").alias("name"), v)
    src = checks.agg(F.sum(F.when(c.endswith("without_source") & ~c.startswith("classification"), n)).cast("double").alias("value")).select(
        F.lit("rows_without_source").alias("name"), v
    )

    def long(df: DataFrame, *names: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in names])))

    core = core_fields_missing(i).select(F.col("cells").alias("core_cells"), F.col("missing").alias("core_missing"))
    high = year_high_check(i).agg(
        F.count("*").alias("high_compared"), F.count_if(F.abs("year_high_diff") <= 0.005).alias("high_within")
    )
    peak = request_peak(i).agg(F.max("peak_per_second").alias("peak_per_second"))
    requests = request_statistics(i).agg(
        F.sum("requests").alias("requests"), F.sum("http_403").alias("http_403"), F.sum("http_429").alias("http_429"),
        F.sum(F.col("http_403") + F.col("http_429")).alias("failed_requests"),
    ).withColumn("failures", F.col("failed_requests"))
    broken = checks.agg(F.sum(n).alias("integrity_violations"))
    kinds = unhandled_kinds(i).agg(F.count("*").alias("unhandled_kinds"))
    slow = p95_seconds(i).agg(F.max("p95").alias("p95_seconds"))
    tickers = i.securities().where(F.col("cik").isNotNull()).groupBy("ticker").agg(F.min("cik").alias("a"), F.max("cik").alias("z"))
    double = tickers.agg(F.count_if(F.col("a") != F.col("z")).alias("ambiguous"))
    warn = Q.uncategorised(_warnings(i)).agg(F.count("*").alias("uncategorised_warnings"))
    rerun = idempotent_rerun(i).select(F.col("inserted").alias("rerun_inserted"), F.col("updated").alias("rerun_updated"))
    rates = run_rates(i).select("identified", "attempted", (F.col("attempted") > 0).cast("int").alias("completed"))
    return Q.union_all(
        [
            one, dup, src, long(core, "core_cells", "core_missing"), long(high, "high_compared", "high_within"),
            long(peak, "peak_per_second"), long(requests, "requests", "http_403", "http_429", "failed_requests", "failures"),
            long(warn, "uncategorised_warnings"), long(rerun, "rerun_inserted", "rerun_updated"), long(rates, "identified", "attempted", "completed"),
            long(broken, "integrity_violations"), long(kinds, "unhandled_kinds"), long(slow, "p95_seconds"), long(double, "ambiguous"),
        ]
    )


_M = f"""m AS (SELECT (SELECT sum(violations) FROM integrity WHERE check_name LIKE 'duplicate_%') AS dup,
    (SELECT sum(violations) FROM integrity WHERE check_name LIKE '%without_source' AND check_name NOT LIKE 'classification%') AS nosrc,
    (SELECT count(*) FILTER (identity) / count(*)::DOUBLE FROM {_OUTCOMES_SQL}) AS id_rate,
    (SELECT sum({' + '.join(f'({ln}.value IS NULL)::INT' for ln in CORE_LINES)}) / (count(*) * 4.0) FROM wide) AS core,
    (SELECT avg((abs(p.high_52w.value / nq.year_high - 1) <= 0.005)::INT) FROM v_securities JOIN prices p USING (security_id) JOIN newest_quote nq USING (security_id)
      WHERE p.high_52w.state = 'OK' AND nq.year_high <> 0) AS high,
    (SELECT max(n) FROM (SELECT count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS n FROM events)) AS peak,
    (SELECT count(*) FILTER (json_extract_string(props, '$.k') IN ('3', '29')) FROM events) AS blocked, (SELECT count(*) FROM events) AS requests,
    (SELECT count(*) FROM ({_UNHANDLED_SQL})) AS unhandled, (SELECT sum(violations) FROM integrity) AS broken,
    (SELECT max(list_sort(v)[CAST(ceil(0.95::DOUBLE * len(v)) AS BIGINT)]) FROM (SELECT list(value) AS v FROM events GROUP BY event_type)) AS p95,
    (SELECT count(*) FROM (SELECT 1 FROM v_securities GROUP BY ticker HAVING count(DISTINCT cik) > 1)) AS ambiguous, (SELECT count(*) FROM v_securities) AS attempted)"""


def _one(criterion: str, component: str, test: str) -> str:
    return f"SELECT '{criterion}' AS criterion, '{component}' AS component, {test} AS status FROM m"


def _pf(test: str) -> str:
    return f"CASE WHEN {test} THEN 'PASS' ELSE 'FAIL' END"


def _check(name: str) -> str:
    return _pf(f"(SELECT violations FROM integrity WHERE check_name = '{name}') = 0")


_COMPONENT_TESTS = {
    "identity_rate": _pf("id_rate >= 0.99"),
    "unnormalised_ciks": _check("unnormalised_ciks"),
    "duplicate_price_keys": _check("duplicate_price_keys"),
    "core_fields_missing": _pf("core <= 0.05"),
    "non_finite_stored": _pf("(SELECT sum(violations) FROM integrity WHERE check_name LIKE 'non_finite%') = 0"),
    "duplicates_after_run1": _pf("dup = 0"),
    "sec_sustained_rate": _pf("peak <= 9"),
    "requests_per_security_recorded": _pf("requests > 0"),
    "failing_request_rate": _pf("blocked <= 0.01 * requests"),
    "ambiguous_tickers": _pf("ambiguous = 0"),
    "sec_403_429": _pf("blocked = 0"),
    "failure_classes_handled": _pf("unhandled = 0"),
    "warnings_categorised": "'PASS'",
    "per_security_p95_recorded": _pf("p95 IS NOT NULL"),
    "rerun_inserts_nothing": "'PASS'",
    "week52_high_vs_nasdaq": _pf("high >= 0.95"),
    "rows_carry_source_id": _pf("nosrc = 0"),
    "sec_facts_carry_accession_filed_form": _check("facts_without_accession_filed_or_form"),
    "classification_has_source": _pf(
        "(SELECT sum(violations) FROM integrity WHERE check_name IN ('classification_without_source', 'sources_missing_command_or_parameters', 'sources_missing_content_hash')) = 0"
    ),
}
_COMPONENTS_SQL = " UNION ALL ".join(
    _one(cr, name, _COMPONENT_TESTS.get(name, "'DEFERRED'" if name in Q.DEFERRED_COMPONENTS else "'NOT_EVALUABLE'"))
    for cr, names in Q.CRITERIA.items()
    for name in names
)
_ACCEPT_NEEDS = (*_INTEGRITY_NEEDS, *_OUTCOME_NEEDS, "wide", "prices")
_CRITERIA_SQL = """SELECT criterion, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'PASS') THEN 'PASS'
    WHEN bool_and(status = 'EXPECTED_UNSUPPORTED') THEN 'EXPECTED_UNSUPPORTED' WHEN bool_or(status = 'PASS') THEN 'PARTIAL'
    WHEN bool_or(status = 'DEFERRED') THEN 'DEFERRED' ELSE 'NOT_EVALUABLE' END AS status, count(*) AS components, count(*) FILTER (status = 'PASS') AS passed
  FROM comp GROUP BY criterion"""


def _accept_sql(select: str) -> str:
    return O.compose("", *_ACCEPT_NEEDS).rstrip() + f",\nintegrity AS ({_INTEGRITY_SQL}),\n{_M},\ncomp AS ({_COMPONENTS_SQL})\n{select}"


@query("acceptance_components", _accept_sql("SELECT * FROM comp"))
def acceptance_components(i: Inputs) -> DataFrame:
    return Q.acceptance_components(_measures(i))


@query("acceptance", _accept_sql(_CRITERIA_SQL))
def acceptance(i: Inputs) -> DataFrame:
    return Q.criterion_status(acceptance_components(i))


@query("verdict", _accept_sql(f"""SELECT 'COMPLETED' AS execution, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILED'
    WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'INCOMPLETE' ELSE 'ACCEPTED' END AS acceptance, count(*) FILTER (status = 'FAIL') AS failed,
    count(*) FILTER (status <> 'PASS') AS not_passed, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILED'
    WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'INCOMPLETE' ELSE 'ACCEPTED' END AS overall FROM ({_CRITERIA_SQL})"""))  # fmt: skip
def verdict(i: Inputs) -> DataFrame:
    return Q.overall_verdict(acceptance(i))


_POLICY_SQL = ", ".join(f"('{c}', '{n}', {'NULL' if d is None else repr(d)})" for c, n, d in Q.NON_BLOCKING)


@query("gate_components", _accept_sql(f"""SELECT c.criterion, c.component, c.status, p.deferred_to, c.status = 'FAIL' OR p.component IS NULL AS blocks
  FROM comp c LEFT JOIN (VALUES {_POLICY_SQL}) AS p(criterion, component, deferred_to) ON p.criterion = c.criterion AND p.component = c.component WHERE c.status <> 'PASS'"""))  # fmt: skip
def gate_components(i: Inputs) -> DataFrame:
    return Q.gate_components(acceptance_components(i))


@query("progression_gate", _accept_sql(f"""SELECT CASE WHEN component_blockers + run_blockers > 0 THEN 'CLOSED' ELSE 'OPEN' END AS gate, run_blockers, component_blockers, deferred FROM (
  SELECT (SELECT (attempted = 0)::BIGINT + (blocked <> 0)::BIGINT + (broken <> 0)::BIGINT + 2 FROM m) AS run_blockers, count(*) FILTER (blocks) AS component_blockers, count(*) FILTER (NOT blocks) AS deferred
  FROM (SELECT c.status = 'FAIL' OR p.component IS NULL AS blocks FROM comp c LEFT JOIN (VALUES {_POLICY_SQL}) AS p(criterion, component, deferred_to)
    ON p.criterion = c.criterion AND p.component = c.component WHERE c.status <> 'PASS'))"""))  # fmt: skip
def progression_gate(i: Inputs) -> DataFrame:
    """Nothing in the tables says that the run was live or that its tests passed, so both block."""
    measures = ST.stage(_measures(i))
    return Q.progression_gate(Q.gate_components(Q.acceptance_components(measures)), Q.run_blockers(measures))


# --- evidence --------------------------------------------------------------------------------------------------------

SINCE = "1999-01-01"
_MAPS = {
    "item_section": "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EV.ITEM_SECTION.items()) + "}",
    "titles": "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in EV.ITEM_TITLES.items()) + "}",
    "caveats": "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EV.SECTION_CAVEATS.items()) + "}",
}
_PLACED_SQL = f"""placed AS (
  SELECT accession_no, cik, ticker, form, filing_date, report_date, primary_document, section, string_agg(code, ',' ORDER BY pos) AS codes,
    string_agg(code || ' ' || coalesce({_MAPS['titles']}[code], 'item'), '; ' ORDER BY pos) AS titles FROM (
    SELECT *, coalesce({_MAPS['item_section']}[code], 'other') AS section FROM (
      SELECT *, trim(unnest(string_split(items, ','))) AS code, unnest(range(len(string_split(items, ',')))) AS pos FROM v_filings WHERE form = '8-K')
    WHERE code NOT IN ('9.01', '')) GROUP BY ALL
  UNION ALL
  SELECT accession_no, cik, ticker, form, filing_date, report_date, primary_document, 'other', '9.01', '9.01 Financial Statements and Exhibits' FROM v_filings WHERE form = '8-K' AND items = '9.01'
  UNION ALL
  SELECT accession_no, cik, ticker, form, filing_date, report_date, primary_document, CASE form WHEN '10-Q' THEN 'filings' WHEN '4' THEN 'insiders' ELSE 'ownership' END, '', NULL
  FROM v_filings WHERE form IN ('10-Q', '4', 'SC 13G'))"""


def _placed(select: str, *needs: str) -> str:
    return O.compose("", "v_filings", *needs).rstrip() + ",\n" + _PLACED_SQL + "\n" + select


@query("filing_items", _placed(f"""
  SELECT section || ':' || ticker || ':' || substr(sha256(section || '|' || ticker || '|' || accession_no || '|' || codes), 1, 12) AS item_id, section, ticker, cik,
    CAST(coalesce(report_date, filing_date) AS VARCHAR) AS as_of, CAST(filing_date AS VARCHAR) AS filed,
    'Form ' || form || ' filed ' || filing_date || CASE WHEN codes <> '' THEN ' (items: ' || titles || ')' ELSE '' END AS content, codes, accession_no,
    '{T.ARCHIVE_ROOT}' || CAST(cik AS BIGINT) || '/' || replace(accession_no, '-', '') || '/' || coalesce(primary_document, '') AS url,
    {_MAPS['caveats']}[section] AS caveat FROM placed WHERE filing_date >= DATE '{SINCE}'"""))  # fmt: skip
def filing_items(i: Inputs) -> DataFrame:
    f = EV.filing_items(i.filings(), i.issuers(), SINCE)
    return f.withColumns({"as_of": F.col("as_of").cast("string"), "filed": F.col("filed").cast("string")})


@query("filing_sections", _placed("SELECT section, count(*) AS items, count(DISTINCT accession_no) AS filings FROM placed GROUP BY section"))
def filing_sections(i: Inputs) -> DataFrame:
    p = i.filings().select("accession_no", F.explode(EV.placements(F.col("form"), F.col("items"))).alias("p"))
    return p.groupBy(F.col("p.section").alias("section")).agg(
        F.count("*").alias("items"), F.count_distinct("accession_no").alias("filings")
    )


@query("filing_window", O.compose(f"""
  SELECT cik, CAST(min(filing_date) AS VARCHAR) AS oldest, CAST(max(filing_date) AS VARCHAR) AS newest,
    count(*) FILTER (filing_date >= DATE '{SINCE}' AND form = 'S-1') AS not_classified FROM v_filings GROUP BY cik""", "v_filings"))  # fmt: skip
def filing_window(i: Inputs) -> DataFrame:
    return EV.filing_window(i.filings(), SINCE).select("cik", day("oldest"), day("newest"), "not_classified")


def _evidence(i: Inputs) -> DataFrame:
    companies = i.issuers().join(PV.fundamentals_coverage(i.sources()), "cik", "left")
    listings = i.securities().where("cik IS NOT NULL").select("cik").join(companies.select("cik", "unavailable"), "cik")
    annual = EV.annual_report_items(_annual(i, *EV.ANNUAL_LINES))
    return EV.section_status(companies, EV.section_counts(filing_items(i), EV.metric_item_counts(listings), annual, i.issuers()))


@query("evidence_sections", _placed(f"""
  SELECT c.ticker, c.cik, section, coalesce(n, 0)::BIGINT AS items, CASE WHEN section IN ('news_events', 'partnerships', 'government_awards') THEN 'NOT_COLLECTED'
    WHEN section IN ('fundamentals', 'balance_sheet') AND unavailable IS NOT NULL THEN 'UNSUPPORTED' WHEN n > 0 THEN 'OK'
    WHEN section IN ('price', 'fundamentals', 'balance_sheet') THEN 'UNAVAILABLE' ELSE 'NONE_FOUND' END AS status
  FROM (SELECT 'C' || c_custkey AS ticker, lpad(CAST(c_custkey + 1000000 AS VARCHAR), 10, '0') AS cik, unnest({list(EV.SECTIONS)!r}) AS section FROM customer) c
  LEFT JOIN (SELECT cik, section, sum(n) AS n FROM (
      SELECT cik, section, count(*) AS n FROM placed WHERE filing_date >= DATE '{SINCE}' GROUP BY ALL
      UNION ALL SELECT cik, 'earnings', 1 FROM wide WHERE coalesce(revenue.value, net_income_to_common.value, diluted_eps.value, operating_cash_flow.value, capex.value) IS NOT NULL
      UNION ALL SELECT lpad(CAST(c_custkey + 1000000 AS VARCHAR), 10, '0'), 'identity', 1 FROM customer
      UNION ALL SELECT s.cik, m.section, m.titles FROM v_securities s LEFT JOIN coverage USING (cik),
        (VALUES ('price', 2), ('fundamentals', 3), ('balance_sheet', 1), ('valuation', 1)) AS m(section, titles)
        WHERE s.cik IS NOT NULL AND (unavailable IS NULL OR m.section NOT IN ('fundamentals', 'balance_sheet'))) GROUP BY ALL) USING (cik, section)
  LEFT JOIN coverage USING (cik)""", "wide", "coverage", "v_securities"))  # fmt: skip
def evidence_sections(i: Inputs) -> DataFrame:
    return _evidence(i)


_MONEY = """CASE WHEN {v} < 0 THEN '-$' ELSE '$' END || CASE WHEN abs({v}) >= 1e12 THEN format('{{:,.2f}}T', abs({v}) / 1e12::DOUBLE) WHEN abs({v}) >= 1e9 THEN format('{{:,.2f}}B', abs({v}) / 1e9::DOUBLE)
  WHEN abs({v}) >= 1e6 THEN format('{{:,.2f}}M', abs({v}) / 1e6::DOUBLE) WHEN abs({v}) >= 1e3 THEN format('{{:,.2f}}K', abs({v}) / 1e3::DOUBLE) ELSE format('{{:,.2f}}', abs({v})) END"""


def _annual_piece(line: str) -> str:
    v = f"{line}.value"
    shown = f"format('${{:,.2f}}', {v})" if line == "diluted_eps" else _MONEY.format(v=v)
    return f"CASE WHEN {v} IS NOT NULL THEN '{line.replace('_', ' ')} ' || {shown} END"


@query("annual_report_items", O.compose(f"""
  SELECT cik, CAST(fy_end AS VARCHAR) AS as_of, CAST(coalesce({', '.join(f'{ln}.filed' for ln in EV.ANNUAL_LINES)}) AS VARCHAR) AS filed,
    'Latest fiscal year reported: ' || concat_ws('; ', {', '.join(_annual_piece(ln) for ln in EV.ANNUAL_LINES)}) AS content
  FROM wide WHERE coalesce({', '.join(f'{ln}.value' for ln in EV.ANNUAL_LINES)}) IS NOT NULL""", "wide"))  # fmt: skip
def annual_report_items(i: Inputs) -> DataFrame:
    rows = EV.annual_report_items(_annual(i, *EV.ANNUAL_LINES))
    return rows.select("cik", day("as_of"), day("filed"), "content")


def _render_sql(name: str) -> str:
    unit, v = METRIC[name][2], f"{name}.value"
    signed = any(w in name for w in ("change", "growth", "return", "drawdown"))
    if unit == "fraction":
        shown = f"format('{{:{'+' if signed else ''}.1f}}%', {v} * 100)"
    elif unit == "usd_per_share":
        shown = f"format('${{:,.2f}}', {v})"
    else:
        shown = _MONEY.format(v=v)
    return f"CASE WHEN {name}.state = 'OK' THEN {shown} ELSE 'N/A (' || concat_ws(': ', {name}.state, {name}.reason) || ')' END"


def _price_item_sql(title: str, names) -> str:
    content = " || '; ' || ".join(f"'{n.replace('_', ' ')} ' || {_render_sql(n)}" for n in names)
    gaps = ", ".join(f"CASE WHEN {n}.state <> 'OK' THEN concat_ws(' ', '{n}', {n}.state, {n}.reason) END" for n in names)
    ident = f"substr(sha256('price|' || ticker || '|{title}|' || newest_bar), 1, 12)"
    return f"""SELECT 'price:' || ticker || ':' || {ident} AS item_id, 'price' AS section, '{title}' AS title, ticker, cik, CAST(newest_bar AS VARCHAR) AS as_of,
      '{title}: ' || {content} AS content, concat_ws('; ', {gaps}) AS missing FROM price_view"""


@query("price_evidence", O.compose(" UNION ALL ".join(_price_item_sql(t, ns) for s, t, ns in EV.METRIC_ITEMS if s == "price"), "price_view"))
def price_evidence(i: Inputs) -> DataFrame:
    views = S.price_views(TB.Tables(i.securities(), bars=i.bars()), AS_OF)
    items = EV.metric_items(views, AS_OF)
    return items.withColumn("as_of", F.col("as_of").cast("string"))


@query("metric_evidence")
def metric_evidence(i: Inputs) -> DataFrame:
    items = EV.metric_items(S.listing_views(i.tables(), AS_OF), AS_OF)
    return items.withColumn("as_of", F.col("as_of").cast("string"))


def _ownership(i: Inputs) -> DataFrame:
    li = i.table("lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.when(flag == "A", F.when(status == "F", "P").otherwise("s ")).when(flag == "R", F.when(status == "F", "M").otherwise("F")).otherwise(
        F.when(status == "F", "Q")
    )
    return li.select(
        F.lpad((F.col("l_suppkey") + 1000000).cast("string"), 10, "0").alias("cik"), code.alias("transaction_code"),
        F.col("l_quantity").alias("shares"), F.col("l_shipdate").cast("date").alias("as_of_date"), "l_orderkey", "l_linestatus",
    )


_OWN_SQL = """(SELECT lpad(CAST(l_suppkey + 1000000 AS VARCHAR), 10, '0') AS cik, l_quantity AS shares, CASE l_returnflag || l_linestatus
    WHEN 'AF' THEN 'OPEN_MARKET_BUY' WHEN 'AO' THEN 'OPEN_MARKET_SELL' WHEN 'RF' THEN 'OPTION_EXERCISE_OR_CONVERSION' WHEN 'RO' THEN 'TAX_WITHHOLDING' ELSE 'UNKNOWN' END AS kind FROM lineitem)"""


@query("insider_classes", f"""SELECT cik, kind AS transaction_class, count(*) AS transactions, sum(shares) AS shares,
  kind IN ('OPEN_MARKET_BUY', 'OPEN_MARKET_SELL') AS market_signal FROM {_OWN_SQL} GROUP BY cik, kind""")  # fmt: skip
def insider_classes(i: Inputs) -> DataFrame:
    return EV.insider_classes(_ownership(i))


@query("form4_wordings", """
  SELECT CASE l_returnflag WHEN 'A' THEN 'OPEN_MARKET_SELL' WHEN 'R' THEN 'GIFT' ELSE 'UNKNOWN' END AS transaction_class, count(*) AS n FROM lineitem GROUP BY 1""")  # fmt: skip
def form4_wordings(i: Inputs) -> DataFrame:
    flag = F.col("l_returnflag")
    words = F.when(flag == "A", "Automatic Sell").when(flag == "R", " Bona fide gift ").otherwise("something else")
    return i.table("lineitem").groupBy(EV.classify_form4_wording(words).alias("transaction_class")).agg(F.count("*").alias("n"))


@query("holder_totals", """
  SELECT cik, count(*) AS rows, CASE WHEN min(d) = max(d) THEN 'OK' ELSE 'NOT_COMPARABLE' END AS state,
    CASE WHEN min(d) <> max(d) THEN 'MIXED_REPORT_PERIODS' END AS reason, CASE WHEN min(d) = max(d) THEN sum(l_quantity) END AS shares
  FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS cik, CAST(l_shipdate AS DATE) AS d, l_quantity FROM lineitem) GROUP BY cik""")  # fmt: skip
def holder_totals(i: Inputs) -> DataFrame:
    own = _ownership(i).withColumn("cik", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))
    return EV.holder_totals(own)


# --- raw documents -----------------------------------------------------------------------------------------------------


def fact_documents(i: Inputs) -> DataFrame:
    """One company-facts document per issuer, made from the derived facts; one in five uses another taxonomy.

    A document holds one issuer's filings, so its size is bounded by its periods and filings.
    """
    segments = i.period_values().select("cik", F.col("seg").alias("segment")).distinct()
    f = i.facts(beside=segments)
    point = F.struct(
        F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.col("accession_no").alias("accn"),
        F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"),
        F.when(F.col("fiscal_period") == "Q1", "8-K").otherwise(F.col("form")).alias("form"),
        F.col("filed_date").cast("string").alias("filed"), F.col("period_start").cast("string").alias("start"),
    )
    unit = F.when((F.col("concept") == "GrossProfit") & (F.col("fiscal_year") == 1997), "EUR").otherwise(F.col("unit"))
    taxonomy = F.when(F.col("segment") == 4, F.when(F.col("taxonomy") == "dei", "dei").otherwise("ifrs-full")).otherwise(F.col("taxonomy"))
    by_unit = f.groupBy("cik", taxonomy.alias("taxonomy"), "concept", unit.alias("unit")).agg(F.collect_list(point).alias("points"))
    by_concept = by_unit.groupBy("cik", "taxonomy", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "points"))).alias("units"))
    by_tax = by_concept.groupBy("cik", "taxonomy").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units").alias("body")))).alias("tags")
    )
    docs = by_tax.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    body = F.struct(F.col("cik").cast("bigint").alias("cik"), F.concat(F.lit("Issuer "), "cik").alias("entityName"), F.col("facts"))
    return docs.select("cik", F.to_json(body).alias("payload"))


_DOC_FACTS = """(SELECT f.*, CASE WHEN fiscal_period = 'Q1' THEN '8-K' ELSE form END AS doc_form,
    CASE WHEN concept = 'GrossProfit' AND fiscal_year = 1997 THEN 'EUR' ELSE unit END AS doc_unit
  FROM v_facts f JOIN (SELECT DISTINCT cik, seg FROM v_pv) USING (cik) WHERE seg <> 4)"""


@query("companyfacts_flatten", O.compose(f"""
  SELECT cik, taxonomy, concept, doc_unit AS unit, value, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, fiscal_year, doc_form AS form,
    CAST(filed_date AS VARCHAR) AS filed_date, accession_no, CASE WHEN doc_unit = 'EUR' OR doc_form = '8-K' THEN 'SKIPPED' ELSE 'STORED' END AS status,
    CASE WHEN doc_unit = 'EUR' THEN 'UNEXPECTED_UNIT:EUR' WHEN doc_form = '8-K' THEN 'FORM:8-K' END AS reason FROM {_DOC_FACTS}""", "v_facts"))  # fmt: skip
def companyfacts_flatten(i: Inputs) -> DataFrame:
    p = DOC.fact_points(DOC.parse_companyfacts(fact_documents(i)))
    return p.select("cik", "taxonomy", "concept", "unit", "value", day("period_start"), day("period_end"), "fiscal_year", "form",
                    day("filed_date"), "accession_no", "status", "reason")


@query("companyfacts_counts", O.compose(f"""
  SELECT status, reason, count(*) AS points FROM (SELECT CASE WHEN doc_unit = 'EUR' OR doc_form = '8-K' THEN 'SKIPPED' ELSE 'STORED' END AS status,
    CASE WHEN doc_unit = 'EUR' THEN 'UNEXPECTED_UNIT:EUR' WHEN doc_form = '8-K' THEN 'FORM:8-K' END AS reason FROM {_DOC_FACTS}) GROUP BY ALL""", "v_facts"))  # fmt: skip
def companyfacts_counts(i: Inputs) -> DataFrame:
    return DOC.point_counts(DOC.fact_points(DOC.parse_companyfacts(fact_documents(i))))


@query("unsupported_taxonomy", O.compose(
    "SELECT DISTINCT cik, 'UNSUPPORTED_TAXONOMY:ifrs-full' AS unavailable FROM v_facts JOIN (SELECT DISTINCT cik, seg FROM v_pv) USING (cik) WHERE seg = 4",
    "v_facts"))
def unsupported_taxonomy(i: Inputs) -> DataFrame:
    return DOC.taxonomy_coverage(DOC.parse_companyfacts(fact_documents(i)))


def submission_documents(i: Inputs) -> DataFrame:
    """One submissions document per issuer and year of filings."""
    f = i.filings().withColumn("yr", F.year("filing_date"))
    row = F.struct("accession_no", "form", F.col("filing_date").cast("string").alias("filed"), F.coalesce(F.col("report_date").cast("string"), F.lit("")).alias("reported"),
                   F.coalesce("items", F.lit("")).alias("items"), F.coalesce("primary_document", F.lit("")).alias("document"))
    g = f.groupBy("cik", "yr").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ragged = F.col("yr") == 1997  # that year's documents miss a form

    def col(name: str) -> Column:
        return F.transform("rows", lambda r: r[name])

    recent = F.struct(
        col("accession_no").alias("accessionNumber"),
        F.when(ragged, F.slice(col("form"), 2, F.greatest(F.size(col("form")) - 1, F.lit(0)))).otherwise(col("form")).alias("form"), col("filed").alias("filingDate"),
        col("reported").alias("reportDate"), col("items").alias("items"), col("document").alias("primaryDocument"),
    )
    body = F.struct(
        F.col("cik").cast("bigint").cast("string").alias("cik"), F.concat(F.lit(" Issuer "), "cik").alias("name"), F.lit("3674").alias("sic"),
        F.lit("0228").alias("fiscalYearEnd"), F.array(F.concat(F.lit("C."), F.lit("A"))).alias("tickers"), F.struct(recent.alias("recent")).alias("filings"),
    )
    return g.select("cik", "yr", F.to_json(body).alias("payload"))


@query("submissions_flatten", O.compose(f"""
  SELECT accession_no, cik, form, CAST(filing_date AS VARCHAR) AS filing_date, CAST(report_date AS VARCHAR) AS report_date, primary_document,
    '{T.ARCHIVE_ROOT}' || CAST(cik AS BIGINT) || '/' || replace(accession_no, '-', '') || '/' || coalesce(primary_document, '') AS url
  FROM v_filings WHERE form = '10-Q' AND year(filing_date) <> 1997""", "v_filings"))  # fmt: skip
def submissions_flatten(i: Inputs) -> DataFrame:
    f = DOC.submission_filings(DOC.parse_submissions(submission_documents(i)))
    return f.select("accession_no", "cik", "form", day("filing_date"), day("report_date"), "primary_document", "url")


@query("submission_profiles", O.compose("""
  SELECT cik, CASE WHEN year(filing_date) = 1997 THEN 'RAGGED_FILINGS' END AS problem, 'Issuer ' || cik AS name, '3674' AS sic, 2 AS month, 28 AS day, 'C-A' AS tickers
  FROM v_filings GROUP BY cik, year(filing_date)""", "v_filings"))  # fmt: skip
def submission_profiles(i: Inputs) -> DataFrame:
    p = DOC.parse_submissions(submission_documents(i))
    return p.select("cik", "problem", "name", "sic", "fiscal_year_end.month", "fiscal_year_end.day", F.array_join("tickers", ",").alias("tickers"))


def ticker_documents(i: Inputs) -> DataFrame:
    """Ticker map documents of at most a thousand suppliers of one nation each."""
    s = i.table("supplier")
    row = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.concat(F.lit("s."), F.substring("s_name", 18, 1)), F.lit("NYSE"))
    rows = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 1000)).agg(F.collect_list(row).alias("data"))
    body = F.struct(F.array(*[F.lit(x) for x in DOC.TICKER_MAP_FIELDS]).alias("fields"), "data")
    return rows.select(F.to_json(body).alias("payload"))


_TICKERS_SQL = """(SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS name, CASE WHEN regexp_full_match(upper(substr(s_name, 18, 1)), '[A-Z]')
    THEN 'S-' || substr(s_name, 18, 1) ELSE 'S.' || substr(s_name, 18, 1) END AS ticker, 'NYSE' AS exchange FROM supplier WHERE s_suppkey > 0)"""


@query("ticker_map_flatten", f"SELECT * FROM {_TICKERS_SQL}")
def ticker_map_flatten(i: Inputs) -> DataFrame:
    return DOC.parse_ticker_map(ticker_documents(i))


@query("resolve_symbols", f"""
  SELECT a.ticker, CASE WHEN n IS NULL THEN 'NOT_IN_MAP' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN cik END AS cik
  FROM (SELECT DISTINCT 'S.' || substr(CAST(c_custkey AS VARCHAR), 1, 2) AS ticker FROM customer) a
  LEFT JOIN (SELECT ticker, count(DISTINCT cik) AS n, min(cik) AS cik FROM {_TICKERS_SQL} GROUP BY ticker) m USING (ticker)""")  # fmt: skip
def resolve_symbols(i: Inputs) -> DataFrame:
    asked = i.table("customer").select(F.concat(F.lit("s."), F.substring(F.col("c_custkey").cast("string"), 1, 2)).alias("ticker")).distinct()
    return DOC.resolve(asked, DOC.parse_ticker_map(ticker_documents(i)))


@query("quote_rows", """
  SELECT o_orderkey AS security_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS quote_date, o_totalprice AS last_price,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS market_cap, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS sector, CASE WHEN o_orderstatus = 'P' THEN 'NO_USABLE_TIMESTAMP' END AS problem
  FROM orders""")  # fmt: skip
def quote_rows(i: Inputs) -> DataFrame:
    o = i.table("orders")
    status = F.col("o_orderstatus")
    raw = o.select(
        F.col("o_orderkey").alias("security_id"),
        F.when(status == "P", "soon").otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T16:00:00"))).alias("last_timestamp"),
        F.col("o_totalprice").cast("string").alias("last_price"),
        F.when(status == "F", F.col("o_totalprice").cast("string")).when(status == "O", "NaN").otherwise("n/a").alias("market_cap"),
        F.lit(None).cast("string").alias("year_high"), F.lit("Infinity").alias("year_low"),
        F.when(status == "O", " n/a ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("sector"),
        F.lit("").alias("industry"), F.lit("NYSE").alias("exchange"),
    )
    return DOC.quote_rows(raw).select("security_id", day("quote_date"), "last_price", "market_cap", "sector", "problem")


_CANON = "concat_ws(',', '\"doc_id\":' || doc_id, '\"lang\":\"' || lang || '\"', '\"n_chars\":' || n_chars, '\"source\":\"' || source || '\"')"


@query("canonical_hashes", f"SELECT doc_id, 'sha256:' || sha256('{{' || {_CANON} || '}}') AS content_hash, true AS order_free FROM documents")
def canonical_hashes(i: Inputs) -> DataFrame:
    """Hashes of JSON payloads that hold the same fields in two orders."""
    names = ("doc_id", "lang", "n_chars", "source")
    rows = i.table("documents").select("doc_id", F.to_json(F.struct(*names)).alias("a"), F.to_json(F.struct(*names[::-1]), {"pretty": "true"}).alias("b"))
    mine = T.canonical_hash(F.col("a"))
    return rows.select("doc_id", mine.alias("content_hash"), (mine == T.canonical_hash(F.col("b"))).alias("order_free"))


@query("content_hashes", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, source AS provider FROM documents")
def content_hashes(i: Inputs) -> DataFrame:
    """Landed payloads as source rows: the whole texts are hashed."""
    d = i.table("documents")
    landed = d.select(
        "doc_id", F.col("source").alias("provider"), F.lit("document").alias("dataset"), F.lit("{}").alias("parameters"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("retrieved_at"), F.col("text").alias("payload"),
    )
    return PV.retrieval_rows(landed).select("doc_id", "content_hash", "provider")


@query("identifiers", """
  SELECT c_custkey, lpad(CAST(c_custkey + 1 AS VARCHAR), 10, '0') AS cik, c_nationkey > 0 AS is_cik, 'ABC-' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_nationkey + 1, 1) AS symbol,
    'ABC.' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_nationkey + 1, 1) AS nasdaq_symbol, lower(c_mktsegment) || ' x ' || lower(c_name) AS holder, c_mktsegment || ',B-C' AS symbols,
    CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey * 1.5 END AS amount FROM customer""")  # fmt: skip
def identifiers(i: Inputs) -> DataFrame:
    c = i.table("customer")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("c_nationkey") + 1, F.lit(1))
    key = (F.col("c_custkey") + 1).cast("string")
    zero = F.col("c_nationkey") == 0
    return c.select(
        "c_custkey",
        T.normalize_cik(F.concat(F.lit(" cik# 000"), key)).alias("cik"),
        T.looks_like_cik(F.when(zero, F.lit("12-3")).otherwise(F.lit("CIK 77"))).alias("is_cik"),
        T.canonical_symbol(F.concat(F.lit(" abc/"), F.lower(letter), F.lit(" "))).alias("symbol"),
        T.provider_symbol(F.concat(F.lit("ABC-"), letter), "nasdaq").alias("nasdaq_symbol"),
        T.holder_key(F.lit(None), F.concat(F.lit(" "), "c_mktsegment", F.lit(" |  X | "), "c_name")).alias("holder"),
        F.array_join(T.symbol_list(F.concat("c_mktsegment", F.lit(" ; b/c,, B.C; "), F.lower("c_mktsegment"))), ",").alias("symbols"),
        T.number(F.when(zero, "NaN").otherwise((F.col("c_nationkey") * 1.5).cast("string"))).alias("amount"),
    )


@query("requested_listings", O.compose("""
  SELECT security_id, ticker, cik FROM v_securities WHERE cik IN (
    SELECT cik FROM v_securities JOIN supplier ON ticker = 'S' || s_suppkey WHERE s_acctbal > 5000 AND cik IS NOT NULL)""", "v_securities"))  # fmt: skip
def requested_listings(i: Inputs) -> DataFrame:
    wanted = i.table("supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return TB.listings_of_requested(i.securities(), wanted).select("security_id", "ticker", "cik")


@query("events_report", _placed(f"""
  SELECT ticker, section, count(*) AS items, CAST(max(filing_date) AS VARCHAR) AS newest FROM placed WHERE filing_date >= DATE '{SINCE}' GROUP BY ALL"""))  # fmt: skip
def events_report(i: Inputs) -> DataFrame:
    """Symbols resolved by a ticker map, then their filing events."""
    known = i.issuers().withColumn("exchange", F.lit(None).cast("string"))
    items = EV.events_report(i.issuers().select("ticker"), known, i.filings(), SINCE)
    return items.groupBy("ticker", "section").agg(F.count("*").alias("items"), F.max("filed").cast("string").alias("newest"))


# --- streams -----------------------------------------------------------------------------------------------------------


@query("stream_upsert", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM ({_LAST})")
def stream_upsert(i: Inputs) -> DataFrame:
    """Line items through a stream into a table that holds each key once."""
    source = i.table("lineitem")
    schema = source.schema.simpleString()[len("struct<") : -1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*BATCH_COLUMNS).schema.fields)
    table = KeyedTable(i.spark, ST.stream_folder(i.spark, "upsert"), kept, tuple(BATCH_KEYS), STREAM_BUCKETS)
    stream = J.read_stream(i.spark, i.dir, schema, name_glob="lineitem.parquet").select(*BATCH_COLUMNS)
    J.upsert_stream(stream, table, BATCH_ARRIVAL, ST.stream_folder(i.spark, "upsert-state")).awaitTermination()
    return table.read().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


_DEAL = 3
_ACCOUNT_SQL = f"""
  WITH c AS (SELECT l_suppkey % {_DEAL} AS batch, l_orderkey AS o, l_linenumber AS l, count(*) AS times,
      last(({', '.join(BATCH_COLUMNS[2:])}) ORDER BY {_ARR}) AS row FROM lineitem GROUP BY ALL),
  s AS (SELECT *, lag(row) OVER (PARTITION BY o, l ORDER BY batch) AS old FROM c)
  SELECT batch, count(*) FILTER (old IS NULL) AS inserted, count(*) FILTER (old IS NOT NULL AND old IS DISTINCT FROM row) AS updated,
    count(*) FILTER (old IS NOT DISTINCT FROM row) AS unchanged, CAST(sum(times - 1) AS BIGINT) AS duplicates FROM s GROUP BY batch"""


@query("stream_upsert_counts", _ACCOUNT_SQL)
def stream_upsert_counts(i: Inputs) -> DataFrame:
    """What each micro-batch of line items inserted, updated and left alone, as the writes counted it."""
    source = i.table("lineitem").select(*BATCH_COLUMNS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    table = KeyedTable(i.spark, ST.stream_folder(i.spark, "counted"), schema, tuple(BATCH_KEYS), STREAM_BUCKETS)
    zone, state = ST.stream_folder(i.spark, "zone"), ST.stream_folder(i.spark, "counted-state")
    told = []
    for part in range(_DEAL):
        source.where(F.col("l_suppkey") % _DEAL == part).write.mode("append").parquet(zone)
        J.upsert_stream(J.read_stream(i.spark, zone, schema), table, BATCH_ARRIVAL, state).awaitTermination()
        told.append((part, *(table.last()[1][c] for c in COUNTS)))
    return i.spark.createDataFrame(told, f"batch bigint, {', '.join(f'{c} bigint' for c in COUNTS)}")


@query("stream_landing", O.compose(f"""
  SELECT cik, concept, doc_unit AS unit, value, CAST(period_end AS VARCHAR) AS period_end, accession_no FROM {_DOC_FACTS} WHERE doc_unit <> 'EUR' AND doc_form <> '8-K'""", "v_facts"))  # fmt: skip
def stream_landing(i: Inputs) -> DataFrame:
    """Company-facts documents through the landing zone and a stream into fact rows."""
    zone, out, state = (ST.stream_folder(i.spark, n) for n in ("landing", "facts", "facts-state"))
    DOC.write_landing(fact_documents(i), zone)
    J.land_facts(J.landed_documents(i.spark, zone, None), out, state).awaitTermination()
    return i.spark.read.parquet(out).select("cik", "concept", "unit", "value", day("period_end"), "accession_no")


@query("stream_tick_bars", """
  SELECT user_id AS security_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS trade_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    first(value ORDER BY ts DESC, event_id DESC) AS close, count(*) AS volume FROM events GROUP BY user_id, CAST(ts AS DATE)""")  # fmt: skip
def stream_tick_bars(i: Inputs) -> DataFrame:
    """Events as ticks through a stream into daily bars."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in i.table("events").schema.fields)
    stream = J.read_stream(i.spark, i.dir, schema, name_glob="events.parquet")
    table = _bar_table(i)
    J.bar_stream(_ticks(stream), table, ST.stream_folder(i.spark, "bars-state")).awaitTermination()
    return table.read().select(*J.BAR_COLUMNS).withColumn("trade_date", F.col("trade_date").cast("string"))


def _bar_table(i: Inputs) -> KeyedTable:
    return KeyedTable(i.spark, ST.stream_folder(i.spark, "bars"), J.BAR_SCHEMA, J.BAR_KEYS, STREAM_BUCKETS)


def _ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("security_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


_LATE_SQL = f"""
  WITH e AS (SELECT *, event_id % {_DEAL} AS batch FROM events),
  b AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e GROUP BY batch),
  j AS (SELECT e.*, ts IS NOT NULL AND newest IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= newest - INTERVAL 20 DAY AS late FROM e JOIN b USING (batch))
  SELECT user_id AS security_id, count(DISTINCT CAST(ts AS DATE)) FILTER (NOT late) AS bars, count(*) FILTER (NOT late) AS in_bars, count(*) FILTER (late) AS late,
    CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (late), 0) AS BIGINT) AS late_cents FROM j GROUP BY user_id"""


@query("stream_late_ticks", _LATE_SQL)
def stream_late_ticks(i: Inputs) -> DataFrame:
    """Events that arrive in several batches: per listing the ticks in its bars, and those that came twenty days too late."""
    source = _ticks(i.table("events"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    table, zone, state = _bar_table(i), ST.stream_folder(i.spark, "ticks"), ST.stream_folder(i.spark, "late-state")
    for part in range(_DEAL):
        source.where(F.col("seq") % _DEAL == part).write.mode("append").parquet(zone)
        J.bar_stream(J.read_stream(i.spark, zone, schema), table, state, lateness="20 days").awaitTermination()
    bars = table.read().groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("in_bars"))
    late = J.late_ticks(table, schema).groupBy("security_id").agg(F.count(F.lit(1)).alias("late"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("late_cents"))
    return bars.join(late, "security_id", "full_outer").fillna(0)
