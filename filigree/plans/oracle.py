"""Reference answers in SQL for the registered queries, on the same input tables.

Written straight from the rules, not from the Spark plans. Each fragment is one or more
common table expressions; ``compose`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

from ..reference_data import CONCEPTS, DEBT_LINES, FLOW_LINES, SHEET_LINES
from . import views as V

AS_OF = f"DATE '{V.AS_OF}'"
NOFLAGS = "CAST([] AS VARCHAR[])"


def flags(*items: str) -> str:
    return f"list_filter(CAST([{', '.join(items)}] AS VARCHAR[]), lambda f: f IS NOT NULL)"


def ok(value: str, fl: str = NOFLAGS) -> str:
    return f"{{'state': 'OK', 'value': CAST({value} AS DOUBLE), 'reason': CAST(NULL AS VARCHAR), 'flags': {fl}}}"


def no(state: str, reason: str) -> str:
    return (
        f"{{'state': '{state}', 'value': CAST(NULL AS DOUBLE), 'reason': CAST({reason} AS VARCHAR), 'flags': {NOFLAGS}}}"
    )


def miss(reason: str) -> str:
    return no("MISSING_INPUT", reason)


def q(text: str) -> str:
    return f"'{text}'"


def parts(cell: str, prefix: str = "") -> str:
    return (
        f"{cell}.state AS {prefix}state, {cell}.value AS {prefix}value, {cell}.reason AS {prefix}reason, "
        f"array_to_string({cell}.flags, ',') AS {prefix}flags"
    )


def growth(now: str, prior: str) -> str:
    return f"""CASE WHEN {now} IS NULL OR {prior} IS NULL THEN {miss(q('MISSING_VALUE'))}
      WHEN {prior} = 0 THEN {no('ZERO_DENOMINATOR', q('ZERO_BASE'))}
      WHEN {prior} < 0 AND {now} > 0 THEN {no('NOT_MEANINGFUL', q('SIGN_CHANGE'))}
      WHEN {prior} < 0 THEN {no('NOT_MEANINGFUL', q('NEGATIVE_BASE'))}
      WHEN {now} < 0 THEN {no('NOT_MEANINGFUL', q('SIGN_CHANGE'))}
      ELSE {ok(f'{now} / {prior} - 1')} END"""


def margin(top: str, rev: str) -> str:
    return f"""CASE WHEN {top} IS NULL OR {rev} IS NULL THEN {miss(q('MISSING_VALUE'))}
      WHEN {rev} = 0 THEN {no('ZERO_DENOMINATOR', q('ZERO_REVENUE'))}
      WHEN {rev} < 0 THEN {no('NOT_MEANINGFUL', q('NEGATIVE_REVENUE'))} ELSE {ok(f'{top} / {rev}')} END"""


def fcf(cfo: str, capex: str) -> str:
    return f"""CASE WHEN {cfo} IS NULL THEN {miss(q('OPERATING_CASH_FLOW_MISSING'))}
      WHEN {capex} IS NULL THEN {miss(q('CAPEX_NOT_REPORTED'))} ELSE {ok(f'{cfo} - abs({capex})')} END"""


def depends(a: str, b: str | None = None) -> str:
    """WHEN branches for inputs without a value."""
    bad = q("DEPENDS_ON_UNDEFINED_INPUT")
    out = ""
    cells = [a] if b is None else [a, b]
    anyone = " OR ".join(f"{c}.state = 'MISSING_INPUT'" for c in cells)
    out += f"WHEN {anyone} THEN {miss(bad)} "
    for c in cells:
        for state in ("ZERO_DENOMINATOR", "NOT_MEANINGFUL", "NOT_COMPARABLE"):
            out += f"WHEN {c}.state = '{state}' THEN {no(state, bad)} "
    return out


def level(now: str, prior: str) -> str:
    return f"CASE {depends(now, prior)} ELSE {ok(f'{now}.value - {prior}.value')} END"


def debt(short: str, current: str, long: str, present: str = "true") -> str:
    fl = flags(f"CASE WHEN {short} IS NULL THEN 'SHORT_TERM_DEBT_NOT_REPORTED' END", "'FINANCE_LEASES_NOT_REPORTED'")
    gone = (
        f"'DEBT_COMPONENT_ABSENT:' || concat_ws(',', CASE WHEN {current} IS NULL THEN 'current_portion_long_term_debt' END, "
        f"CASE WHEN {long} IS NULL THEN 'long_term_debt' END)"
    )
    return f"""CASE WHEN {short} < 0 OR {current} < 0 OR {long} < 0 THEN {no('NOT_MEANINGFUL', q('NEGATIVE_DEBT_COMPONENT'))}
      WHEN NOT ({present}) THEN {miss(q('NO_BALANCE_SHEET'))}
      WHEN {current} IS NULL OR {long} IS NULL THEN {miss(gone)}
      ELSE {ok(f'({current} + {long}) + coalesce({short}, 0.0)', fl)} END"""


def equity_ratio(debt_cell: str, eq: str) -> str:
    return f"""CASE {depends(debt_cell)} WHEN {eq} IS NULL THEN {miss(q('EQUITY_NOT_REPORTED'))}
      WHEN {eq} = 0 THEN {no('ZERO_DENOMINATOR', q('ZERO_EQUITY'))}
      WHEN {eq} < 0 THEN {no('NOT_MEANINGFUL', q('NEGATIVE_EQUITY'))}
      ELSE {ok(f'{debt_cell}.value / {eq}', f'{debt_cell}.flags')} END"""


def sales_ratio(cap: str, rev: str) -> str:
    return f"""CASE WHEN {cap} IS NULL OR {cap} <= 0 THEN {miss(q('MARKET_CAP_MISSING'))}
      WHEN {rev} IS NULL THEN {miss(q('REVENUE_MISSING'))}
      WHEN {rev} = 0 THEN {no('ZERO_DENOMINATOR', q('ZERO_REVENUE'))}
      WHEN {rev} < 0 THEN {no('NOT_MEANINGFUL', q('NEGATIVE_REVENUE'))} ELSE {ok(f'{cap} / {rev}')} END"""


def drawdown(close: str, high: str) -> str:
    return f"""CASE WHEN {close} IS NULL OR {high} IS NULL OR {high} <= 0 OR {close} <= 0 THEN {miss(q('PRICE_MISSING'))}
      WHEN {close} > {high} * (1 + 1e-9::DOUBLE) THEN {no('NOT_MEANINGFUL', q('CLOSE_ABOVE_HIGH'))}
      ELSE {ok(f'{close} / {high} - 1')} END"""


def extreme(value: str, days: str) -> str:
    return f"""CASE WHEN coalesce({days}, 0) < 20 THEN {miss(q('INSUFFICIENT_HISTORY'))}
      ELSE {ok(value, flags(f"CASE WHEN {days} < 240 THEN 'PARTIAL_WINDOW' END"))} END"""


KIND = """CASE WHEN period_start IS NULL THEN 'INSTANT'
    WHEN date_diff('day', period_start, period_end) + 1 BETWEEN 84 AND 98 THEN 'QUARTER'
    WHEN date_diff('day', period_start, period_end) + 1 BETWEEN 170 AND 195 THEN 'HALF_YEAR_YTD'
    WHEN date_diff('day', period_start, period_end) + 1 BETWEEN 260 AND 285 THEN 'NINE_MONTH_YTD'
    WHEN date_diff('day', period_start, period_end) + 1 BETWEEN 350 AND 380 THEN 'FISCAL_YEAR' ELSE 'OTHER' END"""


def apart(later: str, earlier: str) -> str:
    return f"date_diff('day', {earlier}, {later}) BETWEEN 350 AND 380"


def near(a: str, b: str) -> str:
    return f"abs(date_diff('day', {b}, {a})) <= 7"


_CONCEPT_ROWS = ", ".join(
    f"('{line}', '{tax}', '{tag}', {i}, '{unit}')"
    for line, (tax, tags, unit, _) in CONCEPTS.items()
    for i, tag in enumerate(tags)
)
_POINT = (
    "{'filed': filed, 'accession': accession, 'value': value, 'form': form, 'period_start': period_start, "
    "'period_end': period_end, 'kind': kind, 'restated': low <> high}"
)
_YTD = "('QUARTER', 'HALF_YEAR_YTD', 'NINE_MONTH_YTD')"


def _lines(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def choose(source: str, keys: str) -> str:
    """Tag choice from rows (keys, tag, priority, filed, accession, value, form, ...) as a select."""
    return f"""
  SELECT {keys}, conflict IS NULL AS reliable, best, others,
    CASE WHEN conflict IS NULL THEN best.value END AS value, CASE WHEN conflict IS NULL THEN best.tag END AS tag,
    CASE WHEN conflict IS NULL THEN best.accession END AS accession, CASE WHEN conflict IS NULL THEN best.filed END AS filed,
    CASE WHEN conflict IS NULL THEN best.form END AS form,
    CASE WHEN conflict IS NULL THEN list_transform(others, lambda o: 'CONFIRMED_BY:' || o.tag)
      || (CASE WHEN best.restated THEN ['RESTATED_PERIOD'] ELSE {NOFLAGS} END) ELSE {NOFLAGS} END AS flags,
    CASE WHEN conflict IS NOT NULL THEN 'TAG_CONFLICT:' || best.tag || '!=' || conflict.tag END AS problem
  FROM (SELECT *, list_filter(others, lambda o: greatest(abs(best.value), abs(o.value)) > 0 AND
      abs(best.value - o.value) / greatest(abs(best.value), abs(o.value)) > 0.01::DOUBLE)[1] AS conflict
    FROM (SELECT {keys}, tags[1] AS best, tags[2:] AS others FROM (
      SELECT {keys}, list({{'tag': tag, 'value': value, 'accession': accession, 'filed': filed, 'form': form,
        'restated': restated}} ORDER BY priority) AS tags
      FROM (SELECT {keys}, tag, priority, arg_max(value, {{'f': filed, 'a': accession}}) AS value,
          arg_max(accession, {{'f': filed, 'a': accession}}) AS accession, max(filed) AS filed,
          arg_max(form, {{'f': filed, 'a': accession}}) AS form, min(low) <> max(high) AS restated
        FROM ({source}) GROUP BY {keys}, tag, priority) GROUP BY {keys})))"""


def pivot(table: str, lines, value: str, prefix: str = "") -> str:
    return ", ".join(f"any_value({value}) FILTER (line = '{ln}') AS {prefix}{ln}" for ln in lines)


_SEL = "{'value': value, 'tag': tag, 'accession': accession, 'filed': filed, 'form': form, 'flags': flags, 'problem': problem}"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "v_facts": ((), V.SQL_FACTS),
    "v_bars": ((), V.SQL_BARS),
    "v_raw": ((), V.SQL_RAW_BARS),
    "v_securities": ((), V.SQL_SECURITIES),
    "v_quotes": (("v_bars",), V.SQL_QUOTES),
    "v_sources": ((), V.SQL_SOURCES),
    "v_filings": ((), V.SQL_FILINGS),
    "lf": (
        ("v_facts",),
        f"""
concepts AS (SELECT * FROM (VALUES {_CONCEPT_ROWS}) AS c(line, taxonomy, tag, priority, unit)),
lf AS (
  SELECT cik, line, tag, priority, {KIND} AS kind, period_start, period_end, filed_date AS filed,
    accession_no AS accession, form, fiscal_year, value
  FROM v_facts f JOIN concepts c ON f.taxonomy = c.taxonomy AND f.concept = c.tag AND f.unit = c.unit)""",
    ),
    "p": (
        ("lf",),
        """
p AS (
  SELECT cik, line, tag, priority, kind, period_start, period_end, max(filed) AS filed,
    arg_max(accession, {'f': filed, 'a': accession}) AS accession, arg_max(value, {'f': filed, 'a': accession}) AS value,
    arg_max(form, {'f': filed, 'a': accession}) AS form, min(value) AS low, max(value) AS high
  FROM lf GROUP BY ALL)""",
    ),
    "anch": (
        ("p",),
        """
anch AS (
  SELECT cik, coalesce(max(period_end) FILTER (line = 'revenue' AND kind = 'FISCAL_YEAR'),
      max(period_end) FILTER (line = 'net_income_to_common' AND kind = 'FISCAL_YEAR')) AS fy_end,
    max(period_end) FILTER (line IN ('cash', 'equity') AND kind = 'INSTANT') AS sheet_end
  FROM p GROUP BY cik)""",
    ),
    "sel": (
        ("anch",),
        "sel AS ("
        + choose(
            f"""SELECT p.* FROM p JOIN anch USING (cik)
          WHERE (line IN {_lines(FLOW_LINES)} AND kind = 'FISCAL_YEAR' AND period_end = fy_end)
             OR (line IN {_lines(SHEET_LINES)} AND kind = 'INSTANT' AND period_end = sheet_end)""",
            "cik, line",
        )
        + ")",
    ),
    "wide": (
        ("sel",),
        f"""
wide AS (
  SELECT * FROM anch LEFT JOIN (SELECT cik, {pivot('sel', (*FLOW_LINES, *SHEET_LINES), _SEL)} FROM sel GROUP BY cik)
    USING (cik))""",
    ),
    "pair_tag": (
        ("anch",),
        f"""
pair_tag AS (
  WITH fy AS (SELECT lf.*, fy_end FROM lf JOIN anch USING (cik)
      WHERE kind = 'FISCAL_YEAR' AND line IN {_lines(FLOW_LINES)}),
  ends AS (SELECT cik, line, tag, fy_end, max(period_end) FILTER ({apart('fy_end', 'period_end')}) AS prior_end
      FROM fy GROUP BY ALL HAVING bool_or(period_end = fy_end)),
  both_years AS (SELECT n.cik, n.line, n.tag, n.priority, n.accession,
      {{'filed': n.filed, 'accession': n.accession, 'value': n.value, 'period_start': n.period_start, 'period_end': n.period_end}} AS now,
      {{'filed': r.filed, 'accession': r.accession, 'value': r.value, 'period_start': r.period_start, 'period_end': r.period_end}} AS prior
    FROM fy n JOIN ends e USING (cik, line, tag) JOIN fy r ON r.cik = n.cik AND r.line = n.line AND r.tag = n.tag
      AND r.accession = n.accession AND r.period_end = e.prior_end WHERE n.period_end = n.fy_end)
  SELECT * FROM both_years QUALIFY row_number() OVER (PARTITION BY cik, line, tag ORDER BY now.filed DESC, accession DESC) = 1)""",
    ),
    "pair": (
        ("pair_tag",),
        """
pair AS (SELECT * FROM pair_tag QUALIFY row_number() OVER (PARTITION BY cik, line ORDER BY priority) = 1)""",
    ),
    "pairw": (
        ("pair",),
        "pairw AS (SELECT cik, "
        + pivot("pair", FLOW_LINES, "{'tag': tag, 'now': now, 'prior': prior}", "pair_")
        + " FROM pair GROUP BY cik)",
    ),
    "ttm_tag": (
        ("p",),
        f"""
ttm_tag AS (
  WITH rows AS (SELECT *, {_POINT} AS pt,
      max(period_end) FILTER (kind = 'FISCAL_YEAR') OVER (PARTITION BY cik, line) AS fy_end
    FROM p WHERE line IN ('revenue', 'diluted_eps')),
  tags AS (SELECT cik, line, tag, priority, fy_end,
      arg_max(pt, {{'f': filed, 'a': accession}}) FILTER (kind = 'FISCAL_YEAR' AND period_end = fy_end) AS fy,
      arg_max(pt, {{'e': period_end, 's': period_start}}) FILTER (kind IN {_YTD} AND period_end > fy_end
        AND {near('period_start', 'fy_end + 1')}) AS cur,
      coalesce(bool_or(kind IN {_YTD} AND period_end > fy_end), false) AS has_newer,
      max(period_end) FILTER (kind = 'FISCAL_YEAR' AND {apart('fy_end', 'period_end')}) AS prev_fy_end
    FROM rows GROUP BY ALL),
  t1 AS (SELECT t.*, (SELECT arg_max(r.pt, {{'e': r.period_end, 's': r.period_start}}) FROM rows r
        WHERE r.cik = t.cik AND r.line = t.line AND r.tag = t.tag AND r.kind = t.cur.kind
          AND {apart('t.cur.period_end', 'r.period_end')} AND {apart('t.cur.period_start', 'r.period_start')}
          AND {near('r.period_start', 't.fy.period_start')}) AS prior,
      (SELECT arg_max(r.pt, {{'f': r.filed, 'a': r.accession}}) FROM rows r
        WHERE r.cik = t.cik AND r.line = t.line AND r.tag = t.tag AND r.kind = 'FISCAL_YEAR'
          AND r.period_end = t.prev_fy_end) AS prev_fy
    FROM tags t WHERE fy IS NOT NULL)
  SELECT t.*, (SELECT arg_max(r.pt, {{'e': r.period_end, 's': r.period_start}}) FROM rows r
        WHERE r.cik = t.cik AND r.line = t.line AND r.tag = t.tag AND r.kind = t.prior.kind
          AND {apart('t.prior.period_end', 'r.period_end')} AND {apart('t.prior.period_start', 'r.period_start')}
          AND {near('r.period_start', 't.prev_fy.period_start')}) AS prior2
  FROM t1 t)""",
    ),
    "ttm": (
        ("ttm_tag",),
        f"""
ttm AS (
  SELECT * FROM (SELECT *, CASE WHEN cur IS NULL AND has_newer THEN {no('NOT_COMPARABLE', q('TTM_PERIODS_MISALIGNED'))}
      WHEN cur IS NULL THEN {ok('fy.value', flags("CASE WHEN fy.restated THEN 'RESTATED_PERIOD' END"))}
      WHEN prior IS NULL THEN {miss(q('PRIOR_YEAR_YTD_MISSING'))}
      ELSE {ok('fy.value + cur.value - prior.value', flags(
          "'COMPOSED:FY+YTD-YTD_PRIOR'",
          "CASE WHEN fy.restated OR cur.restated OR prior.restated THEN 'RESTATED_PERIOD' END"))} END AS ttm,
      CASE WHEN cur IS NULL THEN 'FY' ELSE 'FY+YTD-YTD_PRIOR' END AS basis FROM ttm_tag)
  QUALIFY row_number() OVER (PARTITION BY cik, line ORDER BY (ttm.state = 'MISSING_INPUT')::INT, priority) = 1)""",
    ),
    "ttm_rev": (
        ("ttm", "pair_tag"),
        f"""
ttm_rev AS (
  SELECT t.cik, t.ttm, t.tag, t.basis, CASE WHEN t.ttm.state <> 'OK' THEN t.ttm
      WHEN basis = 'FY' AND pt.cik IS NULL THEN {miss(q('PRIOR_YEAR_NOT_IN_SAME_FILING'))}
      WHEN basis = 'FY' THEN {ok('pt.prior.value')}
      WHEN prev_fy_end IS NULL THEN {miss(q('PRIOR_FISCAL_YEAR_MISSING'))}
      WHEN NOT ({near('t.prior.period_start', 'prev_fy_end + 1')}) THEN {no('NOT_COMPARABLE', q('TTM_PERIODS_MISALIGNED'))}
      WHEN prior2 IS NULL THEN {miss(q('PRIOR_YEAR_YTD_MISSING'))}
      ELSE {ok('t.prev_fy.value + t.prior.value - t.prior2.value', flags(
          "'COMPOSED:FY+YTD-YTD_PRIOR'",
          "CASE WHEN t.prev_fy.restated OR t.prior2.restated THEN 'RESTATED_PERIOD' END"))} END AS before
  FROM ttm t LEFT JOIN pair_tag pt ON pt.cik = t.cik AND pt.line = t.line AND pt.tag = t.tag WHERE t.line = 'revenue'),
ttm_growth AS (
  SELECT cik, ttm, before, CASE WHEN ttm.state <> 'OK' THEN
      {{'state': ttm.state, 'value': CAST(NULL AS DOUBLE), 'reason': ttm.reason, 'flags': {NOFLAGS}}}
    WHEN before.state <> 'OK' THEN {{'state': before.state, 'value': CAST(NULL AS DOUBLE), 'reason': before.reason, 'flags': {NOFLAGS}}}
    WHEN len(list_filter(ttm.flags || before.flags, lambda f: f LIKE 'RESTATED%')) > 0
      THEN {no('NOT_COMPARABLE', q('RESTATED_COMPONENT'))}
    ELSE {{'state': g.state, 'value': g.value, 'reason': g.reason, 'flags': g.flags || ['TTM_COMPONENTS_FROM_SEVERAL_FILINGS']}}
    END AS growth
  FROM (SELECT *, {growth('ttm.value', 'before.value')} AS g FROM ttm_rev))""",
    ),
    "ttm_eps": (
        ("ttm",),
        f"""
ttm_eps AS (
  WITH w AS (SELECT cik, period_start, period_end, value FROM p WHERE line = 'weighted_diluted_shares')
  SELECT t.cik, t.tag, t.basis, f.value AS fy_shares, c.value AS cur_shares,
    CASE WHEN t.ttm.state <> 'OK' OR t.basis = 'FY' THEN t.ttm
      WHEN f.value IS NULL OR c.value IS NULL OR f.value = 0 THEN {miss(q('SPLIT_GUARD_UNAVAILABLE'))}
      WHEN c.value / f.value < 0.55::DOUBLE OR c.value / f.value > 1.8::DOUBLE
        THEN {no('NOT_COMPARABLE', q('POSSIBLE_SPLIT_BASIS_CHANGE'))}
      ELSE {{'state': t.ttm.state, 'value': t.ttm.value, 'reason': t.ttm.reason,
             'flags': t.ttm.flags || ['PER_SHARE_SUM_OF_PERIODS']}} END AS ttm
  FROM ttm t LEFT JOIN w f ON f.cik = t.cik AND f.period_start = t.fy.period_start AND f.period_end = t.fy.period_end
    LEFT JOIN w c ON c.cik = t.cik AND c.period_start = t.cur.period_start AND c.period_end = t.cur.period_end
  WHERE t.line = 'diluted_eps')""",
    ),
    "sheets": (
        ("pair", "lf"),
        "sheets AS (SELECT r.cik, "
        + ", ".join(
            f"any_value({_SEL.replace('value', 's.value', 1) if False else _SEL}) FILTER (year = '{y}' AND line = '{ln}') AS {y}_{ln}"
            for y in ("now", "prior")
            for ln in (*DEBT_LINES, "equity")
        )
        + " FROM (SELECT cik FROM pair WHERE line = 'revenue') r LEFT JOIN ("
        + choose(
            f"""SELECT lf.cik, CASE WHEN lf.period_end = r.now.period_end THEN 'now' ELSE 'prior' END AS year, lf.line, lf.tag,
              lf.priority, lf.filed, lf.accession, lf.value, lf.form, lf.value AS low, lf.value AS high
            FROM lf JOIN (SELECT * FROM pair WHERE line = 'revenue') r ON r.cik = lf.cik AND r.now.accession = lf.accession
            WHERE lf.kind = 'INSTANT' AND lf.line IN {_lines((*DEBT_LINES, 'equity'))}
              AND lf.period_end IN (r.now.period_end, r.prior.period_end)""",
            "cik, year, line",
        )
        + ") s USING (cik) GROUP BY r.cik)",
    ),
    "shares": (
        ("lf",),
        """
shares AS (
  SELECT cik, period_end AS shares_end, min(value) AS low, max(value) AS high FROM lf WHERE line = 'shares_outstanding'
  GROUP BY cik, period_end, filed
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC, filed DESC) = 1)""",
    ),
}


def compose(select: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return select
    return "WITH " + ",\n".join(CTES[n][1].strip() for n in order) + "\n" + select


# --- issuer metrics --------------------------------------------------------------------------------------------------


def _problem(sel: str) -> str:
    return miss(f"coalesce({sel}.problem, 'NOT_REPORTED')")


def _margin_of(line: str) -> str:
    return f"""CASE WHEN fy_end IS NULL THEN {miss(q('NO_ANNUAL_REVENUE_OR_NET_INCOME'))}
      WHEN revenue.value IS NULL THEN {_problem('revenue')} WHEN {line}.value IS NULL THEN {_problem(line)}
      ELSE {margin(f'{line}.value', 'revenue.value')} END"""


def _kind_of(start: str, end: str) -> str:
    return KIND.replace("period_start", start).replace("period_end", end)


def _comparable(pair: str) -> str:
    """WHEN branches for periods that cannot be compared."""
    now = _kind_of(f"{pair}.now.period_start", f"{pair}.now.period_end").replace(".now.period_start.now", "")
    before = _kind_of(f"{pair}.prior.period_start", f"{pair}.prior.period_end")
    return f"""WHEN ({now}) = 'OTHER' OR ({now}) <> ({before}) THEN {no('NOT_COMPARABLE', q('PERIOD_LENGTH_MISMATCH'))}
      WHEN NOT ({apart(f'{pair}.now.period_end', f'{pair}.prior.period_end')}) THEN {no('NOT_COMPARABLE', q('NOT_ONE_YEAR_APART'))}"""


NO_YEAR = f"WHEN fy_end IS NULL THEN {miss(q('NO_ANNUAL_REVENUE_OR_NET_INCOME'))}"
NO_PAIR = miss(q("NO_FILING_REPORTS_BOTH_YEARS"))


def _growth_of(line: str) -> str:
    p = f"pair_{line}"
    return f"CASE {NO_YEAR} WHEN {p} IS NULL THEN {NO_PAIR} {_comparable(p)} ELSE {growth(f'{p}.now.value', f'{p}.prior.value')} END"


def _margin_change_of(line: str) -> str:
    t, r = f"pair_{line}", "pair_revenue"
    now, before = margin(f"{t}.now.value", f"{r}.now.value"), margin(f"{t}.prior.value", f"{r}.prior.value")
    return f"""CASE {NO_YEAR} WHEN {t} IS NULL OR {r} IS NULL THEN {NO_PAIR}
      WHEN {t}.now.accession <> {r}.now.accession THEN {no('NOT_COMPARABLE', q('MARGIN_INPUTS_FROM_DIFFERENT_FILINGS'))}
      {_comparable(r)} ELSE {level(f'({now})', f'({before})')} END"""


FCF = f"""CASE {NO_YEAR} WHEN operating_cash_flow.value IS NOT NULL AND capex.value IS NOT NULL THEN
    {ok('operating_cash_flow.value - abs(capex.value)', flags("CASE WHEN operating_cash_flow.accession <> capex.accession THEN 'MIXED_FILINGS' END"))}
    ELSE {fcf('operating_cash_flow.value', 'capex.value')} END"""
_C, _X = "pair_operating_cash_flow", "pair_capex"
_FN, _FP = f"({_C}.now.value - abs({_X}.now.value))", f"({_C}.prior.value - abs({_X}.prior.value))"
FCF_GROWTH = f"""CASE {NO_YEAR} WHEN {_C} IS NULL OR {_X} IS NULL THEN {miss(q('CAPEX_OR_CFO_PAIR_MISSING'))}
    WHEN {_C}.now.accession <> {_X}.now.accession THEN {no('NOT_COMPARABLE', q('CFO_AND_CAPEX_FROM_DIFFERENT_FILINGS'))}
    ELSE {growth(_FN, _FP)} END"""


def _sheet_ratio(year: str) -> str:
    s = {ln: f"{year}_{ln}" for ln in (*DEBT_LINES, "equity")}
    conflict = "coalesce(" + ", ".join(f"{x}.problem" for x in s.values()) + ")"
    d = debt(*[f"{s[ln]}.value" for ln in DEBT_LINES])
    return f"CASE WHEN {conflict} IS NOT NULL THEN {miss(conflict)} ELSE {equity_ratio(f'({d})', s['equity'] + '.value')} END"


_DEBT_CONFLICT = "coalesce(" + ", ".join(f"{ln}.problem" for ln in DEBT_LINES) + ")"
TOTAL_DEBT = f"""CASE WHEN sheet_end IS NOT NULL AND {_DEBT_CONFLICT} IS NOT NULL THEN {miss(f"'DEBT_LINE_' || {_DEBT_CONFLICT}")}
    ELSE {debt(*[f'{ln}.value' for ln in DEBT_LINES], present='sheet_end IS NOT NULL')} END"""
NET_DEBT = f"""CASE WHEN cash.problem IS NOT NULL OR short_term_investments.problem IS NOT NULL THEN {miss(q('CASH_TAG_CONFLICT'))}
    {depends('total_debt')} WHEN cash.value IS NULL THEN {miss(q('CASH_NOT_REPORTED'))}
    ELSE {ok('total_debt.value - (cash.value + coalesce(short_term_investments.value, 0.0))',
             "total_debt.flags || " + flags("CASE WHEN short_term_investments.value IS NULL THEN 'ASSUMED_ZERO:short_term_investments' END"))} END"""
DEBT_EQUITY = f"CASE WHEN equity.problem IS NOT NULL THEN {miss(q('EQUITY_TAG_CONFLICT'))} ELSE {equity_ratio('total_debt', 'equity.value')} END"
SHARES = f"""CASE WHEN shares_end IS NULL THEN {miss(q('NOT_REPORTED'))}
    WHEN date_diff('day', shares_end, {AS_OF}) > 400 THEN {miss("'STALE_SHARES:' || shares_end")}
    WHEN low <> high THEN {miss(q('MULTI_CLASS_AMBIGUOUS'))} ELSE {ok('low')} END"""
NO_TTM = miss(q("NO_ANNUAL_VALUE"))

ANNUAL = {
    "gross_margin": _margin_of("gross_profit"),
    "operating_margin": _margin_of("operating_income"),
    "net_margin": _margin_of("net_income_to_common"),
    "revenue_growth_yoy": _growth_of("revenue"),
    "eps_growth_yoy": _growth_of("diluted_eps"),
    "fcf": FCF,
    "fcf_growth_yoy": FCF_GROWTH,
    "gross_margin_change_yoy": _margin_change_of("gross_profit"),
    "operating_margin_change_yoy": _margin_change_of("operating_income"),
    "net_margin_change_yoy": _margin_change_of("net_income_to_common"),
}
LEVERAGE_GAP = f"CASE WHEN w.fy_end IS NULL THEN {miss(q('NO_ANNUAL_REVENUE_OR_NET_INCOME'))} ELSE {NO_PAIR} END"

CTES["annual"] = (
    ("wide", "pairw"),
    "annual AS (SELECT cik, fy_end, "
    + ", ".join(f"{expr} AS {name}" for name, expr in ANNUAL.items())
    + " FROM wide LEFT JOIN pairw USING (cik))",
)
CTES["sheet"] = (
    ("wide",),
    f"""sheet AS (SELECT cik, sheet_end, total_debt, {NET_DEBT} AS net_debt, {DEBT_EQUITY} AS debt_to_equity
  FROM (SELECT *, {TOTAL_DEBT} AS total_debt FROM wide))""",
)
CTES["lever"] = (
    ("sheets",),
    f"""lever AS (SELECT *, {level('debt_to_equity_fy', 'debt_to_equity_prior_fy')} AS debt_to_equity_change_yoy
  FROM (SELECT cik, {_sheet_ratio('now')} AS debt_to_equity_fy, {_sheet_ratio('prior')} AS debt_to_equity_prior_fy FROM sheets))""",
)
CTES["listing_agg"] = (
    ("v_bars",),
    f"""listing_agg AS (
  SELECT security_id, max(trade_date) AS newest_bar, max(trade_date) FILTER (past) AS last_bar,
    arg_max(close, trade_date) FILTER (past) AS last_close,
    max(high) FILTER (win) AS high_max, count(high) FILTER (win) AS high_days, min(low) FILTER (win) AS low_min,
    count(low) FILTER (win) AS low_days, max(close) FILTER (win) AS close_max, min(close) FILTER (win) AS close_min,
    count(close) FILTER (win) AS close_days, """
    + ", ".join(
        f"max(trade_date) FILTER (trade_date <= CAST({AS_OF} - INTERVAL {n} MONTH AS DATE)) AS d{n}, "
        f"arg_max(close, trade_date) FILTER (trade_date <= CAST({AS_OF} - INTERVAL {n} MONTH AS DATE)) AS c{n}"
        for n in (1, 3, 6, 12, 36, 60)
    )
    + f""" FROM (SELECT *, trade_date <= {AS_OF} AS past, trade_date BETWEEN {AS_OF} - 365 AND {AS_OF} AS win FROM v_bars)
  GROUP BY security_id)""",
)
_RETURNS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60}


def _return_of(n: int) -> str:
    return f"""CASE WHEN last_close IS NULL THEN {miss(q('PRICE_MISSING'))} WHEN d{n} IS NULL THEN {miss(q('INSUFFICIENT_HISTORY'))}
      WHEN date_diff('day', d{n}, CAST({AS_OF} - INTERVAL {n} MONTH AS DATE)) > 7 THEN {miss(q('BASE_PRICE_STALE'))}
      WHEN c{n} IS NULL OR c{n} <= 0 THEN {miss(q('PRICE_MISSING'))}
      ELSE {ok(f'last_close / c{n} - 1', "['PRICE_RETURN_EXCLUDES_DIVIDENDS']")} END"""


CTES["prices"] = (
    ("listing_agg",),
    "prices AS (SELECT *, "
    + drawdown("last_close", "high_52w.value")
    + " AS drawdown_from_52w_high, "
    + drawdown("last_close", "high_52w_close.value")
    + " AS drawdown_from_52w_closing_high FROM (SELECT *, "
    + ", ".join(
        f"{extreme(v, d)} AS {n}"
        for n, v, d in (
            ("high_52w", "high_max", "high_days"), ("low_52w", "low_min", "low_days"),
            ("high_52w_close", "close_max", "close_days"), ("low_52w_close", "close_min", "close_days"),
        )
    )
    + ", "
    + ", ".join(f"{_return_of(n)} AS price_return_{k}" for k, n in _RETURNS.items())
    + " FROM listing_agg))",
)
CTES["coverage"] = (
    ("v_sources",),
    """coverage AS (
  SELECT cik, unavailable FROM (
    SELECT cik, CASE WHEN detail IS NOT NULL THEN json_extract_string(detail, '$.notes[0]') END AS unavailable FROM v_sources
    WHERE provider = 'sec' AND dataset = 'companyfacts'
    QUALIFY row_number() OVER (PARTITION BY cik ORDER BY retrieved_at DESC, source_id DESC) = 1) WHERE unavailable IS NOT NULL)""",
)
CTES["primaries"] = (
    ("v_securities",),
    """primaries AS (
  SELECT cik, min(ticker) AS primary_ticker, 'UNDESIGNATED_FIRST_LISTING' AS designation, count(*) AS listings,
    count(*) > 1 AS multi_class FROM v_securities WHERE cik IS NOT NULL GROUP BY cik)""",
)
CTES["newest_quote"] = (
    ("v_quotes",),
    "newest_quote AS (SELECT * FROM v_quotes QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY quote_date DESC) = 1)",
)
CTES["issuer_cap"] = (
    ("primaries", "newest_quote"),
    f"""issuer_cap AS (
  SELECT cik, primary_ticker, designation, listings, multi_class, s.security_id AS primary_security_id, quote_date, market_cap,
    CASE WHEN market_cap IS NULL OR market_cap <= 0 THEN {miss(q('PRIMARY_LISTING_MARKET_CAP_MISSING'))}
      ELSE {ok('market_cap', flags(
          "CASE WHEN listings > 1 THEN 'MULTI_CLASS_ALL_SHARES_AT_PRIMARY_PRICE' END",
          f"CASE WHEN date_diff('day', quote_date, {AS_OF}) > 5 THEN 'QUOTE_STALE:' || date_diff('day', quote_date, {AS_OF}) || 'D' END"))}
      END AS issuer_market_cap
  FROM primaries pr JOIN v_securities s USING (cik) LEFT JOIN newest_quote nq ON nq.security_id = s.security_id
  WHERE s.ticker = pr.primary_ticker)""",
)
_FUND = (
    *ANNUAL, "total_debt", "net_debt", "debt_to_equity", "debt_to_equity_fy", "debt_to_equity_prior_fy",
    "debt_to_equity_change_yoy", "revenue_ttm", "revenue_growth_ttm_yoy", "diluted_eps_ttm", "shares_outstanding",
)
_EMPTY_WIDE = {
    **dict.fromkeys(ANNUAL, miss(q("NO_ANNUAL_REVENUE_OR_NET_INCOME"))),
    "total_debt": miss(q("NO_BALANCE_SHEET")),
    "net_debt": miss(q("DEPENDS_ON_UNDEFINED_INPUT")),
    "debt_to_equity": miss(q("DEPENDS_ON_UNDEFINED_INPUT")),
}
_FILL = {
    **{n: f"coalesce({n}, {e})" for n, e in _EMPTY_WIDE.items()},
    **{n: f"coalesce({n}, {LEVERAGE_GAP})" for n in ("debt_to_equity_fy", "debt_to_equity_prior_fy", "debt_to_equity_change_yoy")},
    "revenue_ttm": f"coalesce(tg.ttm, {NO_TTM})",
    "revenue_growth_ttm_yoy": f"coalesce(tg.growth, {NO_TTM})",
    "diluted_eps_ttm": f"coalesce(te.ttm, {NO_TTM})",
    "shares_outstanding": SHARES,
}
CTES["issuer"] = (
    ("issuer_cap", "annual", "sheet", "lever", "ttm_rev", "ttm_eps", "shares", "coverage"),
    "issuer AS (SELECT f.*, "
    + f"""CASE WHEN unavailable IS NOT NULL THEN {miss('unavailable')} ELSE ps END AS ps0,
      CASE WHEN unavailable IS NOT NULL THEN {miss('unavailable')} ELSE pt END AS price_to_sales_ttm
    FROM (SELECT g.*, {sales_ratio('cap', 'revenue_fy')} AS ps,
      {sales_ratio('cap', "CASE WHEN revenue_ttm.state = 'OK' THEN revenue_ttm.value END")} AS pt FROM (
      SELECT ic.*, issuer_market_cap.value AS cap, unavailable, w.revenue.value AS revenue_fy, """
    + ", ".join(f"CASE WHEN unavailable IS NOT NULL THEN {miss('unavailable')} ELSE {e} END AS {n}" for n, e in _FILL.items())
    + """ FROM issuer_cap ic LEFT JOIN wide w USING (cik) LEFT JOIN annual a USING (cik) LEFT JOIN sheet sh USING (cik)
      LEFT JOIN lever USING (cik) LEFT JOIN ttm_growth tg USING (cik) LEFT JOIN ttm_eps te USING (cik)
      LEFT JOIN shares USING (cik) LEFT JOIN coverage USING (cik)) g) f),
issuer_all AS (SELECT *, {'state': ps0.state, 'value': ps0.value, 'reason': ps0.reason, 'flags': ps0.flags
    || (CASE WHEN issuer_market_cap.state <> 'OK' THEN ['MARKET_CAP:' || issuer_market_cap.reason] ELSE CAST([] AS VARCHAR[]) END)}
    AS price_to_sales FROM issuer)""",
)
ISSUER_ORDER = (*_FUND, "issuer_market_cap", "price_to_sales", "price_to_sales_ttm")
LISTING_ORDER = (
    *[f"price_return_{k}" for k in _RETURNS], "drawdown_from_52w_high", "drawdown_from_52w_closing_high", "high_52w",
    "high_52w_close", "price_to_earnings",
)


def _pe() -> str:
    eps = "diluted_eps_ttm"
    f = flags("CASE WHEN multi_class THEN 'MULTI_CLASS_PER_SHARE_BASIS_UNVERIFIED' END")

    def no_(state: str, reason: str) -> str:
        return f"{{'state': {state}, 'value': CAST(NULL AS DOUBLE), 'reason': CAST({reason} AS VARCHAR), 'flags': {f}}}"

    return f"""CASE WHEN {eps}.state <> 'OK' AND last_close IS NOT NULL AND last_close <> 0
        THEN {no_(f'{eps}.state', f"'EPS_TTM:' || {eps}.reason")}
      WHEN last_close IS NULL OR last_close <= 0 THEN {no_("'MISSING_INPUT'", q('PRICE_MISSING'))}
      WHEN {eps}.value IS NULL THEN {no_("'MISSING_INPUT'", q('EPS_MISSING'))}
      WHEN {eps}.value = 0 THEN {no_("'ZERO_DENOMINATOR'", q('ZERO_EPS'))}
      WHEN {eps}.value < 0 THEN {no_("'NOT_MEANINGFUL'", q('NEGATIVE_EARNINGS'))}
      ELSE {ok(f'last_close / {eps}.value', f)} END"""


_STALE_BAR = f"(newest_bar IS NULL OR date_diff('day', newest_bar, {AS_OF}) > 7)"
_STALE_QUOTE = f"(quote_date IS NULL OR date_diff('day', quote_date, {AS_OF}) > 7)"
_WHY_BAR = miss("CASE WHEN newest_bar IS NULL THEN 'NO_PRICE_DATA' ELSE 'STALE_PRICE_DATA:last_bar=' || newest_bar END")
_WHY_QUOTE = miss("CASE WHEN quote_date IS NULL THEN 'NO_QUOTE' ELSE 'STALE_QUOTE:quote_date=' || quote_date END")
_PRICE_GAP = {
    **{f"price_return_{k}": miss(q("PRICE_MISSING")) for k in _RETURNS},
    "drawdown_from_52w_high": miss(q("PRICE_MISSING")),
    "drawdown_from_52w_closing_high": miss(q("PRICE_MISSING")),
    "high_52w": miss(q("INSUFFICIENT_HISTORY")),
    "high_52w_close": miss(q("INSUFFICIENT_HISTORY")),
}
CTES["listing_price"] = (
    ("prices", "v_securities"),
    "listing_price AS (SELECT s.*, newest_bar, last_close, p.last_bar AS past_bar, "
    + ", ".join(f"coalesce({n}, {e}) AS {n}" for n, e in _PRICE_GAP.items())
    + " FROM v_securities s LEFT JOIN prices p USING (security_id) WHERE cik IS NOT NULL)",
)
CTES["price_view"] = (
    ("listing_price",),
    "price_view AS (SELECT security_id, cik, ticker, name, sector, industry, sector_source, sic, sic_source, newest_bar, "
    + ", ".join(f"CASE WHEN {_STALE_BAR} THEN {_WHY_BAR} ELSE {n} END AS {n}" for n in _PRICE_GAP)
    + " FROM listing_price)",
)
CTES["view"] = (
    ("listing_price", "issuer"),
    "view_raw AS (SELECT lp.*, i.* EXCLUDE (cik), "
    + _pe()
    + " AS price_to_earnings FROM listing_price lp JOIN issuer_all i USING (cik)),\n"
    + "view AS (SELECT security_id, cik, ticker, name, sector, industry, sector_source, sic, sic_source, newest_bar, quote_date, unavailable, "
    + "last_close, multi_class, primary_security_id, high_52w AS raw_high_52w, issuer_market_cap AS raw_cap, "
    + ", ".join(f"{n}" for n in _FUND)
    + ", "
    + ", ".join(
        f"CASE WHEN {_STALE_QUOTE} THEN {_WHY_QUOTE} ELSE {n} END AS {n}"
        for n in ("issuer_market_cap", "price_to_sales", "price_to_sales_ttm")
    )
    + ", "
    + ", ".join(f"CASE WHEN {_STALE_BAR} THEN {_WHY_BAR} ELSE {n} END AS {n}" for n in LISTING_ORDER)
    + " FROM view_raw)",
)


def long_select(table: str, keys: str, names) -> str:
    """One row per metric from a wide table of cells."""
    items = ", ".join(f"{{'metric': '{n}', 'c': {n}}}" for n in names)
    return f"SELECT {keys}, m.metric AS metric, {parts('m.c')} FROM (SELECT {keys}, unnest([{items}]) AS m FROM {table})"
