"""What metrics are made of: a graph from each metric to line selections, pairs, TTM values, quotes and bars, so that a plan reads only those."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..operators.fundamentals import LEVERAGE_METRICS, MARGIN_LINES
from ..reference_data import DEBT_LINES, ISSUER_METRICS, LISTING_METRICS, METRIC, RETURN_HORIZONS

ANNUAL, SHEET, PAIR, TTM = "annual", "sheet", "pair", "ttm"
FILING_SHEETS, SHARES, QUOTES, BARS, LISTINGS = "filing_sheets", "shares", "quotes", "bars", "listings"
#: Checks of a listing row that are no metrics but are asked for like them.
CHECKS = ("year_high_diff", "cap_check")
#: Lines that fix an issuer's fiscal-year end and balance-sheet date.
YEAR_ANCHORS, SHEET_ANCHORS = ("revenue", "net_income_to_common"), ("cash", "equity")


def _lines(kind: str, *lines: str) -> tuple[str, ...]:
    return tuple(f"{kind}:{line}" for line in lines)


GRAPH: dict[str, tuple[str, ...]] = {
    "revenue_growth_yoy": _lines(PAIR, "revenue"),
    "eps_growth_yoy": _lines(PAIR, "diluted_eps"),
    "fcf": _lines(ANNUAL, "operating_cash_flow", "capex"),
    "fcf_growth_yoy": _lines(PAIR, "operating_cash_flow", "capex"),
    "revenue_ttm": _lines(TTM, "revenue"),
    "revenue_growth_ttm_yoy": ("revenue_ttm", *_lines(PAIR, "revenue")),
    "diluted_eps_ttm": _lines(TTM, "diluted_eps"),
    "total_debt": _lines(SHEET, *DEBT_LINES),
    "net_debt": ("total_debt", *_lines(SHEET, "cash", "short_term_investments")),
    "debt_to_equity": ("total_debt", *_lines(SHEET, "equity")),
    "shares_outstanding": (SHARES,),
    "issuer_market_cap": (QUOTES,),
    "price_to_sales": ("issuer_market_cap", *_lines(ANNUAL, "revenue")),
    "price_to_sales_ttm": ("issuer_market_cap", "revenue_ttm"),
    "price_to_earnings": (BARS, LISTINGS, "diluted_eps_ttm"),
    "year_high_diff": (BARS, QUOTES),
    "cap_check": (BARS, QUOTES, "issuer_market_cap", "shares_outstanding"),
}
for _margin, _line in MARGIN_LINES.items():
    GRAPH[_margin] = _lines(ANNUAL, _line, "revenue")
    GRAPH[f"{_margin}_change_yoy"] = _lines(PAIR, _line, "revenue")
GRAPH |= {m: (FILING_SHEETS, *_lines(PAIR, "revenue")) for m in LEVERAGE_METRICS}
GRAPH |= {m: (BARS,) for m in LISTING_METRICS if m in RETURN_HORIZONS or "52w" in m}


@dataclass(frozen=True)
class Needs:
    """Everything that some metrics rest on, metrics that they are made of included."""

    nodes: frozenset[str]

    @classmethod
    def of(cls, metrics: Iterable[str]) -> Needs:
        pending, seen = list(metrics), set()
        if unknown := [m for m in pending if m not in GRAPH]:
            raise ValueError(f"unknown metrics: {', '.join(unknown)}")
        while pending:
            node = pending.pop()
            if node not in seen:
                seen.add(node)
                pending.extend(GRAPH.get(node, ()))
        return cls(frozenset(seen))

    @classmethod
    def all(cls) -> Needs:
        return cls.of((*METRIC, *CHECKS))

    def __contains__(self, node: str) -> bool:
        return node in self.nodes

    def metrics(self) -> tuple[str, ...]:
        return tuple(m for m in (*ISSUER_METRICS, *LISTING_METRICS, *CHECKS) if m in self.nodes)

    def lines(self, kind: str) -> tuple[str, ...]:
        return tuple(sorted(n.split(":")[1] for n in self.nodes if n.startswith(f"{kind}:")))

    def statements(self) -> bool:
        """Whether any fact is read."""
        return any(n in self.nodes for n in (SHARES, FILING_SHEETS)) or any(":" in n for n in self.nodes)

    def issuers(self) -> bool:
        """Whether anything is known only per issuer."""
        return self.statements() or QUOTES in self.nodes or LISTINGS in self.nodes

    def period_lines(self) -> tuple[str, ...]:
        """Lines whose periods are read, those that fix the dates included."""
        annual, sheet, ttm = {*self.lines(ANNUAL), *self.lines(PAIR)}, set(self.lines(SHEET)), set(self.lines(TTM))
        out = annual | sheet | ttm
        out |= set(YEAR_ANCHORS) if annual else set()
        out |= set(SHEET_ANCHORS) if sheet else set()
        out |= {"weighted_diluted_shares"} if "diluted_eps" in ttm else set()
        return tuple(sorted(out))
