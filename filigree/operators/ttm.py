"""Trailing twelve months: fiscal year + current year-to-date - prior year-to-date, from one tag.

All steps are windows over one (issuer, line, tag) partition of the reduced period
table, so the composition needs one shuffle and no self-join. Such a partition holds
one row per distinct reporting period and is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cell import MISSING_INPUT, NOT_COMPARABLE, OK, absent, cell, flag_array, missing, ok
from ..functions import dates as D
from ..functions.metrics import growth_rate

TTM_LINES = ("revenue", "diluted_eps")
COMPOSED = "FY+YTD-YTD_PRIOR"
# Share ratio outside which the per-share basis changed.
SHARE_RATIO_LIMITS = (0.55, 1.8)


def _point(extra: Column | None = None) -> Column:
    return F.struct(
        F.col("period_end"), F.col("period_start"), F.col("filed"), F.col("accession"), F.col("value"), F.col("form"),
        F.col("kind"), (F.col("low") != F.col("high")).alias("restated"),
    )


def _annual(w, end: Column) -> dict:
    """Latest annual vintage ending at ``end`` within the tag, plus whether any of its values differ."""
    at = (F.col("kind") == D.FISCAL_YEAR) & (F.col("period_end") == end)
    chosen = F.max(
        F.when(at, F.struct("filed", "accession", "period_start", "period_end", "value", "form"))
    ).over(w)
    restated = F.min(F.when(at, F.col("low"))).over(w) != F.max(F.when(at, F.col("high"))).over(w)
    return {"chosen": chosen, "restated": restated}


def _prior_year(w, later: Column, year: Column) -> Column:
    """The year-to-date period one year before ``later``, aligned with the start of fiscal year ``year``."""
    fits = (
        (F.col("kind") == later["kind"])
        & F.col("period_start").isNotNull()
        & D.years_apart(later["period_end"], F.col("period_end"))
        & D.years_apart(later["period_start"], F.col("period_start"))
        & D.near(F.col("period_start"), year["period_start"])
    )
    return F.max(F.when(fits, _point())).over(w)


def ttm_parts(p: DataFrame, lines=TTM_LINES) -> DataFrame:
    """One row per (issuer, line, tag) with the facts a TTM value is made of."""
    rows = p.where(F.col("line").isin(*lines) & F.col("kind").isin(D.FISCAL_YEAR, *D.YTD_KINDS))
    line_w = Window.partitionBy("cik", "line")
    tag_w = Window.partitionBy("cik", "line", "tag")
    is_fy, is_ytd = F.col("kind") == D.FISCAL_YEAR, F.col("kind").isin(*D.YTD_KINDS)

    rows = rows.withColumn("fy_end", F.max(F.when(is_fy, F.col("period_end"))).over(line_w))
    # nothing older can take part: the earliest period of a prior-year TTM ends two years before the current one
    rows = rows.where(F.datediff("fy_end", "period_end") <= 2 * D.YEAR_APART_DAYS[1])
    newer = is_ytd & (F.col("period_end") > F.col("fy_end"))
    aligned = newer & D.near(F.col("period_start"), F.date_add("fy_end", 1))
    fy = _annual(tag_w, F.col("fy_end"))
    rows = rows.withColumns(
        {
            "fy": fy["chosen"],
            "fy_restated": fy["restated"],
            "cur": F.max(F.when(aligned, _point())).over(tag_w),
            "has_newer": F.max(newer).over(tag_w),
            "prev_fy_end": F.max(
                F.when(is_fy & D.years_apart(F.col("fy_end"), F.col("period_end")), F.col("period_end"))
            ).over(tag_w),
        }
    )
    prev = _annual(tag_w, F.col("prev_fy_end"))
    rows = rows.withColumns(
        {
            "prior": _prior_year(tag_w, F.col("cur"), F.col("fy")),
            "prev_fy": prev["chosen"],
            "prev_fy_restated": prev["restated"],
        }
    )
    rows = rows.withColumn("prior2", _prior_year(tag_w, F.col("prior"), F.col("prev_fy")))
    constant = [
        "fy_end", "fy", "fy_restated", "cur", "has_newer", "prior", "prev_fy_end", "prev_fy", "prev_fy_restated",
        "prior2",
    ]
    # every window value is the same on all rows of a tag
    return (
        rows.groupBy("cik", "line", "tag", "priority")
        .agg(*[F.first(c).alias(c) for c in constant])
        .where(F.col("fy").isNotNull())
    )


def _restated(flag: Column) -> Column:
    return F.when(flag, "RESTATED_PERIOD")


def _composed(year: Column, year_restated: Column, cur: Column, cur_restated: Column, prior: Column) -> Column:
    flags = F.array_distinct(
        flag_array(
            F.lit("COMPOSED:" + COMPOSED), _restated(year_restated), _restated(cur_restated),
            _restated(prior["restated"]),
        )
    )
    return ok(year["value"] + cur["value"] - prior["value"], flags)


def ttm_outcomes(parts: DataFrame) -> DataFrame:
    """Adds the TTM cell and its basis to every tag."""
    fy, cur, prior = F.col("fy"), F.col("cur"), F.col("prior")
    outcome = (
        F.when(
            cur.isNull() & F.col("has_newer"), absent(NOT_COMPARABLE, "TTM_PERIODS_MISALIGNED")
        )
        .when(cur.isNull(), ok(fy["value"], flag_array(_restated(F.col("fy_restated")))))
        .when(prior.isNull(), missing("PRIOR_YEAR_YTD_MISSING"))
        .otherwise(_composed(fy, F.col("fy_restated"), cur, cur["restated"], prior))
    )
    basis = F.when(cur.isNull(), "FY").otherwise(COMPOSED)
    return parts.withColumn("ttm", outcome).withColumn("basis", F.when(F.col("ttm.state") == OK, basis))


def choose_ttm(outcomes: DataFrame) -> DataFrame:
    """Per line the first tag whose outcome is decisive; a missing one lets the next tag try."""
    rank = F.struct(
        F.when(F.col("ttm.state") == MISSING_INPUT, 1).otherwise(0).alias("undecided"), F.col("priority").alias("rank")
    )
    best = outcomes.groupBy("cik", "line").agg(
        F.min_by(F.struct(*[c for c in outcomes.columns if c not in ("cik", "line")]), rank).alias("best")
    )
    return best.select("cik", "line", "best.*")


def prior_year_ttm(chosen: DataFrame, by_tag_pairs: DataFrame) -> DataFrame:
    """Adds the TTM cell of one year earlier, built in the same way from the same tag."""
    pairs = by_tag_pairs.select("cik", "line", "tag", F.col("prior").alias("pair_prior"))
    rows = chosen.join(pairs, ["cik", "line", "tag"], "left")
    prior, prev = F.col("prior"), F.col("prev_fy")
    misaligned = ~D.near(prior["period_start"], F.date_add("prev_fy_end", 1))
    composed = _composed(prev, F.col("prev_fy_restated"), prior, F.lit(False), F.col("prior2"))
    before = (
        F.when(F.col("ttm.state") != OK, F.col("ttm"))
        .when((F.col("basis") == "FY") & F.col("pair_prior").isNull(), missing("PRIOR_YEAR_NOT_IN_SAME_FILING"))
        .when(F.col("basis") == "FY", ok(F.col("pair_prior.value")))
        .when(F.col("prev_fy_end").isNull(), missing("PRIOR_FISCAL_YEAR_MISSING"))
        .when(misaligned, absent(NOT_COMPARABLE, "TTM_PERIODS_MISALIGNED"))
        .when(F.col("prior2").isNull(), missing("PRIOR_YEAR_YTD_MISSING"))
        .otherwise(composed)
    )
    return rows.withColumn("ttm_prior", before)


def _flagged_growth(now: Column, before: Column) -> Column:
    """Growth whose flag stays on the cell whether or not it has a value."""
    c = growth_rate(now, before)
    return cell(c["state"], c["value"], c["reason"], flag_array("TTM_COMPONENTS_FROM_SEVERAL_FILINGS"))


def ttm_growth(current: Column, prior: Column) -> Column:
    restated = F.exists(F.concat(current["flags"], prior["flags"]), lambda f: f.startswith("RESTATED"))
    return (
        F.when(current["state"] != OK, absent(current["state"], current["reason"]))
        .when(prior["state"] != OK, absent(prior["state"], prior["reason"]))
        .when(restated, absent(NOT_COMPARABLE, "RESTATED_COMPONENT"))
        .otherwise(_flagged_growth(current["value"], prior["value"]))
    )


def share_guard(eps: DataFrame, p: DataFrame) -> DataFrame:
    """Adds weighted share counts of the EPS periods and applies the split guard to the EPS TTM cell."""
    shares = (
        p.where((F.col("line") == "weighted_diluted_shares") & F.col("kind").isin(D.FISCAL_YEAR, *D.YTD_KINDS))
        .groupBy("cik", "period_start", "period_end")
        .agg(F.max(F.struct("filed", "accession", "value")).alias("s"))
        .select("cik", "period_start", "period_end", F.col("s.value").alias("shares"))
    )

    def at(name: str, point: str):
        return shares.select(
            "cik",
            F.col("period_start").alias(f"{point}_start"),
            F.col("period_end").alias(f"{point}_stop"),
            F.col("shares").alias(name),
        )

    rows = eps.withColumns(
        {
            "fy_start": F.col("fy.period_start"),
            "fy_stop": F.col("fy.period_end"),
            "cur_start": F.col("cur.period_start"),
            "cur_stop": F.col("cur.period_end"),
        }
    )
    rows = rows.join(at("fy_shares", "fy"), ["cik", "fy_start", "fy_stop"], "left").join(
        at("cur_shares", "cur"), ["cik", "cur_start", "cur_stop"], "left"
    )
    ratio = F.try_divide(F.col("cur_shares"), F.col("fy_shares"))
    t = F.col("ttm")
    guarded = (
        F.when((t["state"] != OK) | (F.col("basis") == "FY"), t)
        .when(ratio.isNull(), missing("SPLIT_GUARD_UNAVAILABLE"))
        .when(~ratio.between(*SHARE_RATIO_LIMITS), absent(NOT_COMPARABLE, "POSSIBLE_SPLIT_BASIS_CHANGE"))
        .otherwise(
            cell(t["state"], t["value"], t["reason"], F.concat(t["flags"], flag_array("PER_SHARE_SUM_OF_PERIODS")))
        )
    )
    return rows.withColumn("ttm", guarded).drop("fy_start", "fy_stop", "cur_start", "cur_stop")


def components(chosen: DataFrame) -> DataFrame:
    """Provenance of a TTM value: one row per fact used, with its role and sign."""

    def part(role: str, sign: int | None, point: str) -> Column:
        c = F.col(point)
        return F.when(
            c.isNotNull(),
            F.struct(
                F.lit(role).alias("role"),
                F.lit(sign).alias("sign"),
                c["value"].alias("value"),
                c["accession"].alias("accession"),
                c["form"].alias("form"),
                c["filed"].alias("filed"),
                c["period_start"].alias("period_start"),
                c["period_end"].alias("period_end"),
            ),
        )

    used = F.array_compact(
        F.array(part("fiscal_year", 1, "fy"), part("current_ytd", 1, "cur"), part("prior_year_ytd", -1, "prior"))
    )
    return (
        chosen.where(F.col("ttm.state") == OK)
        .select("cik", "line", "tag", "basis", F.explode(used).alias("c"))
        .select("cik", "line", "tag", "basis", "c.*")
    )
