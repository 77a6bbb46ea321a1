"""Accounting lines from as-reported facts: vintages, tag choice, same-filing pairs.

A fact is one concept, period and filing. The fact table is first reduced to one
row per distinct period (``periods``): a map-side aggregate whose shuffle key
holds issuer, tag and period, so an issuer with very many filings is still spread.
What is left per issuer is bounded by the calendar, not by the number of filings,
and the per-issuer windows below only ever see that reduced table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..reference_data import CONCEPTS, FLOW_LINES, SHEET_LINES, concept_frame

# Fixed value: relative difference above which two tags of one line contradict each other.
TAG_CONFLICT_TOLERANCE = 0.01

PERIOD_KEY = ["cik", "line", "tag", "priority", "kind", "period_start", "period_end"]


def line_facts(facts: DataFrame, *, lines=None, as_of=None) -> DataFrame:
    """Facts of the known concepts with their line, tag priority and period kind.

    ``as_of`` keeps only what had been filed by that date.
    """
    wanted = CONCEPTS if lines is None else {line: CONCEPTS[line] for line in lines}
    concepts = concept_frame(facts.sparkSession, wanted)
    # the tags are also given as a plain list, which reaches the scan
    tags = [tag for _, names, _, _ in wanted.values() for tag in names]
    rows = facts.where(F.col("accession_no").isNotNull() & F.col("filed_date").isNotNull() & F.col("concept").isin(*tags))
    if as_of is not None:
        rows = rows.where(F.col("filed_date") <= F.lit(as_of).cast("date"))
    return rows.join(
        F.broadcast(concepts.withColumnRenamed("tag", "concept")), ["taxonomy", "concept", "unit"]
    ).select(
        "cik",
        "line",
        F.col("concept").alias("tag"),
        "priority",
        D.period_kind(F.col("period_start"), F.col("period_end")).alias("kind"),
        "period_start",
        "period_end",
        F.col("filed_date").alias("filed"),
        F.col("accession_no").alias("accession"),
        "form",
        "fiscal_year",
        F.col("value").cast("double").alias("value"),
    )


def latest_known(lf: DataFrame, keys=None) -> DataFrame:
    """Per period the most recently filed value (ties: highest accession)."""
    keys = keys or PERIOD_KEY
    return (
        lf.groupBy(*keys)
        .agg(F.max(F.struct("filed", "accession", "value", "form")).alias("latest"))
        .select(*keys, "latest.*")
    )


def vintages(lf: DataFrame) -> DataFrame:
    """The history of what was known of each period: one row per filing day, valid from it until the next one (NULL: still)."""
    by_day = lf.groupBy(*PERIOD_KEY, "filed").agg(F.max(F.struct("accession", "value", "form")).alias("v"))
    # a period has as many vintages as days on which it was filed
    until = F.lead("filed").over(Window.partitionBy("cik", "tag", "period_start", "period_end").orderBy("filed"))
    return by_day.select(*PERIOD_KEY, F.col("filed").alias("valid_from"), until.alias("valid_to"), "v.accession", "v.value", "v.form")


def known_at(history: DataFrame, dates) -> DataFrame:
    """What was known at each of some dates: a vintage is copied to the dates in its interval, so any number of dates costs one plan and no join."""
    days = F.array(*[F.lit(str(d)).cast("date") for d in dates])
    inside = F.filter(days, lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    return history.select(F.explode(F.array_distinct(inside)).alias("as_of"), *[c for c in history.columns if c != "valid_to"])


def periods(lf: DataFrame) -> DataFrame:
    """One row per distinct period of a tag: its latest vintage and the range of values ever reported."""
    lines = concept_frame(lf.sparkSession).select("line", "tag", "priority")
    reduced = (
        lf.groupBy("cik", "tag", "period_start", "period_end")
        .agg(
            F.max(F.struct("filed", "accession", "value", "form")).alias("latest"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.min(
                F.when(F.coalesce(F.col("fiscal_year"), F.lit(0)) != 0, F.struct("filed", "accession", "fiscal_year"))
            ).alias("first_label"),
        )
        .select("cik", "tag", "period_start", "period_end", "latest.*", "low", "high", "first_label")
    )
    # line, priority and kind follow from the key, so they are added after the shuffle
    kind = D.period_kind(F.col("period_start"), F.col("period_end"))
    return reduced.join(F.broadcast(lines), "tag").select(
        "cik", "line", "tag", "priority", kind.alias("kind"), "period_start", "period_end", "filed", "accession", "value",
        "form", "low", "high", "first_label",
    )


def restated_periods(p: DataFrame) -> DataFrame:
    """Periods for which filings disagree."""
    return p.where(F.col("low") != F.col("high"))


def latest_end(p: DataFrame, kinds) -> DataFrame:
    return p.where(F.col("kind").isin(*kinds)).groupBy("cik", "line").agg(F.max("period_end").alias("latest_end"))


def fiscal_year_labels(p: DataFrame) -> DataFrame:
    """Fiscal-year label of an annual period: the one its earliest filing gave it."""
    return (
        p.where((F.col("kind") == D.FISCAL_YEAR) & F.col("first_label").isNotNull())
        .groupBy("cik", "line", "period_end")
        .agg(F.min("first_label").alias("label"))
        .select("cik", "line", "period_end", F.col("label.fiscal_year").alias("fiscal_year"))
    )


def fiscal_year_coverage(p: DataFrame, lines) -> DataFrame:
    """Number of distinct fiscal-year ends per issuer, one column per line."""
    annual = p.where((F.col("kind") == D.FISCAL_YEAR) & F.col("line").isin(*lines))
    distinct = annual.groupBy("cik", "line", "period_end").agg(F.lit(1).alias("n"))
    return distinct.groupBy("cik").agg(
        *[F.coalesce(F.sum(F.when(F.col("line") == line, F.col("n"))), F.lit(0)).alias(line) for line in lines]
    )


# --- tag choice ------------------------------------------------------------------------------------------------

_POINT = ("filed", "accession", "value", "form", "period_start", "period_end")


def choose_tag(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One selection per ``keys`` from one row per candidate tag.

    The first tag by priority wins. A later tag that differs by more than the
    tolerance makes the line unreliable; one that agrees is named as a confirmation.
    A line has at most four candidate tags, which bounds the array.
    """
    picked = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("priority", "tag", "restated", *_POINT))).alias("tags")
    )
    best = F.col("tags")[0]
    others = F.slice(F.col("tags"), 2, F.greatest(F.size("tags") - 1, F.lit(0)))

    def contradicts(o: Column) -> Column:
        scale = F.greatest(F.abs(best["value"]), F.abs(o["value"]))
        return (scale > 0) & (F.try_divide(F.abs(best["value"] - o["value"]), scale) > TAG_CONFLICT_TOLERANCE)

    conflict = F.get(F.filter(others, contradicts), F.lit(0))
    problem = F.when(
        conflict.isNotNull(), F.concat(F.lit("TAG_CONFLICT:"), best["tag"], F.lit("!="), conflict["tag"])
    )
    flags = F.concat(
        F.transform(others, lambda o: F.concat(F.lit("CONFIRMED_BY:"), o["tag"])),
        F.when(best["restated"], F.array(F.lit("RESTATED_PERIOD"))).otherwise(F.array().cast("array<string>")),
    )
    reliable = problem.isNull()
    return picked.select(
        *keys,
        F.struct(
            F.when(reliable, best["value"]).alias("value"),
            F.when(reliable, best["tag"]).alias("tag"),
            F.when(reliable, best["accession"]).alias("accession"),
            F.when(reliable, best["form"]).alias("form"),
            F.when(reliable, best["filed"]).alias("filed"),
            F.when(reliable, best["period_start"]).alias("period_start"),
            F.when(reliable, best["period_end"]).alias("period_end"),
            F.when(reliable, flags).otherwise(F.array().cast("array<string>")).alias("flags"),
            problem.alias("problem"),
        ).alias("sel"),
    )


def per_tag(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest vintage per tag over the periods in ``rows`` and whether their values ever differed."""
    return (
        rows.groupBy(*keys, "tag", "priority")
        .agg(F.max(F.struct(*_POINT)).alias("p"), (F.min("low") != F.max("high")).alias("restated"))
        .select(*keys, "tag", "priority", "restated", "p.*")
    )


def select_periods(p: DataFrame) -> DataFrame:
    """Line selection for every (issuer, line, end, kind): value, tag, filing, flags or problem."""
    keys = ["cik", "line", "kind", "period_end_key"]
    rows = p.withColumn("period_end_key", F.col("period_end"))
    return choose_tag(per_tag(rows, keys), keys).withColumnRenamed("period_end_key", "end")


def with_anchors(p: DataFrame) -> DataFrame:
    """Adds each issuer's fiscal-year end and balance-sheet date to its periods."""
    issuer = Window.partitionBy("cik")

    def latest(line: str, kind: str) -> Column:
        return F.max(F.when((F.col("line") == line) & (F.col("kind") == kind), F.col("period_end"))).over(issuer)

    return p.withColumns(
        {
            "_rev": latest("revenue", D.FISCAL_YEAR),
            "_ni": latest("net_income_to_common", D.FISCAL_YEAR),
            "_cash": latest("cash", D.INSTANT),
            "_eq": latest("equity", D.INSTANT),
        }
    ).select(
        *p.columns,
        F.coalesce("_rev", "_ni").alias("fy_end"),
        F.greatest("_cash", "_eq").alias("sheet_end"),
    )


def selected_lines(anchored: DataFrame, lines=(*FLOW_LINES, *SHEET_LINES)) -> DataFrame:
    """Long (issuer, line) selections: flow lines at the fiscal-year end, instants at the balance-sheet date."""
    anchored = anchored.where(F.col("line").isin(*lines))
    annual = F.col("line").isin(*FLOW_LINES) & (F.col("kind") == D.FISCAL_YEAR) & (F.col("period_end") == F.col("fy_end"))
    sheet = (
        F.col("line").isin(*SHEET_LINES) & (F.col("kind") == D.INSTANT) & (F.col("period_end") == F.col("sheet_end"))
    )
    keys = ["cik", "fy_end", "sheet_end", "line"]
    return choose_tag(per_tag(anchored.where(annual | sheet), keys), keys)


def pivot_lines(long: DataFrame, lines, keys=("cik",), value: str = "sel", prefix: str = "") -> DataFrame:
    """One row per issuer, one struct column per line."""
    return long.groupBy(*keys).agg(
        *[F.expr(f"first(CASE WHEN line = '{line}' THEN {value} END, true) AS {prefix}{line}") for line in lines]
    )


# --- values of two years from one filing -------------------------------------------------------------------------


def pair_anchors(anchored: DataFrame, lines=FLOW_LINES) -> DataFrame:
    """Per tag: the issuer's fiscal-year end and the latest annual end one year before it."""
    return (
        anchored.where((F.col("kind") == D.FISCAL_YEAR) & F.col("line").isin(*lines) & F.col("fy_end").isNotNull())
        .groupBy("cik", "line", "tag", "fy_end")
        .agg(
            F.max(F.when(D.years_apart(F.col("fy_end"), F.col("period_end")), F.col("period_end"))).alias("prior_end"),
            F.max(F.col("period_end") == F.col("fy_end")).alias("has_now"),
        )
        .where(F.col("has_now") & F.col("prior_end").isNotNull())
        .drop("has_now")
    )


def tag_pairs(lf: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per tag the newest filing that reports both years, with both values.

    Only rows of the two wanted periods survive the join, before anything is grouped by filing.
    """
    point = F.struct("filed", "period_start", "value", "form", "period_end", "accession")
    rows = lf.where(F.col("kind") == D.FISCAL_YEAR).join(anchors, ["cik", "line", "tag"])
    rows = rows.where(F.col("period_end").isin(F.col("fy_end"), F.col("prior_end")))
    by_filing = (
        rows.groupBy("cik", "line", "tag", "priority", "accession")
        .agg(
            F.max(F.when(F.col("period_end") == F.col("fy_end"), point)).alias("now"),
            F.max(F.when(F.col("period_end") == F.col("prior_end"), point)).alias("prior"),
        )
        .where(F.col("now").isNotNull() & F.col("prior").isNotNull())
    )
    return (
        by_filing.groupBy("cik", "line", "tag", "priority")
        .agg(F.max(F.struct(F.col("now.filed").alias("filed"), "accession", "now", "prior")).alias("best"))
        .select("cik", "line", "tag", "priority", F.col("best.now").alias("now"), F.col("best.prior").alias("prior"))
    )


def annual_pairs(by_tag: DataFrame) -> DataFrame:
    """Per line the pair of the first tag by priority that has one."""
    return (
        by_tag.groupBy("cik", "line")
        .agg(F.min(F.struct("priority", "tag", "now", "prior")).alias("pair"))
        .select("cik", "line", F.struct("pair.tag", "pair.now", "pair.prior").alias("pair"))
    )


# --- share count -------------------------------------------------------------------------------------------------

# Fixed value: a cover-page share count older than this is stale.
STALE_SHARES_DAYS = 400


def share_counts(lf: DataFrame) -> DataFrame:
    """Per issuer: newest cover-page date, and the range of counts in its newest filings."""
    by_filing = (
        lf.where(F.col("line") == "shares_outstanding")
        .groupBy("cik", "period_end", "filed")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
    )
    return (
        by_filing.groupBy("cik")
        .agg(F.max(F.struct("period_end", "filed", "low", "high")).alias("s"))
        .select("cik", F.col("s.period_end").alias("shares_end"), F.col("s.low").alias("shares_low"),
                F.col("s.high").alias("shares_high"))
    )
