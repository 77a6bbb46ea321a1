"""Three-valued threshold screens over wide listing rows.

Criteria are expressions over one row, so a screen adds no join, no shuffle and no
row multiplication to the plan that computes the metrics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cell import MISSING_INPUT, OK
from ..functions.text import CLASS_SUFFIX, unknown_if_na
from ..reference_data import METRIC, constant_frame

PASS, FAIL, UNEVALUABLE = "PASS", "FAIL", "UNEVALUABLE"
MATCH, NO_MATCH = "MATCH", "NO_MATCH"
# Bounds and tolerances of a screen.
MAX_CRITERIA = 20
MAX_SYMBOLS = 200
EQ_TOLERANCE = 1e-9
PERCENT = 0.01
OP_SYMBOL = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=="}


class ScreenError(ValueError):
    """The screen specification cannot be used."""


@dataclass(frozen=True)
class Criterion:
    metric: str
    op: str
    value: float | None = None
    low: float | None = None
    high: float | None = None
    unit: str = "native"
    label: str | None = None

    def bounds(self) -> tuple:
        """Thresholds in the metric's stored unit."""
        factor = PERCENT if self.unit == "percent" else 1.0
        return tuple(None if x is None else x * factor for x in (self.value, self.low, self.high))


@dataclass(frozen=True)
class Screen:
    criteria: tuple[Criterion, ...] = ()
    classification: dict | None = None
    symbols: tuple[str, ...] | None = None
    as_of: date | None = None
    name: str = "screen"


def _only(known: set, given: dict, what: str) -> None:
    unknown = set(given) - known
    if unknown:
        raise ScreenError(f"{what}: unknown fields {sorted(unknown)}")


def _symbol(raw: str) -> str:
    return re.sub(CLASS_SUFFIX, r"\1-\2", raw.strip().upper())


def _criterion(raw: dict) -> Criterion:
    _only({"metric", "op", "value", "low", "high", "unit", "label"}, raw, "criterion")
    if absent := {"metric", "op"} - set(raw):
        raise ScreenError(f"criterion: fields {sorted(absent)} are missing")
    c = Criterion(**raw)
    if c.metric not in METRIC:
        raise ScreenError(f"unknown metric {c.metric!r}")
    if c.op != "between" and c.op not in OP_SYMBOL:
        raise ScreenError(f"unknown op {c.op!r}")
    if any(x is not None and not math.isfinite(x) for x in (c.value, c.low, c.high)):
        raise ScreenError("thresholds must be finite")
    given = (c.value is not None, c.low is not None, c.high is not None)
    if given != ((False, True, True) if c.op == "between" else (True, False, False)):
        raise ScreenError(f"op {c.op!r}: wrong thresholds")
    if c.op == "between" and c.low > c.high:
        raise ScreenError("between: low is above high")
    fraction = METRIC[c.metric][2] == "fraction"
    if c.unit not in (("fraction", "percent") if fraction else ("native",)):
        raise ScreenError(f"{c.metric}: unit {c.unit!r} does not fit")
    return c


def _classification(raw: dict) -> dict:
    _only({"taxonomy", "sector", "industries", "exclude_industries", "sic_codes"}, raw, "classification")
    labels = any(raw.get(k) for k in ("sector", "industries", "exclude_industries"))
    codes = raw.get("sic_codes") or []
    if raw.get("taxonomy") == "nasdaq" and labels and not codes:
        return raw
    if raw.get("taxonomy") == "sec_sic" and codes and not labels:
        if all(c.isdigit() and 1 <= len(c) <= 4 for c in codes):
            return raw
    raise ScreenError("a classification filter names one taxonomy and only its own fields")


def parse_screen(spec: dict) -> Screen:
    """Checks a specification; anything unknown, ambiguous or impossible is refused."""
    _only({"name", "as_of", "universe", "classification", "criteria"}, spec, "screen")
    criteria = tuple(_criterion(c) for c in spec.get("criteria", []))
    classification = _classification(spec["classification"]) if spec.get("classification") else None
    if len(criteria) > MAX_CRITERIA or not (criteria or classification):
        raise ScreenError(f"a screen needs 1 to {MAX_CRITERIA} criteria or a classification filter")
    universe = spec.get("universe") or {}
    _only({"symbols"}, universe, "universe")
    symbols = universe.get("symbols")
    if symbols is not None and not 1 <= len(symbols) <= MAX_SYMBOLS:
        raise ScreenError(f"universe.symbols holds 1 to {MAX_SYMBOLS} symbols")
    as_of = spec.get("as_of")
    return Screen(
        criteria,
        classification,
        None if symbols is None else tuple(dict.fromkeys(map(_symbol, symbols))),
        date.fromisoformat(as_of) if isinstance(as_of, str) else as_of,
        spec.get("name", "screen"),
    )


def metrics_of(screen: Screen) -> tuple[str, ...]:
    """The metrics that a screen's criteria read, each once."""
    return tuple(dict.fromkeys(c.metric for c in screen.criteria))


# --- verdicts ------------------------------------------------------------------------------------------------------


def compare(op: str, x: Column, value=None, low=None, high=None) -> Column:
    if op == "between":
        return x.between(low, high)
    if op == "eq":
        return F.abs(x - value) <= EQ_TOLERANCE * max(1.0, abs(value))
    return {"gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value}[op]


def _condition(c: Criterion) -> str:
    value, low, high = c.bounds()
    return f"{c.metric} between {low} and {high} (inclusive)" if c.op == "between" else f"{c.metric} {OP_SYMBOL[c.op]} {value}"


def _outcome(metric, condition, result, state, value, reason, value_bound=None, low=None, high=None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(condition).alias("condition"),
        result.alias("result"),
        state.cast("string").alias("metric_state"),
        value.cast("double").alias("value"),
        reason.cast("string").alias("reason"),
        F.lit(value_bound).cast("double").alias("threshold"),
        F.lit(low).cast("double").alias("low"),
        F.lit(high).cast("double").alias("high"),
    )


def criterion_outcome(c: Criterion, columns) -> Column:
    """PASS, FAIL or UNEVALUABLE with what led to it. A metric that was not produced is unknown, not zero."""
    value, low, high = c.bounds()
    none = F.lit(None)
    if c.metric not in columns:
        return _outcome(c.metric, _condition(c), F.lit(UNEVALUABLE), F.lit(MISSING_INPUT), none,
                        F.lit("METRIC_NOT_PRODUCED"), value, low, high)
    m = F.col(c.metric)
    produced = m["state"].isNotNull()
    result = (
        F.when(~produced | (m["state"] != OK), UNEVALUABLE)
        .when(compare(c.op, m["value"], value, low, high), PASS)
        .otherwise(FAIL)
    )
    state = F.coalesce(m["state"], F.lit(MISSING_INPUT))
    reason = F.when(produced, m["reason"]).otherwise("METRIC_NOT_PRODUCED")
    return _outcome(c.metric, _condition(c), result, state, m["value"], reason, value, low, high)


def _label(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t != "", t)


def matches_nasdaq(sector: Column, industry: Column, *, want_sector=None, industries=(), exclude=()) -> Column:
    """TRUE, FALSE, or NULL where the label needed is unknown."""
    sector, industry = unknown_if_na(sector), unknown_if_na(industry)
    known = sector.isNotNull() | industry.isNotNull()
    verdict = F.when(~known, F.lit(None).cast("boolean"))
    if want_sector is not None:
        verdict = verdict.when(sector.isNull(), F.lit(None)).when(_label(sector) != want_sector.strip().lower(), False)
    if industries or exclude:
        verdict = verdict.when(industry.isNull(), F.lit(None))
        if industries:
            verdict = verdict.when(~_label(industry).isin(*[i.strip().lower() for i in industries]), False)
        if exclude:
            verdict = verdict.when(_label(industry).isin(*[i.strip().lower() for i in exclude]), False)
    return verdict.otherwise(True)


def sic_code(code: Column) -> Column:
    """Four-digit code; a longer one stays as it is, a blank one is unknown."""
    t = F.trim(code)
    return F.when(t != "", F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t))


def matches_sic(code: Column, codes) -> Column:
    return sic_code(code).isin(*[c.zfill(4) for c in codes])


def classification_outcome(flt: dict) -> Column:
    """One taxonomy only; an unknown classification is neither a match nor a failure."""
    if flt["taxonomy"] == "nasdaq":
        own = F.col("sector_source") == "nasdaq"
        verdict = F.when(
            own,
            matches_nasdaq(
                F.col("sector"), F.col("industry"), want_sector=flt.get("sector"),
                industries=flt.get("industries") or (), exclude=flt.get("exclude_industries") or (),
            ),
        )
    else:
        verdict = F.when(F.col("sic_source") == "sec", matches_sic(F.col("sic"), flt["sic_codes"]))
    result = F.when(verdict.isNull(), UNEVALUABLE).when(verdict, PASS).otherwise(FAIL)
    reason = F.when(verdict.isNull(), "CLASSIFICATION_NOT_AVAILABLE")
    return _outcome("classification", f"classification in {flt['taxonomy']}", result, F.lit(None), F.lit(None), reason)


def evaluate(views: DataFrame, screen: Screen) -> DataFrame:
    """Adds ``outcomes`` (one struct per condition, at most 21) to every listing row."""
    if screen.symbols is not None:
        views = views.where(F.col("ticker").isin(*screen.symbols))
    outcomes = [classification_outcome(screen.classification)] if screen.classification else []
    outcomes += [criterion_outcome(c, views.columns) for c in screen.criteria]
    return views.withColumn("outcomes", F.array(*outcomes))


def roll_up(evaluated: DataFrame) -> DataFrame:
    """Status per listing: any failure rejects it, else anything unknown leaves it open."""

    def number(result: str) -> Column:
        return F.size(F.filter("outcomes", lambda o: o["result"] == result))

    def listed(result: str, text) -> Column:
        return F.concat_ws("; ", F.transform(F.filter("outcomes", lambda o: o["result"] == result), text))

    counted = evaluated.withColumns(
        {
            "criteria_passed": number(PASS),
            "criteria_failed": number(FAIL),
            "criteria_unevaluable": number(UNEVALUABLE),
        }
    )
    failed, unknown = F.col("criteria_failed") > 0, F.col("criteria_unevaluable") > 0
    failure = listed(FAIL, lambda o: o["condition"])
    gap = listed(
        UNEVALUABLE,
        lambda o: F.concat(
            o["metric"],
            F.coalesce(F.concat(F.lit(" "), o["metric_state"]), F.lit("")),
            F.coalesce(F.concat(F.lit(" ("), o["reason"], F.lit(")")), F.lit("")),
        ),
    )
    return counted.withColumns(
        {
            "status": F.when(failed, NO_MATCH).when(unknown, UNEVALUABLE).otherwise(MATCH),
            "exclusion_reason": F.when(failed, F.concat(F.lit("FAILED: "), failure)).when(
                unknown, F.concat(F.lit("MISSING_DATA: "), gap)
            ),
        }
    )


SCREEN_COLUMNS = (
    "ticker", "cik", "security_id", "status", "exclusion_reason", "criteria_passed", "criteria_failed",
    "criteria_unevaluable",
)


def run_screen(views: DataFrame, screen: Screen) -> DataFrame:
    return roll_up(evaluate(views, screen)).select(*SCREEN_COLUMNS)


def criteria_rows(views: DataFrame, screen: Screen) -> DataFrame:
    """One row per listing and condition."""
    return evaluate(views, screen).select("ticker", "cik", F.explode("outcomes").alias("o")).select("ticker", "cik", "o.*")


def counts(screened: DataFrame) -> DataFrame:
    """Listings per status, states without listings included."""
    return screened.agg(
        F.count("*").alias("screened"),
        *[
            F.count_if(F.col("status") == s).alias(name)
            for s, name in ((MATCH, "matches"), (NO_MATCH, "failed"), (UNEVALUABLE, "missing_data_exclusions"))
        ],
    )


# --- many screens as a table ---------------------------------------------------------------------------------------

_SPEC = "criteria ARRAY<STRUCT<metric STRING, op STRING, value DOUBLE, low DOUBLE, high DOUBLE, unit STRING>>"


def criteria_table(specs: DataFrame) -> DataFrame:
    """Criteria of screens given as JSON text (``screen``, ``spec``): one row per criterion, thresholds in the metric's stored unit.

    ``problem`` says why a criterion cannot be used; a text without criteria is one row with a problem. The text may come from files.
    """
    parsed = specs.select("screen", F.from_json("spec", _SPEC)["criteria"].alias("criteria"))
    rows = parsed.select("screen", F.size(F.coalesce("criteria", F.array())).alias("n"), F.posexplode_outer("criteria").alias("position", "c"))
    units = constant_frame(specs.sparkSession, [(m, row[2] == "fraction") for m, row in METRIC.items()], "metric, fraction")
    rows = rows.select("screen", "n", "position", "c.*").join(F.broadcast(units), "metric", "left")
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    between = F.col("op") == "between"
    one, two = value.isNotNull() & low.isNull() & high.isNull(), value.isNull() & low.isNotNull() & high.isNotNull()
    finite = [c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf"))) for c in (value, low, high)]
    fits = F.when(F.col("fraction"), F.col("unit").isin("fraction", "percent")).otherwise(F.col("unit").isNull() | (F.col("unit") == "native"))
    problem = (
        F.when(F.col("n") == 0, "NO_CRITERIA")
        .when(F.col("n") > MAX_CRITERIA, "TOO_MANY_CRITERIA")
        .when(F.col("fraction").isNull(), "UNKNOWN_METRIC")
        .when(F.col("op").isNull() | ~F.col("op").isin("between", *OP_SYMBOL), "UNKNOWN_OP")
        .when(~F.when(between, two & (low <= high)).otherwise(one) | ~(finite[0] & finite[1] & finite[2]), "WRONG_THRESHOLDS")
        .when(~F.coalesce(fits, F.lit(False)), "WRONG_UNIT")
    )
    factor = F.when(F.col("unit") == "percent", PERCENT).otherwise(1.0)
    return rows.select("screen", "position", "metric", "op", *[(c * factor).alias(n) for n, c in (("value", value), ("low", low), ("high", high))], problem.alias("problem"))


def refused(criteria: DataFrame) -> DataFrame:
    """Screens that cannot be run, with their problems."""
    return criteria.where("problem IS NOT NULL").groupBy("screen").agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def run_screens(long: DataFrame, criteria: DataFrame) -> DataFrame:
    """Status and counts per screen and listing, from metrics as rows (ticker, cik, security_id, metric, state, value).

    A screen with a problem is refused as a whole. Metrics meet criteria by name, so a listing's row is only copied to the criteria that read it.
    """
    usable_ones = criteria.join(refused(criteria).select("screen"), "screen", "left_anti").drop("problem")
    x, value = F.col("x"), F.col("value")
    met = long.withColumnRenamed("value", "x").join(usable_ones, "metric")
    holds = (
        F.when(F.col("op") == "between", x.between(F.col("low"), F.col("high")))
        .when(F.col("op") == "eq", F.abs(x - value) <= EQ_TOLERANCE * F.greatest(F.lit(1.0), F.abs(value)))
        .when(F.col("op") == "gt", x > value)
        .when(F.col("op") == "gte", x >= value)
        .when(F.col("op") == "lt", x < value)
        .when(F.col("op") == "lte", x <= value)
    )
    result = F.when(F.col("state").isNull() | (F.col("state") != OK), UNEVALUABLE).when(holds, PASS).otherwise(FAIL)
    told = met.withColumn("result", result).groupBy("screen", "security_id", "ticker", "cik").agg(
        *[F.count_if(F.col("result") == r).alias(n) for r, n in ((PASS, "criteria_passed"), (FAIL, "criteria_failed"), (UNEVALUABLE, "criteria_unevaluable"))]
    )
    status = F.when(F.col("criteria_failed") > 0, NO_MATCH).when(F.col("criteria_unevaluable") > 0, UNEVALUABLE).otherwise(MATCH)
    return told.withColumn("status", status)
