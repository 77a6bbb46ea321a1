"""Data-quality counts, run statistics, acceptance criteria and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CIK_PATTERN
from ..reference_data import (
    CRITERIA,
    DEFERRED_COMPONENTS,
    HANDLED_ISSUE_KINDS,
    MAX_REQUESTS_PER_SECOND,
    NON_BLOCKING,
    NOT_INDUSTRIAL_ROLES,
    STATIC_LIMITATIONS,
    WARNING_CATEGORIES,
    constant_frame,
)

PASS, FAIL, PARTIAL = "PASS", "FAIL", "PARTIAL"
NOT_EVALUABLE, DEFERRED, EXPECTED_UNSUPPORTED = "NOT_EVALUABLE", "DEFERRED", "EXPECTED_UNSUPPORTED"


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- integrity -----------------------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: list, name: str) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Many counts in one pass, one row per check."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks])
    return one.select(F.inline(pairs))


def _bad_cik(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(CIK_PATTERN)


def _not_finite(*cols: str) -> Column:
    def one(c: str) -> Column:
        x = F.col(c)
        return F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(False))

    return reduce(lambda a, b: a | b, map(one, cols))


def integrity_report(securities, facts, bars, quotes, filings, sources) -> DataFrame:
    """Rule violations, every count 0 for clean tables. One pass per table plus one per duplicate check."""
    c = F.col
    bad_bar = (c("close") <= 0) | (c("high") < c("low")) | (c("close") > c("high") * 1.0001) | (c("close") < c("low") * 0.9999)
    parts = [
        duplicate_keys(securities, ["ticker", F.coalesce("cik", F.lit(""))], "duplicate_securities"),
        duplicate_keys(bars, ["security_id", "trade_date"], "duplicate_price_keys"),
        duplicate_keys(
            facts, ["cik", "taxonomy", "concept", "unit", "period_start", "period_end", "accession_no"],
            "duplicate_fact_keys",
        ),
        duplicate_keys(filings, ["accession_no"], "duplicate_filings"),
        duplicate_keys(quotes, ["security_id", "quote_date"], "duplicate_quote_keys"),
        violations(
            bars,
            {
                "prices_without_source": c("source_id").isNull(),
                "non_finite_prices": _not_finite("open", "high", "low", "close"),
                "bad_price_rows": bad_bar,
                "adjusted_close_populated": c("adj_close").isNotNull(),
            },
        ),
        violations(
            facts,
            {
                "facts_without_source": c("source_id").isNull(),
                "facts_without_accession_filed_or_form": c("accession_no").isNull() | c("filed_date").isNull() | c("form").isNull(),
                "non_finite_facts": _not_finite("value"),
                "_ciks": _bad_cik(c("cik")),
            },
        ),
        violations(filings, {"filings_without_source": c("source_id").isNull(), "_ciks": _bad_cik(c("cik"))}),
        violations(quotes, {"quotes_without_source": c("source_id").isNull()}),
        violations(
            securities,
            {
                "classification_without_source": ((c("sector").isNotNull() | c("industry").isNotNull()) & c("sector_source").isNull())
                | (c("sic").isNotNull() & c("sic_source").isNull()),
                "securities_without_cik": c("cik").isNull(),
                "_ciks": _bad_cik(c("cik")),
            },
        ),
        violations(
            sources,
            {
                "sources_missing_command_or_parameters": c("command").isNull() | c("parameters").isNull(),
                "sources_missing_content_hash": c("content_hash").isNull(),
            },
        ),
    ]
    name = F.when(c("check_name") == "_ciks", "unnormalised_ciks").otherwise(c("check_name"))
    return union_all(parts).groupBy(name.alias("check_name")).agg(F.sum("violations").alias("violations"))


# --- requests ------------------------------------------------------------------------------------------------------


def request_peak(requests: DataFrame, provider: str = "provider", ts: str = "ts") -> DataFrame:
    """Most requests of a provider in any one-second window.

    Requests are counted per instant, and each count goes to its own second and the next one.
    A window then spans one provider and second, so a provider with very many requests is spread.
    """
    instant = requests.groupBy(provider, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).agg(F.count("*").alias("n"))
    second = F.floor(F.col("us") / 1_000_000)
    placed = instant.select(provider, "us", "n", F.explode(F.array(second, second + 1)).alias("slot")).withColumn(
        "own", F.col("slot") == second
    )
    w = Window.partitionBy(provider, "slot").orderBy("us").rangeBetween(-999_999, 0)
    rolling = placed.withColumn("in_window", F.sum("n").over(w))
    return rolling.where("own").groupBy(provider).agg(F.max("in_window").alias("peak_per_second"))


def request_statistics(requests: DataFrame, provider: str = "provider", ts: str = "ts", status: str = "status") -> DataFrame:
    """Totals, rate and blocked requests per provider."""
    span = (F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / 1_000_000
    return requests.groupBy(provider).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col(status) == "403").alias("http_403"),
        F.count_if(F.col(status) == "429").alias("http_429"),
        F.try_divide(F.count("*").cast("double"), span).alias("per_second"),
    )


# --- run outcomes ----------------------------------------------------------------------------------------------------


def outcome_group() -> Column:
    """succeeded / expected_unsupported / failed from the stage results of one security."""
    core = F.col("identity") & F.col("price") & F.col("quote")
    return (
        F.when(core & F.col("facts"), "succeeded")
        .when(core & (F.col("facts_status") == "UNSUPPORTED_TAXONOMY"), "expected_unsupported")
        .otherwise("failed")
    )


def run_rates(outcomes: DataFrame) -> DataFrame:
    """Success rates with their own denominators; unsupported issuers are left out of the fact rate."""
    known = F.col("identity")
    unsupported = known & (F.col("facts_status") == "UNSUPPORTED_TAXONOMY")

    def ratio(n: Column, d: Column) -> Column:
        return F.try_divide(n.cast("double"), d.cast("double"))

    return outcomes.agg(
        F.count("*").alias("attempted"),
        F.count_if(known).alias("identified"),
        ratio(F.count_if(known), F.count("*")).alias("identity_rate"),
        ratio(F.count_if(F.col("cik").isNotNull()), F.count("*")).alias("cik_rate"),
        ratio(F.count_if(known & F.col("price")), F.count_if(known)).alias("price_rate"),
        ratio(F.count_if(known & F.col("quote")), F.count_if(known)).alias("quote_rate"),
        ratio(
            F.count_if(known & F.coalesce(F.col("facts"), F.lit(False))),
            F.count_if(known) - F.count_if(unsupported),
        ).alias("fact_rate"),
    )


def multi_class(securities: DataFrame) -> DataFrame:
    """Listings of issuers that have more than one, as rows."""
    listed = securities.where(F.col("cik").isNotNull())
    many = listed.groupBy("cik").agg(F.count("*").alias("listings")).where(F.col("listings") > 1)
    return listed.join(many, "cik").select("cik", "ticker", "listings")


def industrial_issuers(listing_roles: DataFrame) -> DataFrame:
    """Issuers none of whose listings has an excluded role."""
    excluded = F.arrays_overlap("roles", F.array(*[F.lit(r) for r in NOT_INDUSTRIAL_ROLES]))
    return listing_roles.groupBy("cik").agg(F.max(F.coalesce(excluded, F.lit(False))).alias("x")).where(~F.col("x")).select("cik")


def role_coverage(listing_roles: DataFrame) -> DataFrame:
    return listing_roles.select(F.explode("roles").alias("role"), "ticker").distinct()


def missing_core(cells: DataFrame, lines) -> DataFrame:
    """Core cells, missing ones and their share; ``cells`` has one selection struct per line."""
    gaps = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{ln}.value").isNull(), F.lit(True)).cast("bigint") for ln in lines])
    return cells.agg(
        (F.count("*") * len(lines)).alias("cells"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing")
    ).withColumn("missing_rate", F.try_divide(F.col("missing").cast("double"), F.col("cells").cast("double")))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Content hash of a whole table that does not depend on row order.

    Row hashes are added up word by word, so partial sums merge and nothing is collected. Values carry their length in bytes, and NULL is '-',
    so that no two different rows read alike.
    """
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in values])
    row_hash = F.sha2(text, 256)
    hashed = rows.select(row_hash.alias("h"))
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(28,0)") for i in range(8)]
    sums = hashed.agg(*[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)], F.count("*").alias("rows"))
    joined = F.concat_ws("|", *[F.col(f"w{i}").cast("string") for i in range(8)], F.col("rows").cast("string"))
    return sums.select(F.sha2(joined, 256).alias("digest"), "rows")


def warnings(parts: list[DataFrame]) -> DataFrame:
    """Warning rows of all stages: category, security, provider, stage, detail."""
    return union_all([p.select("category", "security_id", "provider", "stage", "detail") for p in parts])


def uncategorised(warning_rows: DataFrame) -> DataFrame:
    known = constant_frame(warning_rows.sparkSession, [(c,) for c in WARNING_CATEGORIES], "category")
    return warning_rows.join(F.broadcast(known), "category", "left_anti")


def unhandled_kinds(issues: DataFrame) -> DataFrame:
    known = constant_frame(issues.sparkSession, [(k,) for k in HANDLED_ISSUE_KINDS], "kind")
    return issues.select("kind").distinct().join(F.broadcast(known), "kind", "left_anti")


def known_limitations(coverage: DataFrame) -> DataFrame:
    """Unsupported issuers and the fixed limitations."""
    fixed = constant_frame(coverage.sparkSession, STATIC_LIMITATIONS, "id, affects")
    return coverage.select(
        F.concat(F.lit("UNSUPPORTED_TAXONOMY:"), "cik").alias("id"), F.lit("fundamental screens").alias("affects")
    ).unionByName(fixed)


# --- acceptance ----------------------------------------------------------------------------------------------------


def component_status(ok: Column, deferred: Column | bool = False, unsupported: Column | bool = False) -> Column:
    """A three-valued check: TRUE passes, FALSE fails, NULL was not measured."""
    deferred = deferred if isinstance(deferred, Column) else F.lit(deferred)
    unsupported = unsupported if isinstance(unsupported, Column) else F.lit(unsupported)
    return (
        F.when(ok, PASS)
        .when(~ok, FAIL)
        .when(unsupported, EXPECTED_UNSUPPORTED)
        .when(deferred, DEFERRED)
        .otherwise(NOT_EVALUABLE)
    )


def criterion_status(components: DataFrame) -> DataFrame:
    """Status per criterion, derived from all its components."""
    s = F.col("status")
    n = F.count("*")
    passed, unsupported = F.count_if(s == PASS), F.count_if(s == EXPECTED_UNSUPPORTED)
    status = (
        F.when(F.count_if(s == FAIL) > 0, FAIL)
        .when(passed == n, PASS)
        .when(unsupported == n, EXPECTED_UNSUPPORTED)
        .when(passed > 0, PARTIAL)
        .when(F.count_if(s == DEFERRED) > 0, DEFERRED)
        .otherwise(NOT_EVALUABLE)
    )
    return components.groupBy("criterion").agg(status.alias("status"), n.alias("components"), passed.alias("passed"))


# Thresholds: how each measured component follows from the named measures (fixed values).
def _measured(m) -> dict[str, Column]:
    def zero(name: str) -> Column:
        return m(name) == 0

    def at_least(n: str, d: str, share: float) -> Column:
        return F.when(m(d) > 0, F.try_divide(m(n), m(d)) >= share)

    return {
        "identity_rate": at_least("identified", "attempted", 0.99),
        "ambiguous_tickers": zero("ambiguous"),
        "round_trip": zero("ticker_mismatches") & (m("identified") > 0),
        "unnormalised_ciks": zero("unnormalised_ciks"),
        "price_coverage": at_least("covered", "priced", 0.98),
        "duplicate_price_keys": zero("duplicate_price_keys"),
        "gaps_over_5_business_days": zero("gaps"),
        "split_rebase_no_false_positive": zero("rerun_rebases"),
        "industrial_four_fiscal_years": at_least("four_years", "industrial", 0.95),
        "core_fields_missing": F.when(m("core_cells") > 0, F.try_divide(m("core_missing"), m("core_cells")) <= 0.05),
        "zero_debt_without_evidence": zero("unevidenced_zero_debt"),
        "non_finite_stored": (m("non_finite_prices") + m("non_finite_facts")) == 0,
        "duplicates_after_run1": zero("duplicates_run1"),
        "duplicates_after_run2": zero("duplicates_run2"),
        "sec_sustained_rate": m("peak_per_second") <= MAX_REQUESTS_PER_SECOND,
        "requests_per_security_recorded": F.coalesce(m("requests") > 0, F.lit(False)),
        "failing_request_rate": F.when(m("requests") > 0, m("failed_requests") <= 0.01 * m("requests")),
        "sec_403_429": (m("http_403") + m("http_429")) == 0,
        "failure_classes_handled": zero("unhandled_kinds"),
        "warnings_categorised": zero("uncategorised_warnings"),
        "warnings_attributable": zero("unattributed_warnings"),
        "no_manual_intervention": zero("fatal"),
        "per_security_p95_recorded": F.coalesce(m("p95_seconds").isNotNull(), F.lit(False)),
        "rerun_inserts_nothing": (m("rerun_inserted") + m("rerun_updated")) == 0,
        "week52_high_vs_nasdaq": at_least("high_within", "high_compared", 0.95),
        "market_cap_vs_close_x_shares": at_least("cap_within", "cap_eligible", 0.90),
        "rows_carry_source_id": zero("rows_without_source"),
        "sec_facts_carry_accession_filed_form": zero("facts_without_accession_filed_or_form"),
        "classification_has_source": (
            m("classification_without_source") + m("sources_missing_command_or_parameters") + m("sources_missing_content_hash")
        ) == 0,
    }


def acceptance_components(measures: DataFrame) -> DataFrame:
    """All required components from measure rows (name, value). A measure that was not taken stays open."""
    # one map of a few dozen named measures
    row = measures.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("double")))).alias("m"))
    measured = _measured(lambda name: F.try_element_at(F.col("m"), F.lit(name)))
    never = F.lit(None).cast("boolean")
    rows = [
        F.struct(
            F.lit(criterion).alias("criterion"),
            F.lit(name).alias("component"),
            component_status(measured.get(name, never), name in DEFERRED_COMPONENTS).alias("status"),
        )
        for criterion, names in CRITERIA.items()
        for name in names
    ]
    return row.select(F.inline(F.array(*rows)))


def overall_verdict(criteria: DataFrame, *, fatal: str | None = None, failures: int = 0) -> DataFrame:
    """Execution x acceptance as one row."""
    if fatal:
        execution = "ABORTED" if fatal in ("DATABASE_ERROR", "DATABASE_LOCKED") else "DID_NOT_RUN"
    else:
        execution = "COMPLETED_WITH_FAILURES" if failures else "COMPLETED"
    failed = F.count_if(F.col("status") == FAIL)
    open_ = F.count_if(F.col("status") != PASS)
    if execution == "DID_NOT_RUN":
        acceptance: Column = F.lit("NOT_RUN")
    else:
        acceptance = F.when(failed > 0, "FAILED").when(open_ > 0, "INCOMPLETE").otherwise("ACCEPTED")
    out = criteria.agg(
        F.lit(execution).alias("execution"), acceptance.alias("acceptance"), failed.alias("failed"), open_.alias("not_passed")
    )
    a = F.col("acceptance")
    overall = F.when(a == "NOT_RUN", a).when((F.col("execution") != "COMPLETED") | (a == "FAILED"), "FAILED").otherwise(a)
    return out.withColumn("overall", overall)


def policy_frame(spark: SparkSession) -> DataFrame:
    return constant_frame(spark, [(c, n, d, False) for c, n, d in NON_BLOCKING], "criterion, component, deferred_to, blocks_entry")


def gate_components(components: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Components that did not pass, each blocking or deferred. Without a policy it blocks."""
    policies = policy_frame(components.sparkSession) if policies is None else policies
    open_ = components.where(F.col("status") != PASS).join(F.broadcast(policies), ["criterion", "component"], "left")
    blocks = (F.col("status") == FAIL) | F.coalesce(F.col("blocks_entry"), F.lit(True))
    return open_.select("criterion", "component", "status", "deferred_to", blocks.alias("blocks"))


def run_blockers(measures: DataFrame) -> DataFrame:
    """One row (``fact``, ``blocks``) for each fact of the run that the gate asks for, from measure rows (name, value).

    A run must be completed, without failures and integrity violations, against live providers, with its tests passed. A fact that was not
    measured blocks.
    """
    named = dict(measures.dtypes)["value"]
    wanted = {"completed": 1, "failures": 0, "live": 1, "integrity_violations": 0, "tests_passed": 1}
    held = [F.max(F.when(F.col("name") == name, F.col("value"))).cast(named).alias(name) for name in wanted]
    rows = [F.struct(F.lit(name).alias("fact"), F.coalesce(F.col(name) != want, F.lit(True)).alias("blocks")) for name, want in wanted.items()]
    return measures.agg(*held).select(F.inline(F.array(*rows)))


def progression_gate(gated: DataFrame, run: DataFrame) -> DataFrame:
    """OPEN only if nothing blocks: every component and every fact of the run (``run_blockers``)."""
    rows = gated.select("blocks", F.lit(True).alias("component")).unionAll(run.select("blocks", F.lit(False)))
    blocks, component = F.col("blocks"), F.col("component")
    return rows.agg(
        F.when(F.count_if(blocks) > 0, "CLOSED").otherwise("OPEN").alias("gate"),
        F.count_if(blocks & ~component).alias("run_blockers"),
        F.count_if(blocks & component).alias("component_blockers"),
        F.count_if(~blocks & component).alias("deferred"),
    )
