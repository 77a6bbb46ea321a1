"""Screens, upserts, hot keys, documents, quality gates, evidence and streams."""

import datetime as dt
import itertools
import json
import random

import pytest
from helpers import as_dict, d, one
from pyspark.sql import functions as F

from filigree.cell import ok
from filigree.functions import dates as D
from filigree.operators import evidence as EV
from filigree.operators import keyed as K
from filigree.operators import quality as Q
from filigree.operators import screen as SC
from filigree.operators import upsert as U
from filigree.reference_data import CRITERIA, constant_frame
from filigree.sources import documents as DOC
from filigree.sources import provenance as PV
from filigree.sources import tables as TB
from filigree.sources.keyed_table import COUNTS, KeyedTable
from filigree.streaming import jobs as J

# --- screens ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "bad",
    [
        {"criteria": []},
        {"criteria": [{"metric": "nope", "op": "gt", "value": 1}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": float("inf")}]},
        {"criteria": [{"metric": "fcf", "op": "between", "low": 2, "high": 1}]},
        {"criteria": [{"metric": "fcf", "op": "between", "low": 1}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": 1, "low": 0}]},
        {"criteria": [{"metric": "gross_margin", "op": "gt", "value": 15}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": 15, "unit": "percent"}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": 1, "surprise": 1}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": 1, "unit": "banana"}]},
        {"criteria": [{"metric": "fcf", "value": 1}]},
        {"criteria": [{"metric": "fcf", "op": "gt", "value": 1}] * 21},
        {"classification": {"taxonomy": "nasdaq", "sic_codes": ["3674"]}},
        {"classification": {"taxonomy": "sec_sic", "sector": "Technology"}},
        {"classification": {"taxonomy": "gics", "sector": "Technology"}},
        {"universe": {"symbols": []}, "criteria": [{"metric": "fcf", "op": "gt", "value": 1}]},
    ],
)
def test_unusable_screens_are_refused(bad):
    with pytest.raises(SC.ScreenError):
        SC.parse_screen(bad)


def test_percent_thresholds_and_symbols():
    s = SC.parse_screen({"universe": {"symbols": ["brk.b", "BRK-B", "aapl"]}, "criteria": [{"metric": "gross_margin", "op": "gt", "value": 15, "unit": "percent"}]})
    assert s.symbols == ("BRK-B", "AAPL") and s.criteria[0].bounds() == (0.15, None, None)


def test_three_outcomes_and_bounds(spark):
    rows = spark.createDataFrame([("A", 5.0, "x"), ("B", 4.0, "x"), ("C", None, "x"), ("D", 7.0, None)], "ticker string, v double, o string")
    gap = F.expr("named_struct('state','MISSING_INPUT','value',CAST(NULL AS double),'reason','R','flags',CAST(array() AS array<string>))")
    views = rows.select("ticker", F.lit("1").alias("cik"), F.lit(1).alias("security_id"), F.when(F.col("v").isNull(), gap).otherwise(ok(F.col("v"))).alias("fcf"))
    spec = SC.parse_screen({"criteria": [{"metric": "fcf", "op": "between", "low": 5, "high": 7}, {"metric": "net_debt", "op": "eq", "value": 0}]})
    got = as_dict(SC.run_screen(views, spec), "ticker")
    assert {k: v["status"] for k, v in got.items()} == {"A": "UNEVALUABLE", "B": "NO_MATCH", "C": "UNEVALUABLE", "D": "UNEVALUABLE"}
    assert got["A"]["exclusion_reason"] == "MISSING_DATA: net_debt MISSING_INPUT (METRIC_NOT_PRODUCED)"
    assert got["B"]["exclusion_reason"] == "FAILED: fcf between 5 and 7 (inclusive)" or "FAILED: fcf between" in got["B"]["exclusion_reason"]
    eq = views.select(F.explode(F.array(*[SC.compare("eq", F.lit(x), t) for x, t in ((1e12 + 100, 1e12), (1e12 + 2000, 1e12), (1e-10, 0.0), (1e-8, 0.0))])).alias("r"))
    assert [r.r for r in eq.collect()][:4] == [True, False, True, False]


def test_classification_is_three_valued(spark):
    rows = [("Technology", "Semis"), ("technology", None), ("Energy", None), ("N/A", " "), (None, "Semis")]
    df = spark.createDataFrame(rows, "sector string, industry string")
    got = [r.r for r in df.select(SC.matches_nasdaq(F.col("sector"), F.col("industry"), want_sector="TECHNOLOGY", exclude=["Banks"]).alias("r")).collect()]
    assert got == [True, None, False, None, None]
    sic = spark.createDataFrame([("3674",), ("674",), ("100",), (None,), ("",)], "s string")
    assert [r.r for r in sic.select(SC.matches_sic(F.col("s"), ["3674", "674"]).alias("r")).collect()] == [True, True, False, None, None]


# --- hot keys ----------------------------------------------------------------------------------------------------------


def test_previous_arrival_across_slices_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), a, rng.choice([1, 2, None])) for a in range(300)]
    df = spark.createDataFrame(rows, "k string, a int, p int").repartition(3)
    got = {(r.k, r.a): r.previous for r in K.with_previous(df, ["k"], ["a"], ["p"], slice_width=7).collect()}
    seen: dict = {}
    for k, a, p in rows:
        before = seen.get(k)
        assert (got[(k, a)] is None) == (before is None)
        if before is not None:
            assert got[(k, a)].p == before[0]
        seen[k] = (p,)
    counts = as_dict(K.repeats_per_key(df, ["k"], ["a"], ["p"]), "k")
    assert sum(c["repeats"] for c in counts.values()) == 300 - len(seen)


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_exact_rank_matches_sorting(spark, buckets):
    rng = random.Random(9)
    rows = [("hot", rng.choice([0.0, 1.0, 1e9, rng.random()])) for _ in range(401)] + [("one", 5.0)] + [("two", float(x)) for x in (2, 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {k: sorted(v for kk, v in rows if kk == k) for k in ("hot", "one", "two")}
    p95 = as_dict(K.exact_rank(df, ["k"], "v", F.ceil(F.col("n") * 0.95), buckets), "k")
    mid = as_dict(K.exact_rank(df, ["k"], "v", F.floor(F.col("n") / 2) + 1, buckets), "k")
    for k, vs in groups.items():
        assert p95[k]["v"] == vs[min(len(vs) - 1, -(-95 * len(vs) // 100) - 1)] and mid[k]["v"] == vs[len(vs) // 2]


def test_request_peak_matches_brute_force(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    times = sorted(rng.randrange(0, 6_000_000) for _ in range(150)) + [1_000_000, 1_999_999, 2_000_000]
    df = spark.createDataFrame([("sec", base + dt.timedelta(microseconds=t)) for t in times], "provider string, ts timestamp_ntz")
    best = max(sum(1 for u in times if 0 <= t - u < 1_000_000) for t in times)
    assert one(Q.request_peak(df)).peak_per_second == best


def test_top_rows_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, v int")
    assert sorted((r.k, r.v) for r in K.top_per_key(df, ["k"], [F.col("v").desc()], 2).collect()) == [("a", 48), ("a", 49), ("b", 1)]


# --- upserts -----------------------------------------------------------------------------------------------------------

SCHEMA = "k int, x int, source_id int, a int"
COLS = ["k", "x", "source_id"]


def test_upsert_counts_and_replay(spark):
    stored = spark.createDataFrame([(1, 1, 1, 0), (2, 2, 1, 0), (3, None, 1, 0), (9, 9, 1, 0)], SCHEMA).select(*COLS)
    batch = spark.createDataFrame([(1, 1, 7, 1), (2, 5, 7, 2), (2, 6, 7, 3), (3, None, 7, 4), (4, 4, 7, 5)], SCHEMA)
    unique = U.latest_in_batch(batch, ["k"], ["a"], COLS)
    first = U.classify(stored, unique, ["k"], COLS)
    c = one(U.upsert_counts(first, batch))
    assert (c.inserted, c.updated, c.unchanged, c.duplicates) == (1, 1, 2, 1)
    new = U.merged(first, COLS)
    assert sorted(map(tuple, new.collect()), key=lambda r: r[0]) == [(1, 1, 1), (2, 6, 7), (3, None, 1), (4, 4, 7), (9, 9, 1)]
    again = one(U.upsert_counts(U.classify(new, unique, ["k"], COLS), batch))
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 4)
    totals = one(U.counter_totals([U.upsert_counts(first, batch)] * 2))
    assert (totals.inserted, totals.duplicates) == (2, 2)


def test_aggregated_sides_meet_in_place(spark):
    rows = [(1, None, 5), (1, 2, 6), (None, None, 7), (None, 2, 8), (4, 4, 1), (4, 5, 3)]
    stored = spark.createDataFrame([*rows, (4, 4, 2), (9, 9, 9), (None, 9, 9)], "k int, j int, x int")
    stored = stored.unionAll(stored.where("k = 9 OR j = 9 OR j = 5"))  # repeated keys stay
    batch = spark.createDataFrame([(1, None, 5), (None, None, 0), (4, 4, 1), (5, None, 1), (6, 6, 6), (4, 5, 3)], "k int, j int, x int")
    keys, columns = ["k", "j"], ["k", "j", "x"]
    safe, in_place = (U.classify(stored, batch, keys, columns, in_place=p) for p in (False, True))
    assert sorted(in_place.collect(), key=str) == sorted(safe.collect(), key=str) and safe.count() == 14
    a, b = (df.groupBy(*keys).agg(F.max("x").alias("x")).select(*columns) for df in (stored, batch))
    both = U.classify(a, b, keys, columns, in_place=True)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # one for each side, and for the keys with NULL one before and one after their aggregate
        assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 6
        seen = K.with_previous(stored, keys, ["x"], ["x"])._jdf.queryExecution().executedPlan().toString()
        assert seen.count("Exchange hashpartitioning") == 4  # rows, ends of slices, ends by key, and those with one before them
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_upsert_by_table_name_with_null_key_parts(table):
    row = {"cik": "0000000001", "taxonomy": "us-gaap", "concept": "Cash", "unit": "USD", "value": 1.0, "period_end": d("2024-12-31"), "accession_no": "a", "source_id": 1}
    stored = table("financial_facts", row)
    batch = table("financial_facts", {**row, "source_id": 2}, {**row, "accession_no": "b", "source_id": 2}).withColumn("n", F.monotonically_increasing_id())
    classified, new = U.upsert_table(stored, batch, "financial_facts", ["n"])
    assert sorted(r.status for r in classified.collect()) == ["inserted", "unchanged"]
    assert sorted((r.accession_no, r.source_id) for r in new.collect()) == [("a", 1), ("b", 2)]


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = ["k", "x", "yr"]
    spark.createDataFrame([(1, 1, 2023), (2, 2, 2024), (3, 3, 2025)], "k int, x int, yr int").write.partitionBy("yr").parquet(path)
    batch = spark.createDataFrame([(2, 20, 2024), (4, 4, 2024), (3, 3, 2025)], "k int, x int, yr int")
    rows = U.merge_partitions(spark.read.parquet(path), batch, ["k"], cols, "yr")
    assert sorted(map(tuple, rows.collect())) == [(2, 20, 2024), (4, 4, 2024)]
    U.overwrite_partitions(rows, path, "yr")
    assert sorted((r.k, r.x, r.yr) for r in spark.read.parquet(path).collect()) == [(1, 1, 2023), (2, 20, 2024), (3, 3, 2025), (4, 4, 2024)]


def test_identity_merge(spark):
    stored = spark.createDataFrame([(1, None, "A", "Old", None), (2, "0000000002", "B", "B1", None), (3, "0000000003", "B", "B2", None), (4, "0000000004", "C", "C", "x")],
                                   "security_id bigint, cik string, ticker string, name string, sector string")
    batch = spark.createDataFrame([("A", "0000000009", None, "Tech", 2), ("A", "0000000008", "Second", None, 3), ("B", None, "Q", None, 1), ("C", None, None, "y", 1), ("D", None, "New", None, 1), ("B", "0000000002", "B9", None, 1)],
                                  "ticker string, cik string, name string, sector string, n int")
    got = {(r.ticker, r.name): (r.action, r.security_id, r.cik, r.sector) for r in U.merge_identities(stored, batch, ["n"], ["name", "sector"]).collect()}
    assert got[("A", "Old")] == ("adopted", 1, "0000000009", "Tech")
    assert got[("A", "Second")] == ("inserted", None, "0000000008", None)
    assert got[("B", "Q")][0] == "ambiguous" and got[("B", "B9")][:2] == ("matched", 2)
    assert got[("C", "C")] == ("matched", 4, "0000000004", "y") and got[("D", "New")][0] == "inserted"


# --- documents -----------------------------------------------------------------------------------------------------------


def point(**more):
    return {"end": "2024-12-31", "val": 5, "filed": "2025-02-01", "form": "10-K", "accn": "a-1", "start": "2024-01-01", "fy": 2024, "fp": "FY", **more}


def document(points, unit="USD", cik=1, taxonomy="us-gaap", tag="Revenues"):
    return json.dumps({"cik": cik, "entityName": "E", "facts": {taxonomy: {tag: {"label": "l", "units": {unit: points}}, "Assets": {"units": {"USD": [point()]}}}}})


def parse(spark, payload, cik="0000000001"):
    return DOC.parse_companyfacts(spark.createDataFrame([(cik, payload)], "cik string, payload string"))


def test_fact_points_are_stored_skipped_or_rejected(spark):
    pts = [point(), point(surprise=1), {"end": "2024-12-31", "val": 1}, point(val="x"), point(end="soon"), point(form="8-K"), point(accn=""), point(start=None, form=None), point(val=1.5e9, start=None)]
    got = [(r.status, r.reason) for r in DOC.fact_points(parse(spark, document(pts))).collect()]
    assert sorted(got, key=str) == sorted([
        ("STORED", None), ("REJECTED", "UNEXPECTED_KEYS"), ("REJECTED", "MISSING_KEYS"), ("REJECTED", "BAD_VALUE"), ("REJECTED", "BAD_VALUE"), ("SKIPPED", "FORM:8-K"),
        ("REJECTED", "MISSING_PROVENANCE:accession"), ("SKIPPED", "FORM:None"), ("STORED", None),
    ], key=str)
    assert [(r.reason) for r in DOC.fact_points(parse(spark, document([point()], unit="EUR"))).collect()] == ["UNEXPECTED_UNIT:EUR"]
    stored = DOC.stored_facts(DOC.fact_points(parse(spark, document(pts)))).orderBy("value").collect()
    assert stored[1].value == 1.5e9 and stored[1].period_start is None and stored[0].fiscal_year == 2024


def test_documents_and_points_are_read_once(spark):
    documents = spark.createDataFrame([("0000000001", document([point()]))], "cik string, payload string")
    parsed = DOC.parse_companyfacts(documents)
    for rows, dates in ((DOC.stored_facts(DOC.fact_points(parsed)), 3), (DOC.taxonomy_coverage(parsed), 0)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("from_json("), plan.count(r"^\d{4}-")) == (1, dates)


def test_dates_are_strict(spark):
    texts = ["2024-02-29", " 2024-12-31T10:00:00 ", "2023-02-29", "2024-13-01", "2024-1-01", "24-01-01", "", None, "0000-01-01", "9999-12-31", "20240-01-01"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(D.iso_date(F.col("t")).cast("string"))
    assert [r[0] for r in got.collect()] == ["2024-02-29", "2024-12-31", None, None, None, None, None, None, "0000-01-01", "9999-12-31", None]


def test_unusable_documents(spark):
    assert one(parse(spark, document([point()], cik=2))).problem == "CIK_MISMATCH"
    assert one(parse(spark, "not json")).problem == "MISSING_OR_INVALID_CIK"
    assert one(parse(spark, json.dumps({"cik": 1}))).problem == "NO_FACTS"
    ifrs = parse(spark, document([point()], taxonomy="ifrs-full"))
    assert one(DOC.taxonomy_coverage(ifrs)).unavailable == "UNSUPPORTED_TAXONOMY:ifrs-full" and DOC.fact_points(ifrs).count() == 0


def submission(**more):
    recent = {"accessionNumber": ["0-1", "0-2"], "form": ["10-K", "8-K"], "filingDate": ["2025-02-01", "2025-03-01"], "reportDate": ["2024-12-31", ""], "items": ["", "2.02"], "primaryDocument": ["a.htm", ""]}
    return json.dumps({"cik": "1", "name": "Issuer", "sic": "3674", "fiscalYearEnd": "0926", "tickers": ["brk.b"], "exchanges": ["NYSE"], "formerNames": [{"name": "Old"}], "filings": {"recent": {**recent, **more}}})


def test_submissions(spark):
    def read(text):
        return DOC.parse_submissions(spark.createDataFrame([("0000000001", text)], "cik string, payload string"))

    p = one(read(submission()))
    assert (p.problem, p.tickers, tuple(p.fiscal_year_end), p.former_names) == (None, ["BRK-B"], (9, 26), ["Old"])
    f = one(DOC.submission_filings(read(submission())))
    assert (f.form, str(f.report_date), f.url) == ("10-K", "2024-12-31", "https://www.sec.gov/Archives/edgar/data/1/01/a.htm")
    assert DOC.submission_filings(read(submission()), None).count() == 2
    assert one(read(submission(form=["10-K"]))).problem == "RAGGED_FILINGS"
    assert one(read('{"cik": 1, "name": " "}')).problem == "NO_ENTITY_NAME"


def test_ticker_map_and_resolution(spark):
    doc = json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[1, "A", "aaa", "NYSE"], [2, "B", "BRK.B", None], [3, "B2", "BRK-B", ""], [0, "bad", "X", "N"], [4, "short"]]})
    m = DOC.parse_ticker_map(spark.createDataFrame([(doc,), ('{"fields": ["x"], "data": []}',)], "payload string"))
    assert sorted((r.cik, r.ticker, r.exchange) for r in m.collect()) == [("0000000001", "AAA", "NYSE"), ("0000000002", "BRK-B", None), ("0000000003", "BRK-B", None)]
    asked = spark.createDataFrame([("AAA", "0000000001"), ("aaa", "0000000007"), ("BRK/B", None), ("ZZZ", None)], "ticker string, expected_cik string")
    assert sorted(r.status for r in DOC.resolve(asked, m).collect()) == ["AMBIGUOUS", "CONTRADICTED", "NOT_IN_MAP", "RESOLVED"]


def test_landing_provenance_and_fallback(spark, tmp_path):
    docs = spark.createDataFrame([('{"a":\n 1}',), ('{"b": 2}',)], "payload string").coalesce(1)
    DOC.write_landing(docs, str(tmp_path / "zone"))
    back = DOC.read_landing(spark, str(tmp_path / "zone"))
    assert sorted(r.payload for r in back.collect()) == ['{"a":  1}', '{"b": 2}'] and ".gz" in back.first().raw_path
    assert DOC.read_landing(spark, str(tmp_path / "zone"), one_per_file=True).count() == 1
    r = docs.selectExpr("payload", "'sec' AS provider", "'x' AS dataset", "'{}' AS parameters", "timestamp_ntz'2025-01-01' AS retrieved_at")
    ids = [(x.source_id, x.content_hash) for x in PV.retrieval_rows(r).collect()]
    assert ids == [(x.source_id, x.content_hash) for x in PV.retrieval_rows(r).collect()] and len(set(ids)) == 2
    PV.append_sources(PV.retrieval_rows(r), str(tmp_path / "sources"))
    PV.append_sources(PV.retrieval_rows(r), str(tmp_path / "sources"))
    assert spark.read.parquet(str(tmp_path / "sources")).count() == 4
    a, b = spark.createDataFrame([(1, "p")], "k int, v string"), spark.createDataFrame([(1, "f"), (2, "f")], "k int, v string")
    assert sorted(map(tuple, PV.primary_else_fallback(a, b, ["k"]).collect())) == [(1, "p", False), (2, "f", True)]
    TB.write_report(a, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


# --- acceptance --------------------------------------------------------------------------------------------------------


def test_criterion_status_over_every_combination(spark):
    states = [Q.PASS, Q.FAIL, Q.NOT_EVALUABLE, Q.DEFERRED, Q.EXPECTED_UNSUPPORTED]
    combos = list(itertools.product(states, repeat=2)) + [(s,) for s in states]
    rows = [(str(n), s) for n, combo in enumerate(combos) for s in combo]
    got = as_dict(Q.criterion_status(spark.createDataFrame(rows, "criterion string, status string")), "criterion")
    for n, combo in enumerate(combos):
        if Q.FAIL in combo:
            want = Q.FAIL
        elif set(combo) == {Q.PASS}:
            want = Q.PASS
        elif set(combo) == {Q.EXPECTED_UNSUPPORTED}:
            want = Q.EXPECTED_UNSUPPORTED
        elif Q.PASS in combo:
            want = Q.PARTIAL
        else:
            want = Q.DEFERRED if Q.DEFERRED in combo else Q.NOT_EVALUABLE
        assert got[str(n)]["status"] == want, combo


def test_components_from_measures(spark):
    none = spark.createDataFrame([("identified", 14.0), ("attempted", 14.0), ("duplicates_run1", 1.0)], "name string, value double")
    got = {r.component: r.status for r in Q.acceptance_components(none).collect()}
    assert len(got) == sum(map(len, CRITERIA.values()))
    assert (got["identity_rate"], got["duplicates_after_run1"], got["duplicates_after_run2"], got["total_assets"]) == ("PASS", "FAIL", "NOT_EVALUABLE", "DEFERRED")
    assert {got[c] for c in ("failure_classes_handled", "per_security_p95_recorded")} == {"NOT_EVALUABLE", "FAIL"}


def test_gate_fails_closed(spark):
    def gate(rows, **more):
        c = spark.createDataFrame(rows, "criterion string, component string, status string")
        facts = {"completed": 1.0, "failures": 0.0, "live": 1.0, "integrity_violations": 0.0, "tests_passed": 1.0} | more
        run = spark.createDataFrame([(k, v) for k, v in facts.items() if v is not None] + [("other", 3.0)], "name string, value double")
        return one(Q.progression_gate(Q.gate_components(c), Q.run_blockers(run))).gate

    waived = [("A4", "total_assets", "DEFERRED"), ("A1", "identity_rate", "PASS")]
    assert gate(waived) == "OPEN"
    assert gate([("A4", "total_assets", "FAIL")]) == "CLOSED" and gate([("A1", "identity_rate", "NOT_EVALUABLE")]) == "CLOSED"
    assert gate(waived, live=0.0) == "CLOSED" and gate(waived, tests_passed=None) == "CLOSED" and gate(waived, integrity_violations=None) == "CLOSED"
    assert gate(waived, failures=2.0) == "CLOSED" and gate(waived, completed=0.0) == "CLOSED" and gate([]) == "OPEN"


def test_verdict(spark):
    def verdict(*states, **more):
        return one(Q.overall_verdict(spark.createDataFrame([(s,) for s in states], "status string"), **more)).overall

    assert verdict("PASS", "PASS") == "ACCEPTED" and verdict("PASS", "PARTIAL") == "INCOMPLETE" and verdict("PASS", "FAIL") == "FAILED"
    assert verdict("PASS", failures=1) == "FAILED" and verdict("PASS", fatal="NETWORK") == "NOT_RUN" and verdict("PASS", fatal="DATABASE_LOCKED") == "FAILED"


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [(1, "a"), (2, None), (2, None)]

    def digest(rs, n):
        return one(Q.digest(spark.createDataFrame(rs, "k int, v string").repartition(n), ["k", "v"])).digest

    assert digest(rows, 1) == digest(rows[::-1], 3) != digest(rows[:2], 1)
    assert digest([(1, None)], 1) != digest([(1, "")], 1) and digest([(1, "2:a-")], 1) != digest([(12, ":a-")], 1)


def test_warning_and_issue_sets(spark):
    w = constant_frame(spark, [("OPENBB_WARNING",), ("SOMETHING_NEW",)], "category")
    assert [r.category for r in Q.uncategorised(w).collect()] == ["SOMETHING_NEW"]
    assert Q.unhandled_kinds(constant_frame(spark, [("NETWORK",), ("ALIENS",)], "kind")).first().kind == "ALIENS"


# --- evidence ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("form", "items", "expected"),
    [
        ("10-K", "", [("filings", [])]), (" 4 ", None, [("insiders", [])]), ("SC 13G/A", "", [("ownership", [])]), ("425", "", [("mna", [])]), ("S-1", "1.01", []),
        ("8-K", "2.02,9.01", [("earnings", ["2.02"])]), ("8-k/a", "9.01", [("other", ["9.01"])]), ("8-K", "", [("other", [])]),
        ("8-K", "1.01, 5.02,1.02", [("contracts_customers", ["1.01", "1.02"]), ("other", ["5.02"])]),
    ],
)
def test_filing_sections(spark, form, items, expected):
    p = spark.range(1).select(EV.placements(F.lit(form), F.lit(items).cast("string")).alias("p")).first().p
    assert [(x.section, x.codes) for x in p] == expected


def test_form4_classes(spark):
    df = spark.createDataFrame([(" p ", "Bona fide gift"), ("S", "Automatic Sell"), ("v", "bona fide gift"), ("?", None), (None, "x")], "c string, t string")
    got = df.select(EV.classify_form4(F.col("c")).alias("c"), EV.classify_form4_wording(F.col("t")).alias("t"), EV.is_market_signal(EV.classify_form4(F.col("c"))).alias("m")).collect()
    assert [r.c for r in got] == ["OPEN_MARKET_BUY", "OPEN_MARKET_SELL", "OTHER", "UNKNOWN", "UNKNOWN"]
    assert [r.t for r in got] == ["GIFT", "OPEN_MARKET_SELL", "UNKNOWN", "UNKNOWN", "UNKNOWN"] and [r.m for r in got] == [True, True, False, False, False]


def test_mixed_report_periods_are_not_summed(spark):
    rows = [("1", d("2025-12-31"), 5.0), ("1", d("2026-06-30"), 6.0), ("2", d("2025-12-31"), 5.0), ("2", d("2025-12-31"), 6.0), ("3", None, 1.0)]
    got = as_dict(EV.holder_totals(spark.createDataFrame(rows, "cik string, as_of_date date, shares double")), "cik")
    assert (got["1"]["reason"], got["2"]["shares"], got["3"]["reason"]) == ("MIXED_REPORT_PERIODS", 11.0, "REPORT_DATE_MISSING")


# --- streams ---------------------------------------------------------------------------------------------------------------


def test_landing_stream_takes_each_file_once(spark, tmp_path):
    zone, out, state = (str(tmp_path / n) for n in ("zone", "out", "state"))
    (tmp_path / "zone").mkdir()
    (tmp_path / "zone" / "CIK0000000001.json").write_text(document([point()]))

    def run():
        J.land_facts(J.landed_documents(spark, zone), out, state).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 1 and run() == 1
    (tmp_path / "zone" / "CIK0000000002.json").write_text(document([point(), point(accn="b")], cik=2))
    assert run() == 3


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet") if "bucket=" in str(f)}


def test_upsert_stream_and_replayed_batch(spark, tmp_path):
    schema = "k int, x int, source_id int, a int"
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = KeyedTable(spark, str(tmp_path / "table"), "k int, x int, source_id int", ("k",), buckets=4)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint):
        J.upsert_stream(J.read_stream(spark, folder, schema), table, ["a"], checkpoint).awaitTermination()
        return sorted(map(tuple, table.read().collect()))

    assert table.read().collect() == []
    add([(1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1, 3)])
    assert run(state) == [(1, 2, 1), (2, 1, 1)]
    assert table.last()[1] == {"inserted": 2, "updated": 0, "unchanged": 0, "duplicates": 1}
    add([(2, 9, 2, 4), (3, 3, 2, 5), (1, 2, 2, 6)])
    assert run(state) == [(1, 2, 1), (2, 9, 2), (3, 3, 2)]
    assert table.last()[1] == {"inserted": 1, "updated": 1, "unchanged": 1, "duplicates": 0}
    assert table.commits() == [0, 1]
    # a lost checkpoint replays everything as batch 0, which is committed: nothing changes
    before = _files(tmp_path / "table")
    assert run(str(tmp_path / "state2")) == [(1, 2, 1), (2, 9, 2), (3, 3, 2)]
    assert _files(tmp_path / "table") == before


def test_upsert_writes_touched_buckets_only_and_removes_old_files(spark, tmp_path):
    schema = "k int, x int"
    table = KeyedTable(spark, str(tmp_path), schema, ("k",), buckets=8)
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    assert table.upsert(frame(*[(k, 0) for k in range(100)], (None, 0)), 0) == {"inserted": 101, "updated": 0, "unchanged": 0, "duplicates": 0}
    first = _files(tmp_path)
    assert len(first) == 8
    own = frame((7, 1)).select(table._bucket()).first()[0]
    assert table.upsert(frame((7, 1)), 1)["updated"] == 1
    second = _files(tmp_path)
    assert first.items() <= second.items()  # files of commit 0 stay as they were, for readers of it
    assert {f.split("/")[2] for f in second.keys() - first.keys()} == {f"bucket={own}"}
    written = table.last()[0]
    assert [b for b, n in written.items() if n == 1] == [own]
    assert table.upsert(frame((7, 1), (8, 0)), 2) == {"inserted": 0, "updated": 0, "unchanged": 2, "duplicates": 0}
    assert table.last()[0] == written  # touched without a change: not replaced
    third = _files(tmp_path)
    assert len(third) == 8 and f"data/batch=0/bucket={own}" not in {f.rsplit("/", 1)[0] for f in third}
    assert table.commits() == [1, 2]
    assert table.upsert(frame(), 3) == dict.fromkeys(COUNTS, 0)
    assert table.upsert(frame((None, 5)), 4)["updated"] == 1
    got = {r.k: r.x for r in table.read().collect()}
    assert got == {k: 0 for k in range(100)} | {7: 1, None: 5}


def test_upsert_after_a_crash_between_files_and_commit(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k int, x int", ("k",), buckets=4)
    frame = lambda *rows: spark.createDataFrame(rows, "k int, x int")
    table.upsert(frame((1, 1), (2, 2)), 0)
    # batch 1 wrote its files and was lost before the commit: readers do not see them, and the retry replaces them
    frame((1, 99)).select(table._bucket(), "k", "x").write.partitionBy("bucket").parquet(str(tmp_path / "data" / "batch=1"))
    assert sorted(map(tuple, table.read().collect())) == [(1, 1), (2, 2)]
    assert table.upsert(frame((1, 7)), 1)["updated"] == 1
    assert sorted(map(tuple, table.read().collect())) == [(1, 7), (2, 2)]


def test_tick_bars_merge_and_late_ticks_go_aside(spark, tmp_path):
    schema = "security_id bigint, ts timestamp, price double, seq bigint"
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = KeyedTable(spark, str(tmp_path / "bars"), J.BAR_SCHEMA, J.BAR_KEYS, buckets=4)
    t0 = dt.datetime(2025, 1, 1, 10)
    sent = 0

    def run(rows):
        nonlocal sent
        sent += len(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        J.bar_stream(J.read_stream(spark, folder, schema), table, state, lateness="2 days").awaitTermination()
        late = J.late_ticks(table, schema).collect()
        bars = {str(r.trade_date): (r.open, r.high, r.low, r.close, r.volume) for r in table.read().collect()}
        assert sum(b[-1] for b in bars.values()) + len(late) == sent
        return bars, sorted((r.seq, r.reason, r.batch) for r in late)

    assert run([(1, t0, 5.0, 1), (1, t0 + dt.timedelta(hours=1), 7.0, 2)]) == ({"2025-01-01": (5.0, 7.0, 5.0, 7.0, 2)}, [])
    bars, late = run([(1, t0 - dt.timedelta(hours=1), 4.0, 0), (1, t0 + dt.timedelta(days=1), 8.0, 3), (1, None, 1.0, 9)])
    assert bars == {"2025-01-01": (4.0, 7.0, 4.0, 7.0, 3), "2025-01-02": (8.0, 8.0, 8.0, 8.0, 1)}
    assert late == [(9, "NO_TIME", 1)]
    # the newest tick of earlier batches decides, so this batch's own newest tick makes nothing late
    bars, late = run([(1, t0 + dt.timedelta(days=9), 9.0, 4), (1, t0 + dt.timedelta(hours=2), 6.0, 5)])
    assert bars["2025-01-01"] == (4.0, 7.0, 4.0, 6.0, 4) and len(late) == 1
    bars, late = run([(1, t0 + dt.timedelta(hours=3), 99.0, 6), (1, t0 + dt.timedelta(days=8), 2.0, 7)])
    assert bars["2025-01-01"] == (4.0, 7.0, 4.0, 6.0, 4) and bars["2025-01-09"] == (2.0, 2.0, 2.0, 2.0, 1)
    assert late == [(6, "LATE", 3), (9, "NO_TIME", 1)]


def test_previous_keeps_null_keys_and_arrivals(spark):
    for kind, values in (("int", [None, 1, 2_000_001, 2_000_002]), ("string", [None, "a", "b", "c"]), ("date", [None, dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2024, 1, 1)]),
                         ("timestamp", [None, dt.datetime(2020, 1, 1, 1), dt.datetime(2020, 1, 1, 2), dt.datetime(2021, 1, 1)])):
        df = spark.createDataFrame([(k, v, n) for k in (None, "x") for n, v in enumerate(values)], f"k string, a {kind}, p int").withColumn("extra", F.lit("kept"))
        got = K.with_previous(df, ["k"], ["a"], ["p"]).collect()
        assert sorted(((r.k, r.p, r.previous and r.previous.p) for r in got), key=str) == sorted(((k, n, n - 1 if n else None) for k in (None, "x") for n in range(4)), key=str)
        assert {r.extra for r in got} == {"kept"}


def test_upsert_keeps_columns_the_batch_lacks(spark):
    from filigree.sources.tables import KEYS

    keys = KEYS["price_daily"]
    stored = spark.createDataFrame([(1, dt.date(2024, 1, 2), 5.0, 4.5), (1, dt.date(2024, 1, 3), 6.0, 5.5)], "security_id bigint, trade_date date, close double, adj_close double")
    batch = spark.createDataFrame([(1, dt.date(2024, 1, 3), 7.0, 1), (2, dt.date(2024, 1, 3), 8.0, 2)], "security_id bigint, trade_date date, close double, n int")
    assert set(keys) <= set(stored.columns)
    classified, new = U.upsert_table(stored, batch, "price_daily", ["n"])
    assert new.columns == stored.columns
    assert sorted(map(tuple, new.collect())) == [(1, dt.date(2024, 1, 2), 5.0, 4.5), (1, dt.date(2024, 1, 3), 7.0, 5.5), (2, dt.date(2024, 1, 3), 8.0, None)]
    assert sorted(r.status for r in classified.collect()) == ["inserted", "kept", "updated"]
    with pytest.raises(ValueError, match="trade_date"):
        U.upsert_table(stored, batch.drop("trade_date"), "price_daily", ["n"])


def test_identity_merge_within_one_batch(spark):
    stored = spark.createDataFrame([(9, None, "T", "Old"), (5, "0000000005", "U", "U5")], "security_id bigint, cik string, ticker string, name string")
    rows = [("T", None, "T name", 1), ("T", "0000000001", None, 2), ("N", None, "N name", 3), ("N", "0000000002", None, 4), ("M", None, "M?", 5), ("M", "0000000003", "M3", 6), ("M", "0000000004", "M4", 7),
            ("U", None, "U new", 8), ("U", "0000000005", None, 9)]
    batch = spark.createDataFrame(rows, "ticker string, cik string, name string, n int")
    got = sorted(((r.ticker, r.cik, r.security_id, r.action, r.name) for r in U.merge_identities(stored, batch, ["n"], ["name"]).collect()), key=str)
    assert got == sorted([
        ("T", "0000000001", 9, "adopted", "T name"), ("N", "0000000002", None, "inserted", "N name"), ("M", None, None, "ambiguous", "M?"),
        ("M", "0000000003", None, "inserted", "M3"), ("M", "0000000004", None, "inserted", "M4"), ("U", "0000000005", 5, "matched", "U new"),
    ], key=str)
