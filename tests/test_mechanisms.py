"""Histories at several dates, many screens as a table, ordered files, canonical payload hashes."""

import json

from pyspark.sql import functions as F

from filigree.functions import text as T
from filigree.operators import facts as X
from filigree.operators import screen as SC
from filigree.sources import tables as TB


def test_known_at_equals_one_run_for_each_date(facts):
    rows = [("Revenues", v, "2020-01-01", "2020-12-31", day, acc) for v, day, acc in ((1, "2021-02-01", "a"), (2, "2021-02-01", "b"), (3, "2022-02-01", "c"), (3, "2023-02-01", "d"))]
    df = facts(*rows, ("Revenues", 9, "2021-01-01", "2021-12-31", "2022-02-01", "c"), ("NetIncomeLoss", 4, "2020-01-01", "2020-12-31", "2021-02-01", "a"))
    dates = ("2020-01-01", "2021-02-01", "2021-12-31", "2022-02-01", "2030-01-01", "2030-01-01")
    history = X.vintages(X.line_facts(df))
    columns = ("cik", "tag", "period_start", "period_end", "value", "accession")
    got = sorted(map(str, X.known_at(history, dates).select(F.col("as_of").cast("string"), *columns).collect()))
    want = []
    for day in dict.fromkeys(dates):
        known = X.latest_known(X.line_facts(df, as_of=day)).select(F.lit(day).alias("as_of"), *columns)
        want += map(str, known.collect())
    assert got == sorted(want)
    plan = X.known_at(history, dates)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan


VIEWS = "ticker string, cik string, security_id bigint, fcf struct<state:string,value:double,reason:string,flags:array<string>>, net_margin struct<state:string,value:double,reason:string,flags:array<string>>"


def _cell(x):
    return ("MISSING_INPUT", None, "NOT_REPORTED", []) if x is None else ("OK", x, None, [])


def test_screens_as_a_table_equal_screens_one_by_one(spark):
    from filigree.plans.snapshot import long_metrics

    values = [(None, 0.2), (5.0, None), (5.0, 0.1), (-1.0, 0.25), (0.0, 0.0), (None, None)]
    views = spark.createDataFrame([(f"T{k}", "1", k, _cell(a), _cell(b)) for k, (a, b) in enumerate(values)], VIEWS)
    specs = {
        "a": [{"metric": "fcf", "op": "gt", "value": 0}], "b": [{"metric": "fcf", "op": "eq", "value": 5.0}, {"metric": "net_margin", "op": "between", "low": 10, "high": 20, "unit": "percent"}],
        "c": [{"metric": "net_margin", "op": "lte", "value": 0.2, "unit": "fraction"}, {"metric": "fcf", "op": "gte", "value": -1}, {"metric": "fcf", "op": "lt", "value": 5}],
    }
    texts = spark.createDataFrame([(n, json.dumps({"criteria": c})) for n, c in specs.items()], "screen string, spec string")
    got = {(r.screen, r.ticker): (r.status, r.criteria_passed, r.criteria_failed, r.criteria_unevaluable) for r in SC.run_screens(long_metrics(views), SC.criteria_table(texts)).collect()}
    for name, criteria in specs.items():
        for r in SC.run_screen(views, SC.parse_screen({"criteria": criteria})).collect():
            assert got.pop((name, r.ticker)) == (r.status, r.criteria_passed, r.criteria_failed, r.criteria_unevaluable)
    assert not got


def test_unusable_screens_are_refused_with_their_problems(spark):
    good = {"metric": "fcf", "op": "gt", "value": 0}
    cases = {
        "NO_CRITERIA": [{}, {"criteria": []}], "UNKNOWN_METRIC": [{"criteria": [good, {**good, "metric": "x"}]}], "UNKNOWN_OP": [{"criteria": [{**good, "op": "ne"}]}, {"criteria": [{"metric": "fcf", "value": 1}]}],
        "WRONG_THRESHOLDS": [{"criteria": [{**good, "low": 1}]}, {"criteria": [{"metric": "fcf", "op": "between", "low": 2, "high": 1}]}, {"criteria": [{"metric": "fcf", "op": "gt"}]}],
        "WRONG_UNIT": [{"criteria": [{**good, "unit": "percent"}]}, {"criteria": [{"metric": "net_margin", "op": "gt", "value": 1}]}], "TOO_MANY_CRITERIA": [{"criteria": [good] * 21}],
    }
    rows = [(f"{p} {k}", json.dumps(s)) for p, specs in cases.items() for k, s in enumerate(specs)] + [("NO_CRITERIA 9", "no json"), ("NO_CRITERIA null", None), ("fine", json.dumps({"criteria": [good]}))]
    table = SC.criteria_table(spark.createDataFrame(rows, "screen string, spec string"))
    got = {r.screen: r.problems for r in SC.refused(table).collect()}
    assert got == {name: [name.split()[0]] for name, _ in rows if name != "fine"}


def test_ordered_files(spark, tmp_path):
    rows = [(f"T{k * 37 % 100:02d}", k % 3, k) for k in range(200)]
    df = spark.createDataFrame(rows, "ticker string, cik int, n int").repartition(5)
    path = str(tmp_path / "out")
    TB.write_ordered(df, path, "ticker", F.col("cik").desc())
    want = sorted(((t, -c) for t, c, _ in rows))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert len(files) > 1
    in_files = [(r.ticker, -r.cik) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert in_files == want
    got = sorted((r.position, r.ticker, -r.cik) for r in TB.read_ordered(spark, path).collect())
    assert [g[0] for g in got] == list(range(200)) and [g[1:] for g in got] == want


def test_canonical_hash(spark):
    def hashes(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return [r[0] for r in df.select(T.canonical_hash(F.col("t"))).collect()]

    a, b, c, e = hashes('{"b": [1, {"y": 1, "x": null}], "a": "é"}', '{"a":"é","b":[1,{"x":null,"y":1}]}', '{"a":"é","b":[{"x":null,"y":1},1]}', None)
    assert a == b != c and e is None
    raw = hashes("no json", "no  json")
    assert len(set(raw)) == 2 and all(h.startswith("sha256:") for h in raw)


