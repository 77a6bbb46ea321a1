"""The manifest against a plain Merkle tree, for small superblocks, ties, NULLs, repeated rows and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from filigree.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, node int, `a.b` string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(*map(text, values))


def _walk(nodes):
    """The top of a tree, and for each node the siblings up to it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            other = at[k] ^ 1
            if other < len(nodes):
                way.append((other < at[k], nodes[other]))
            else:
                way.append((None, ""))
            at[k] //= 2
        nodes = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def _brute(rows, claims):
    leaves = [_leaf(r[:5]) for r in rows]
    trees = {}
    for k, r in enumerate(rows):
        trees.setdefault(r[2], []).append(k)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inner, subroots = {}, []
    for t in order:
        ks = sorted(trees[t], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))
        top, ways = _walk([leaves[k] for k in ks])
        subroots.append(top)
        inner |= {k: (top, w) for k, w in zip(ks, ways, strict=True)}
    root, upper = _walk(subroots) if subroots else (None, [])
    out = []
    for k, r in enumerate(rows):
        top, way = inner[k]
        way = way + upper[order.index(r[2])]
        node = claims[k] or leaves[k]
        for left, other in way:
            node = _h(other, node) if left else _h(node, other)
        out.append((r[0], r[2], leaves[k], top, root, "".join(o for _, o in way), node, node == root))
    return sorted(out, key=str)


def _got(df, rows, claims, height):
    claimed = F.when(F.col("node") > 0, merkle.leaf([F.lit("other"), F.col("text")]))
    got = merkle.manifest(df, claimed=claimed, height=height).collect()
    return sorted(((r["id"], r["group"], r["leaf"], r["subroot"], r["root"], "".join(s[1:] for s in r["proof"]), r["folded_root"], r["verified"]) for r in got), key=str)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest(spark, height):
    rng = random.Random(3)
    langs = ["en"] * 8 + [None, "", "é", "z", "zh"]
    rows = [(rng.choice([None, 1 << 60, *range(40)]), rng.choice([None, "s"]), rng.choice(langs), rng.choice([None, 3, -1]), rng.choice([None, "", "x", "é\n" * 5000, "-"]), "t", 1, rng.randrange(-2, 2), "dot") for _ in range(90)]
    rows += [rows[5]] * 7 + [(7, "s", "lone", 1, "t", None, None, 0, None)]
    claims = [_leaf(["other", r[4]]) if r[7] > 0 else None for r in rows]
    assert _got(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, claims, height) == _brute(rows, claims)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(k, "s", "en", 1, "x", "t", 1, 1, "") for k in range(n)]
    claims = [_leaf(["other", "x"])] * n
    assert _got(spark.createDataFrame(rows, SCHEMA), rows, claims, 1) == _brute(rows, claims)


def test_one_changed_byte_changes_its_own_verdict_only(spark):
    rows = [(k, "s", "en" if k % 3 else "de", 1, f"text {k}", "", 1, 1 if k == 4 else 0, "") for k in range(30)]
    got = {r["id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), claimed=F.when(F.col("node") > 0, F.sha2(F.lit("?"), 256)), height=2).collect()}
    assert got == {k: k != 4 for k in range(30)}


def test_superblocks_are_cogrouped_and_no_window_runs_over_leaves(spark):
    rows = [(k, "s", "en", 1, f"text {k}", "", 1, 0, "") for k in range(9)]
    plan = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert "Window" not in plan
