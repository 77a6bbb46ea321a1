"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its text. The ledger holds one row for each
(blob, rule, rule version) ever scanned. A scan reads only the pairs the ledger lacks and joins
findings back to all paths, so copies, unchanged versions and unchanged rules cost nothing again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.rows import whole_row
from filigree.sources.staging import stage


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    least: int = 0  # characters that group ``group`` must have
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The three base rules, in the order in which spans with one start are listed.
BASE = (
    Rule("assign", 1, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),  # a run is taken whole, so this is the run of 20 or more
    Rule("hex", 1, "[0-9a-f]{24,}"),  # likewise
)
#: Added rules.
EXTRA = (
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("login", 1, "[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[^\\x20\\x09-\\x0D@/]{6,128}@[A-Za-z0-9.-]+"),
)
RULES = BASE + EXTRA
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule's leftmost non-overlapping matches, in code points, end exclusive.

    The texts between matches and the matches themselves add up to the places. A match whose group is too short is dropped after
    matching, so it still uses up its characters.
    """
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    each = F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))).alias("p"), found.alias("m"), values.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.lit([]).cast(f"array<{SPAN}>")
    run = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), run).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that are missing for the texts of ``versions``: one for each unseen (blob, rule version).

    Copies are reduced to one text per blob while still in the tasks that read them. NULL is the empty text.
    An empty table gives no rows.
    """
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("blob").agg(F.first("t").alias("t"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many entries as rules
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit([]).cast("array<string>"))
    new = lambda r: ~F.coalesce(F.array_contains("seen", r.key), F.lit(False))
    each = [F.when(new(r), F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("t"), r, k).alias("spans"))) for k, r in enumerate(rules)]
    pairs = blobs.select("blob", F.explode(F.array_compact(F.array(*each))).alias("x"))
    return pairs.select("blob", "x.rule", "x.spans")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found``: all spans of the current rule versions of each blob that has any, by start, then rule order."""
    current = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))  # as many entries as rules


def find(docs: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a column ``_found`` of spans (one of that name is replaced), and the ledger rows to append.

    Every row of ``docs`` stays, repeated ones too; a row without secrets has an empty array. New ledger rows are written once to the
    shared folder. Findings are joined back by blob; a blob with very many paths is a
    skewed join key that Spark splits.
    """
    fresh = stage(scan(docs, ledger, text=text, rules=rules))
    known = stage(findings(fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "spans")), rules))
    kept = [c for c in docs.columns if c.lower() != "_found"]
    packed = docs.select(whole_row(kept), blob_of(F.col(text)).alias("blob"))
    got = packed.join(known, "blob", "left")
    return got.select("row.*", F.coalesce("found", F.lit([]).cast(f"array<{SPAN}>")).alias("_found")), fresh


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones united, replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, grown).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
