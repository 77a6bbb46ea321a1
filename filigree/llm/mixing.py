"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted into cells (source, language, topic). Raking multiplies the cells' token weights until their
sums agree with the target marginals; a document is then kept with its cell's calibrated probability.
Only cell counts are raked, never documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.rows import whole_row
from filigree.sources.staging import stage

DIMENSIONS = ("source", "lang", "topic")
#: Columns that ``mix`` adds; input columns of these names are replaced.
ADDED = ("_tokens", "_topic", "_probability", "_kept", "_weight")
#: Topics by what a whole text holds, the first that applies; a parameter of ``topic_of``. The rest is 'prose'.
TOPICS = {"licence": "[Ll]icen[cs]e|[Cc]opyright", "contact": "@[A-Za-z0-9-]+[.][a-z]", "credentials": "[Pp]assw|[Ss]ecret|[Tt]oken|AKIA", "markup": "[%$#&*]{3}"}
WORD = "[^\\x20\\x09-\\x0D]+"


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    out = F
    for name, pattern in topics.items():
        out = out.when(F.regexp_like(text, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flattened(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target marginal of one dimension: each value's share of tokens, raised to ``power`` and scaled to sum to 1."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))
    every = sums.agg(F.sum("share")).first()[0] or 1.0  # one number
    return sums.select(dimension, (F.col("share") / every).alias("target"))


def marginal_error(raked: DataFrame, targets: Mapping[str, DataFrame], total: float) -> float:
    """The largest distance of a value's share of the weight from its target, over all dimensions."""
    sums = raked.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), "weight") for d in targets)))).groupBy("dimension", "value").agg(F.sum("weight").alias("weight"))
    wanted = reduce(DataFrame.unionAll, (t.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target") for d, t in targets.items()))
    apart = F.abs(F.coalesce("weight", F.lit(0.0)) / F.lit(total) - F.col("target"))
    return wanted.join(sums, ["dimension", "value"], "left").agg(F.max(apart)).first()[0] or 0.0  # one number


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], *, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """Cells with ``weight``: ``tokens`` scaled to the target marginals, one dimension after the other, until all are met.

    ``targets`` maps a dimension to a table of its values and their ``target`` shares. Cells whose value has no target are left
    out: their share is 0. Sweeps end when no share is further than ``tolerance`` from its target. Targets that contradict each other (a source in one
    language that wants more than this language) are never met; after ``most`` sweeps the last dimension's are. Cells are never all needed in
    one task: each step is a mergeable sum and a join with one row per value. A step reads the cells twice, so they are written after each one:
    unwritten, the plan would double with every step.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)  # one number
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(1, most + 1):
        for d, target in targets.items():
            factor = now.groupBy(d).agg(F.sum("weight").alias("sum")).join(target, d).select(d, F.when(F.col("sum") > 0, F.col("target") * total / F.col("sum")).otherwise(F.lit(0.0)).alias("factor"))
            now = stage(now.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
        if not total or (sweep >= 4 and sweep % 2 == 0 and marginal_error(now, targets, total) <= tolerance):
            break
    return now


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep_share: float = 0.5, power: float = 0.5, tolerance: float = 1e-6, seed: str = "mix") -> DataFrame:
    """``docs`` with ``_tokens``, ``_topic``, ``_probability``, ``_kept`` and ``_weight``.

    Targets are the token shares of sources, languages and topics raised to ``power`` (below 1: small ones grow). With ratio = raked
    weight / tokens of its cell, a document is kept with probability min(1, keep_share * ratio), decided by a hash of its id,
    and has weight keep_share * ratio / probability, so weighted tokens meet the targets, up to ``tolerance`` of all and the chance of the draw, even where the probability is capped.
    NULL source or language is the value 'unknown'; a text without words has ratio 1 where its whole cell has none. Repeated rows are decided alike.
    """
    s, g = (F.coalesce(F.col(c), F.lit("unknown")) for c in (source, lang))
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(s.alias("source"), g.alias("lang"), topic_of(body).alias("topic"), n_tokens(F.col(text)).alias("tokens"))
    cells = stage(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    raked = rake(cells, {d: stage(flattened(cells, d, power)) for d in DIMENSIONS}, tolerance=tolerance)
    ratios = stage(raked.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), (F.col("weight") / F.col("tokens")).alias("_ratio")))
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    named = docs.select(whole_row(kept), F.col(doc_id).alias("_id"), s.alias("_source"), g.alias("_lang"), topic_of(body).alias("_topic"), n_tokens(F.col(text)).alias("_tokens"))
    rate = F.round(keep_share * F.coalesce(F.col("_ratio"), F.lit(1.0)), 9)
    out = named.join(ratios, [f"_{d}" for d in DIMENSIONS], "left").withColumn("_rate", rate).withColumn("_probability", F.least(F.lit(1.0), "_rate"))
    weight = F.when(F.col("_probability") > 0, F.col("_rate") / F.col("_probability")).otherwise(F.lit(0.0))
    return out.select("row.*", "_tokens", "_topic", "_probability", (chance(F.col("_id"), seed) < F.col("_probability")).alias("_kept"), weight.alias("_weight"))
