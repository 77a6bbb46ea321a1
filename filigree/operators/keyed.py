"""Per-key helpers that stay whole and spread out when one key holds many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType


def last_per_key(rows: DataFrame, keys: list[str], arrival: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the last arrival. A mergeable aggregate, so a hot key is reduced before the shuffle."""
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct(*arrival, *[c for c in payload if c not in arrival])).alias("last"))
        .select(*keys, *[F.col(f"last.{c}").alias(c) for c in payload])
    )


def _slice_of(kind: DataType, column: Column, width: int) -> Column:
    """A coarse number that never falls as the column rises: numbers by ``width``, dates and times by day; other types have one slice."""
    if isinstance(kind, NumericType):
        return F.floor(column / width).cast("long")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.lit(0).cast("long")


def with_previous(
    rows: DataFrame, keys: list[str], arrival: list[str], payload: list[str], slice_width: int = 1_000_000
) -> DataFrame:
    """Adds ``previous``, the payload of the arrival just before, within the key (NULL for the first).

    A key is cut into slices of its first arrival column; rows are compared inside their slice, and a slice's first row with
    the end of the slice before. So a key that holds very many rows is spread over many tasks, and only one row per slice
    meets the others. NULL key parts are values like any other; NULL arrivals come first.
    """
    content, order = F.struct(*payload), F.struct(*arrival)
    cut = rows.withColumn("_slice", _slice_of(rows.schema[arrival[0]].dataType, F.col(arrival[0]), slice_width))
    # one struct: its NULL fields are equal to each other in a plain join, which then finds the rows where the window has put them
    cut = cut.withColumn("_key", F.struct(*keys, "_slice"))
    in_slice = Window.partitionBy("_key").orderBy(*arrival)
    inner = cut.withColumn("_prev", F.lag(content).over(in_slice))
    ends = cut.groupBy("_key").agg(F.max_by(content, order).alias("_tail"))
    across = Window.partitionBy(*[F.col("_key").getField(k) for k in keys]).orderBy("_key._slice")
    before = ends.withColumn("_before", F.lag("_tail").over(across)).where(F.col("_before").isNotNull()).select("_key", "_before")
    joined = inner.join(before, "_key", "left").withColumn("previous", F.coalesce("_prev", "_before"))
    return joined.select(*rows.columns, "previous")


def repeat_details(rows: DataFrame, keys: list[str], arrival: list[str], payload: list[str]) -> DataFrame:
    """Every repeated arrival with the payload it replaced and whether the two are identical."""
    seen = with_previous(rows, keys, arrival, payload)
    return seen.where(F.col("previous").isNotNull()).withColumn(
        "identical", F.struct(*payload).eqNullSafe(F.col("previous"))
    )


def repeats_per_key(rows: DataFrame, keys: list[str], arrival: list[str], payload: list[str]) -> DataFrame:
    """Per key with repeats: how many, and how many differ from the arrival just before them."""
    return (
        repeat_details(rows, keys, arrival, payload)
        .groupBy(*keys)
        .agg(F.count("*").alias("repeats"), F.count_if(~F.col("identical")).alias("conflicting"))
        .withColumn("identical", F.col("conflicting") == 0)
    )


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key. Spark limits each task to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_rank(values: DataFrame, keys: list[str], value: str, rank: Column, buckets: int = 4096, rounds: int = 2) -> DataFrame:
    """The ``rank``-th smallest value per key (``rank`` is an expression over the count ``n``, from 1).

    Equal values are counted first. Each key's range is cut into ``buckets`` equal parts; the part that holds the wanted rank follows
    from the part counts, and only that part goes on. It is cut again by its own range, so values that crowd together beside
    a few far ones are spread over parts too. Only what is left after ``rounds`` is ordered.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    ranks = counted.groupBy(*keys).agg(F.sum("c").alias("n")).withColumn("rest", rank)
    inside = counted.join(ranks, keys)
    for _ in range(rounds):
        inside = _part_of_rank(inside, keys, value, buckets)
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    ordered = inside.withColumn("upto", upto)
    return ordered.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("c") < F.col("rest"))).select(*keys, "n", value)


def _part_of_rank(counted: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """The rows (``value``, its count ``c``, ``n``, ``rest``) of the equal-width part that holds the ``rest``-th value of each key."""
    spans = counted.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    placed = counted.join(spans, keys).withColumn("part", F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int"))
    totals = placed.groupBy(*keys, "rest", "part").agg(F.sum("c").alias("c"))
    seen = totals.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("part")))
    target = seen.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("c") < F.col("rest"))).select(
        *keys, "part", (F.col("rest") - (F.col("upto") - F.col("c"))).alias("rest")
    )
    return placed.drop("rest").join(target, [*keys, "part"]).select(*keys, value, "c", "n", "rest")
