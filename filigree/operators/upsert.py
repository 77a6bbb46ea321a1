"""Idempotent upserts by business key, as join and rewrite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import KEYS
from .keyed import last_per_key

PROVENANCE = ("source_id",)
INSERTED, UPDATED, UNCHANGED, KEPT = "inserted", "updated", "unchanged", "kept"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def classify(stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], provenance=PROVENANCE, *, in_place: bool = False) -> DataFrame:
    """Every key of either side with its status. ``batch`` holds each key once.

    Content is compared without the provenance columns. Both sides are unique by key,
    so no join partition can grow by a repeated key. With ``in_place`` a side that an aggregate by key has dealt is not
    dealt again: keys without NULL are joined by plain equality, the few others beside them.
    """
    old = stored.select(F.struct(*columns).alias("old"), *[F.col(k).alias(f"_o_{k}") for k in keys])
    new = batch.select(F.struct(*columns).alias("new"), *[F.col(k).alias(f"_n_{k}") for k in keys])
    alike = _all([F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    if in_place:
        equal = _all([F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys])
        old_known, new_known = (_all([F.col(f"_{side}_{k}").isNotNull() for k in keys]) for side in "on")
        both = old.where(old_known).join(new.where(new_known), equal, "full_outer").unionAll(old.where(~old_known).join(new.where(~new_known), alike, "full_outer"))
    else:
        both = old.join(new, alike, "full_outer")
    same = _all([F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in columns if c not in provenance and c not in keys])
    status = (
        F.when(F.col("old").isNull(), INSERTED).when(F.col("new").isNull(), KEPT).when(same, UNCHANGED).otherwise(UPDATED)
    )
    return both.select("old", "new", status.alias("status"))


def merged(classified: DataFrame, columns: list[str]) -> DataFrame:
    """The table after the upsert; unchanged rows keep the provenance of their first retrieval."""
    write = F.col("status").isin(INSERTED, UPDATED)
    row = F.when(write, F.col("new")).otherwise(F.col("old"))
    return classified.select(row.alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in columns])


def status_rows(classified: DataFrame, columns: list[str]) -> DataFrame:
    return classified.select(
        F.coalesce("new", "old").alias("row"), "status"
    ).select(*[F.col(f"row.{c}").alias(c) for c in columns], "status")


def latest_in_batch(batch: DataFrame, keys: list[str], arrival: list[str], columns: list[str]) -> DataFrame:
    """Each key once: the last arrival in the batch."""
    rest = [c for c in columns if c not in keys]
    return last_per_key(batch, keys, arrival, rest).select(*columns)


def upsert_counts(classified: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """Inserted, updated, unchanged and in-batch duplicates as one row."""
    by_status = classified.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in (INSERTED, UPDATED, UNCHANGED)],
        F.count_if(F.col("status") != KEPT).alias("distinct_keys"),
    )
    total = batch_rows.agg(F.count("*").alias("batch_rows"))
    measures = by_status.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in (INSERTED, UPDATED, UNCHANGED, "distinct_keys")
    ]))).unionByName(total.select(F.lit("batch_rows").alias("name"), F.col("batch_rows").alias("n")))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("n")))

    return measures.agg(
        of(INSERTED).alias(INSERTED), of(UPDATED).alias(UPDATED), of(UNCHANGED).alias(UNCHANGED),
        (of("batch_rows") - of("distinct_keys")).alias("duplicates"),
    )


def counter_totals(per_table: list[DataFrame]) -> DataFrame:
    """Sums of upsert counters over several tables."""
    names = (INSERTED, UPDATED, UNCHANGED, "duplicates")
    return reduce(DataFrame.unionByName, per_table).agg(*[F.sum(n).alias(n) for n in names])


def upsert_table(stored: DataFrame, batch: DataFrame, table: str, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classified keys, new table) of a stored table by its own business key.

    The new table has all stored columns. A column that the batch lacks keeps its stored value and is NULL in
    inserted rows; a missing key column is an error. Batch columns that are not stored are only used for the arrival order.
    """
    keys, columns = KEYS[table], stored.columns
    absent = [c for c in columns if c not in batch.columns]
    if lost := [k for k in keys if k in absent]:
        raise ValueError(f"the batch lacks key columns of {table}: {', '.join(lost)}")
    unique = latest_in_batch(batch, keys, arrival, [c for c in columns if c not in absent])
    unique = unique.select(*[F.lit(None).cast(stored.schema[c].dataType).alias(c) if c in absent else F.col(c) for c in columns])
    classified = classify(stored, unique, keys, columns, (*PROVENANCE, *absent))
    kept = F.struct(*[F.coalesce(f"new.{c}", f"old.{c}").alias(c) if c in absent else F.col(f"new.{c}").alias(c) for c in columns])
    classified = classified.withColumn("new", F.when(F.col("new").isNotNull(), kept))
    return classified, merged(classified, columns)


# --- partitions ------------------------------------------------------------------------------------------------------


def merge_partitions(
    stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], partition: str
) -> DataFrame:
    """Rows of exactly the partitions a batch changes, for a dynamic partition overwrite.

    ``partition`` must follow from the key. Stored partitions the batch does not touch are
    pruned before the join, and touched partitions without a change are not rewritten.
    """
    touched = batch.select(partition).distinct()
    classified = classify(stored.join(touched, partition, "left_semi"), batch, keys, columns)
    result = F.when(F.col("status").isin(INSERTED, UPDATED), F.col("new")).otherwise(F.col("old"))
    rows = classified.select(result.alias("row"), "status").select(
        *[F.col(f"row.{c}").alias(c) for c in columns], "status"
    )
    changed = rows.where(F.col("status").isin(INSERTED, UPDATED)).select(partition).distinct()
    return rows.join(changed, partition, "left_semi").select(*columns)


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


# --- listing identity ------------------------------------------------------------------------------------------------

ATTRIBUTES = ["name", "exchange", "sector", "industry", "sic", "sector_source", "sic_source"]


def _with_meant_cik(stored: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """The batch with the cik that its cik-less rows mean, where that is certain, and the ticker's number of ciks in the batch."""
    held = stored.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.max("cik").alias("stored_cik"), F.max(F.col("cik").isNull()).alias("open"),
    )
    exact = stored.where("cik IS NOT NULL").select("ticker", "cik", F.lit(True).alias("exact")).distinct()
    brought = batch.where("cik IS NOT NULL").groupBy("ticker", "cik").agg(F.min(order).alias("first_seen")).join(exact, ["ticker", "cik"], "left")
    brought = brought.groupBy("ticker").agg(
        F.count("*").alias("batch_ciks"), F.max("cik").alias("batch_cik"),
        F.min_by("cik", F.when(F.col("exact").isNull(), F.col("first_seen"))).alias("adopter"),
    )
    meant = (
        F.when(F.col("open"), F.col("adopter"))
        .when(F.col("rows") == 1, F.col("stored_cik"))
        .when(F.col("rows").isNull() & (F.col("batch_ciks") == 1), F.col("batch_cik"))
    )
    known = batch.join(held, "ticker", "left").join(brought, "ticker", "left").withColumn("cik", F.coalesce("cik", meant))
    return known.select(*batch.columns, F.coalesce("batch_ciks", F.lit(0)).alias("batch_ciks"))


def merge_identities(stored: DataFrame, batch: DataFrame, arrival: list[str], attributes=None) -> DataFrame:
    """Incoming listings against stored ones. Identity is (ticker, cik); the cik may be learnt later.

    An exact match wins. A listing with a cik otherwise adopts the ticker's stored row without
    one (the first to arrive does). A listing without a cik means the ticker's only stored row, or if none is stored the only
    one in the batch, and is ambiguous when there are several. Rows of a batch that mean one security are one result row. An absent
    attribute never erases a stored one.
    """
    attributes = attributes or ATTRIBUTES
    order = F.struct(*arrival)
    batch = _with_meant_cik(stored, batch, order)
    incoming = batch.groupBy("ticker", "cik").agg(
        F.min(order).alias("first_seen"), F.max("batch_ciks").alias("batch_ciks"),
        *[F.max_by(a, F.when(F.col(a).isNotNull(), order)).alias(f"new_{a}") for a in attributes],
    )
    per_ticker = stored.groupBy("ticker").agg(
        F.count("*").alias("stored_rows"),
        F.min("security_id").alias("only_id"),
        F.min(F.when(F.col("cik").isNull(), F.col("security_id"))).alias("open_id"),
    )
    exact = stored.where(F.col("cik").isNotNull()).groupBy("ticker", "cik").agg(F.min("security_id").alias("exact_id"))
    rows = incoming.join(exact, ["ticker", "cik"], "left").join(per_ticker, "ticker", "left")
    # who adopts the ticker's open row: the first arrival with a cik and no exact match
    claims = (
        rows.where(F.col("cik").isNotNull() & F.col("exact_id").isNull() & F.col("open_id").isNotNull())
        .groupBy("ticker")
        .agg(F.min_by("cik", "first_seen").alias("adopter"))
    )
    rows = rows.join(claims, "ticker", "left")
    has_cik = F.col("cik").isNotNull()
    action = (
        F.when(has_cik & F.col("exact_id").isNotNull(), "matched")
        .when(has_cik & (F.col("adopter") == F.col("cik")), "adopted")
        .when(has_cik, "inserted")
        .when(F.col("open_id").isNotNull(), "matched")
        .when(F.coalesce("stored_rows", F.lit(0)) + F.coalesce("batch_ciks", F.lit(0)) == 0, "inserted")
        .when(F.col("stored_rows") == 1, "matched")
        .otherwise("ambiguous")
    )
    target = (
        F.when(has_cik, F.coalesce("exact_id", F.when(F.col("adopter") == F.col("cik"), F.col("open_id"))))
        .when(F.col("open_id").isNotNull(), F.col("open_id"))
        .when(F.col("stored_rows") == 1, F.col("only_id"))
    )
    rows = rows.select("ticker", F.col("cik").alias("new_cik"), action.alias("action"), target.alias("security_id"),
                       *[f"new_{a}" for a in attributes])
    old = stored.select("security_id", F.col("cik").alias("old_cik"), *[F.col(a).alias(f"old_{a}") for a in attributes])
    return rows.join(old, "security_id", "left").select(
        "security_id", "ticker", F.coalesce("new_cik", "old_cik").alias("cik"), "action",
        *[F.coalesce(f"new_{a}", f"old_{a}").alias(a) for a in attributes],
    )


def new_security_id(ticker: Column, cik: Column) -> Column:
    """A stable id for an inserted listing; it needs no counter and no single writer."""
    return F.xxhash64(ticker, F.coalesce(cik, F.lit("")))
