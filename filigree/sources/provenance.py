"""Retrieval provenance: append-only rows, one per retrieval, and the newest one behind a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, unsupported_reason

SOURCE_COLUMNS = [
    "source_id", "provider", "dataset", "command", "url", "retrieved_at", "as_of", "content_hash", "is_fallback",
    "provider_version",
]


def retrieval_rows(retrievals: DataFrame) -> DataFrame:
    """Landed retrievals as source rows; the id follows from what was retrieved and when."""
    rows = retrievals.withColumn("content_hash", content_hash(F.col("payload")))
    ident = F.xxhash64("provider", "dataset", "parameters", "content_hash", "retrieved_at")
    return rows.withColumn("source_id", ident).drop("payload")


def append_sources(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def newest_row_source(rows: DataFrame, sources: DataFrame, key: str, date: str) -> DataFrame:
    """Per key the retrieval of its newest row. The newest row is chosen before the join."""
    newest = (
        rows.join(sources.select("source_id"), "source_id", "left_semi")
        .groupBy(key)
        .agg(F.max_by("source_id", date).alias("source_id"))
    )
    return newest.join(sources.select(*SOURCE_COLUMNS), "source_id").select(key, *SOURCE_COLUMNS)


def facts_retrievals(sources: DataFrame) -> DataFrame:
    """Per issuer its latest company-facts retrieval, found by the ``cik`` in its parameters."""
    rows = sources.where((F.col("provider") == "sec") & (F.col("dataset") == "companyfacts"))
    keyed = rows.withColumn("cik", F.get_json_object("parameters", "$.cik")).where(F.col("cik").isNotNull())
    columns = [*SOURCE_COLUMNS, "detail"]
    return (
        keyed.groupBy("cik")
        .agg(F.max_by(F.struct(*columns), F.struct("retrieved_at", "source_id")).alias("s"))
        .select("cik", "s.*")
    )


def fundamentals_coverage(sources: DataFrame) -> DataFrame:
    """Issuers whose latest company-facts retrieval explains why they have no facts."""
    return (
        facts_retrievals(sources)
        .select("cik", unsupported_reason(F.col("detail")).alias("unavailable"))
        .where(F.col("unavailable").isNotNull())
    )


def source_summary(sources: DataFrame) -> DataFrame:
    return sources.groupBy("provider", "dataset").agg(
        F.count("*").alias("retrievals"),
        F.count_if("is_fallback").alias("fallbacks"),
        F.count("provider_version").alias("with_version"),
        F.count("as_of").alias("with_as_of"),
        F.max("retrieved_at").alias("last_retrieved"),
    )


def primary_else_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary source; the fallback source only for keys the primary lacks, marked as such."""
    gap = fallback.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.withColumn("is_fallback", F.lit(False)).unionByName(gap.withColumn("is_fallback", F.lit(True)))
