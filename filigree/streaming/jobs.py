"""Structured Streaming jobs: landed documents, idempotent upserts, bars from ticks."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_cik
from ..sources.documents import fact_points, parse_companyfacts, stored_facts
from ..sources.keyed_table import KeyedTable


def read_stream(spark: SparkSession, folder: str, schema: str, *, fmt: str = "parquet", name_glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(folder)


def landed_documents(spark: SparkSession, folder: str, cik_pattern: str | None = r"CIK(\d{10})") -> DataFrame:
    """Newly landed documents as (cik, payload).

    One document per file with the issuer in the file name; with ``cik_pattern`` None one
    document per line that names its own issuer.
    """
    raw = spark.readStream.format("text").option("wholetext", cik_pattern is not None).load(folder)
    if cik_pattern is None:
        cik = normalize_cik(F.get_json_object("value", "$.cik"))
    else:
        cik = F.regexp_extract(F.input_file_name(), cik_pattern, 1)
    return raw.select(cik.alias("cik"), F.col("value").alias("payload"))


def land_facts(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Incremental landing: documents to fact rows, each file exactly once."""
    rows = stored_facts(fact_points(parse_companyfacts(documents)))
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(batches: DataFrame, table: KeyedTable, arrival: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert of every micro-batch into a bucketed table: only the buckets that a batch touches are read and written.

    Batch n commits as number n, so a batch that is replayed after its commit changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        replace(table, spark=batch.sparkSession).upsert(batch, batch_id, arrival)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_bars(ticks: DataFrame, *, lateness: str = "2 days") -> DataFrame:
    """Daily bars from ticks (security_id, ts, price, seq); ticks later than ``lateness`` are not waited for."""
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("security_id", F.window("ts", "1 day").alias("day"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.count("*").alias("volume"),
        )
        .select("security_id", F.col("day.start").cast("date").alias("trade_date"), "open", "high", "low", "close", "volume")
    )


_TICK_ENDS = "first_ts timestamp, first_seq bigint, last_ts timestamp, last_seq bigint"
BAR_COLUMNS = ["security_id", "trade_date", "open", "high", "low", "close", "volume"]
BAR_SCHEMA = f"security_id bigint, trade_date date, open double, high double, low double, close double, volume bigint, {_TICK_ENDS}"
BAR_KEYS = ("security_id", "trade_date")
LATE, NO_TIME = "LATE", "NO_TIME"


def partial_bars(ticks: DataFrame) -> DataFrame:
    """Bars of some ticks, with the places of their first and last one: partial bars of a day can be merged in any order."""
    order = F.struct("ts", "seq")
    ends = ticks.groupBy("security_id", F.col("ts").cast("date").alias("trade_date")).agg(
        F.min(F.struct("ts", "seq", "price")).alias("a"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by(F.struct("ts", "seq", "price"), order).alias("z"), F.count(F.lit(1)).alias("volume"),
    )
    return ends.select(
        "security_id", "trade_date", F.col("a.price").alias("open"), "high", "low", F.col("z.price").alias("close"), "volume",
        F.col("a.ts").alias("first_ts"), F.col("a.seq").alias("first_seq"), F.col("z.ts").alias("last_ts"), F.col("z.seq").alias("last_seq"),
    )


def merged_bar(old: Column, new: Column) -> Column:
    """One bar of two partial ones of the same day."""
    starts_old = F.struct(old["first_ts"], old["first_seq"]) <= F.struct(new["first_ts"], new["first_seq"])
    ends_old = F.struct(old["last_ts"], old["last_seq"]) >= F.struct(new["last_ts"], new["last_seq"])
    first = {c: F.when(starts_old, old[c]).otherwise(new[c]) for c in ("open", "first_ts", "first_seq")}
    last = {c: F.when(ends_old, old[c]).otherwise(new[c]) for c in ("close", "last_ts", "last_seq")}
    other = {"high": F.greatest(old["high"], new["high"]), "low": F.least(old["low"], new["low"]), "volume": old["volume"] + new["volume"]}
    return F.struct(*[c.alias(n) for n, c in ({k: new[k] for k in BAR_KEYS} | first | last | other).items()])


def late_folder(table: KeyedTable) -> str:
    return f"{table.path}/late"


def bar_stream(ticks: DataFrame, table: KeyedTable, checkpoint: str, *, lateness: str = "2 days") -> StreamingQuery:
    """Tick bars kept in a bucketed table, and every tick that came too late for them beside it.

    A tick is late if its day ended ``lateness`` before the newest tick of earlier batches. Late ticks, and ticks without a time, go to
    ``late_folder`` with their reason, one folder a batch, so ticks = ticks in bars + ticks there. What has been seen is kept in the table's commits:
    a replayed batch judges its ticks as it did before.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = replace(table, spark=spark)
        if batch_id in here.commits():
            return
        note = here.last(before=batch_id)[2]
        newest = json.loads(note)["newest"] if note else None
        ended = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
        late = F.lit(False) if newest is None else ended <= F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {lateness}")
        judged = batch.withColumn("reason", F.when(F.col("ts").isNull(), NO_TIME).when(late, LATE))
        seen = Observation()
        told = judged.observe(seen, F.max(F.unix_micros("ts")).alias("newest"), F.count(F.lit(1)).alias("ticks"), F.count("reason").alias("late"))
        told.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{late_folder(here)}/batch={batch_id}")
        got = seen.get
        top = max((n for n in (newest, got["newest"]) if n is not None), default=None)
        note = json.dumps({"newest": top, "ticks": got["ticks"], "late": got["late"]})
        here.upsert(partial_bars(judged.where("reason IS NULL")), batch_id, combine=merged_bar, note=note)

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_ticks(table: KeyedTable, schema: str) -> DataFrame:
    """Ticks that no bar holds, with their reason and batch."""
    return table.spark.read.schema(f"{schema}, reason string, batch bigint").parquet(late_folder(table))
