"""A table that holds each key once, cut into buckets of the key's hash, for upserts batch by batch.

A batch reads and writes only the buckets that its keys fall into; the files of all others stay as they are. Layout::

    data/batch=7/bucket=12/part-*.parquet     a bucket as batch 7 left it
    commits/batch=7/                          which batch last wrote each bucket, what batch 7 counted, and notes of the writer

A batch is there once its commit is complete. A batch that is tried again after a failure overwrites its own files; one that is replayed after its commit
changes nothing. Files that neither of the last two commits names are removed. The commit has one row for each bucket, so it grows with the number of
buckets and not with the table. There is one writer at a time, as a stream has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import INSERTED, UNCHANGED, UPDATED, classify

COUNTS = (INSERTED, UPDATED, UNCHANGED, "duplicates")
_COMMIT = f"bucket int, batch bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, note string"


@dataclass(frozen=True)
class KeyedTable:
    """``buckets`` is fixed when the first batch is written; size it so that a bucket is one task's work."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _fs(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, path: str, name: str, complete: bool = False) -> list[int]:
        """Numbers of the folders ``name=number`` in a folder, ascending."""
        fs, at = self._fs(path)
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        if complete:
            found = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{name}="))

    def _bucket(self, of: Callable[[str], Column] = F.col) -> Column:
        return F.pmod(F.xxhash64(*[of(k) for k in self.keys]), F.lit(self.buckets)).cast("int").alias("bucket")

    def commits(self) -> list[int]:
        """Numbers of the committed batches that are still known, oldest first."""
        return self._numbers(f"{self.path}/commits", "batch", complete=True)

    def commit(self, batch: int) -> tuple[dict[int, int], dict[str, int], str | None]:
        """(batch that last wrote each bucket, counts, note) as of a committed batch."""
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/batch={batch}").collect()
        head = next(r for r in rows if r["bucket"] == -1)
        return {r["bucket"]: r["batch"] for r in rows if r["bucket"] >= 0}, {c: head[c] for c in COUNTS}, head["note"]

    def last(self, before: int | None = None) -> tuple[dict[int, int], dict[str, int], str | None]:
        known = [c for c in self.commits() if before is None or c < before]
        return self.commit(known[-1]) if known else ({}, dict.fromkeys(COUNTS, 0), None)

    def _rows(self, written: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(written.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the last commit."""
        return self._rows(self.last()[0])

    def upsert(self, batch: DataFrame, number: int, arrival: list[str] | None = None, *, combine: Callable[[Column, Column], Column] | None = None, note: str | None = None) -> dict[str, int]:
        """Writes the last row of each key of ``batch`` by ``arrival`` (None: each key comes once) and returns what it counted.

        ``combine`` makes the new row of a stored and an incoming one (structs of all columns); without it the incoming row replaces the stored one.
        Counts come from the write itself. An empty batch commits no change.
        """
        if number in self.commits():
            return self.commit(number)[1]
        written, _, _ = self.last(before=number)
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        if arrival is None:
            unique = batch.select(*columns, F.lit(1).cast("long").alias("_times"))
        else:
            held = [*arrival, *[c for c in columns if c not in self.keys and c not in arrival]]
            unique = batch.groupBy(*self.keys).agg(F.max(F.struct(*held)).alias("last"), F.count(F.lit(1)).alias("_times"))
            unique = unique.select(*[F.col(c) if c in self.keys else F.col(f"last.{c}").alias(c) for c in columns], "_times")
        unique = unique.persist()
        try:
            touched = {r["bucket"] for r in unique.select(self._bucket()).distinct().collect()}
            counts, changed = self._write(unique, {b: n for b, n in written.items() if b in touched}, columns, number, combine) if touched else ({}, set())
        finally:
            unique.unpersist()
        counts = {c: counts.get(c) or 0 for c in COUNTS}
        now = written | dict.fromkeys(changed, number)
        head = (-1, number, *(counts[c] for c in COUNTS), note)
        none = (None,) * (len(COUNTS) + 1)
        self.spark.createDataFrame([head, *((b, n, *none) for b, n in sorted(now.items()))], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")
        self._remove_old()
        return counts

    def _write(self, unique: DataFrame, written: dict[int, int], columns: list[str], number: int, combine: Callable[[Column, Column], Column] | None) -> tuple[dict[str, int], set[int]]:
        """Writes the touched buckets; (counts, buckets with a changed row), both gathered by the write."""
        stored = self._rows(written).withColumn("_times", F.lit(0).cast("long"))
        both = classify(stored, unique, list(self.keys), [*columns, "_times"], ("source_id", "_times"))
        if combine is not None:
            old, new = F.col("old"), F.col("new")
            met = old.isNotNull() & new.isNotNull()
            made = combine(old, new)
            both = both.withColumns({"new": F.when(met, F.struct(*[made[c].alias(c) for c in columns], new["_times"].alias("_times"))).otherwise(new)})
            equal = F.struct(*[F.col(f"old.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in columns]))
            both = both.withColumn("status", F.when(met, F.when(equal, UNCHANGED).otherwise(UPDATED)).otherwise(F.col("status")))
        write = F.col("status").isin(INSERTED, UPDATED)
        row = F.when(write, F.col("new")).otherwise(F.col("old"))
        rows = both.select(row.alias("row"), "status", F.coalesce("new._times", F.lit(0)).alias("times"))
        # One task writes a bucket, so a bucket is one file; what is observed there is counted once even if earlier stages are run again.
        placed = rows.select(self._bucket(lambda k: F.col(f"row.{k}")), "row", "status", "times").repartition("bucket")
        seen = Observation()
        counted = placed.observe(
            seen, *[F.count_if(F.col("status") == s).alias(s) for s in (INSERTED, UPDATED, UNCHANGED)],
            F.sum(F.greatest(F.col("times") - 1, F.lit(0))).alias("duplicates"), F.array_join(F.collect_set(F.when(F.col("status").isin(INSERTED, UPDATED), F.col("bucket").cast("string"))), ",").alias("changed"),
        )
        counted.select("bucket", *[F.col(f"row.{c}").alias(c) for c in columns]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        got = seen.get
        return got, {int(b) for b in (got["changed"] or "").split(",") if b}

    def _remove_old(self) -> None:
        """Removes commits before the last two and files that neither of those names."""
        known = self.commits()
        kept = known[-2:]
        named = {(batch, bucket) for c in kept for bucket, batch in self.commit(c)[0].items()}
        for batch in self._numbers(f"{self.path}/data", "batch"):
            at = f"{self.path}/data/batch={batch}"
            for bucket in self._numbers(at, "bucket"):
                if (batch, bucket) not in named:
                    self._delete(f"{at}/bucket={bucket}")
            if not any(n == batch for n, _ in named):
                self._delete(at)
        for batch in known[:-2]:
            self._delete(f"{self.path}/commits/batch={batch}")

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)


