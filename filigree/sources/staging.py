"""Cutting lineage in the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in a single local process, as in tests; an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="filigree-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root


def stage(df: DataFrame, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """A frame that several branches read: computed once and written to the shared folder.

    A written table survives lost executors, is still read column by column, and has a known
    size for the join choice. With ``buckets`` it is a table bucketed by the column ``by``, so what groups or joins by it does
    not shuffle it again; the frame should already be partitioned by it, or every task writes a file for every bucket.
    """
    spark = df.sparkSession
    path = stream_folder(spark, "stage")
    if by is None or buckets is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"filigree_stage_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one staged table, or one stream's state or output."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
