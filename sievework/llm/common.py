"""What the operators share: the folder all executors see, lineage cuts, and joins that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.durable import Shelf, checkpoint_dir, cut, freeing, release
from sievework.functions.hot import known, lookup, salted, wanted

__all__ = ["Shelf", "cut", "keep", "known", "lookup", "lower_ascii", "release", "salted", "scratch", "slices", "table", "tasks", "utf8", "wanted"]

WHITE = "[^\\x20\\x09-\\x0D]+"
"""A word of the contracts on sizes and shingles."""


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the caller's session owns what is written there."""
    return f"{checkpoint_dir(spark)}/sievework/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """df as a compressed table in the shared folder: a cut for what would be large as a checkpoint."""
    to = scratch(df.sparkSession, what)
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch, size: int = 4 << 20):
    """An Arrow batch in parts of about `size` bytes."""
    step = max(1, min(batch.num_rows, size * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
