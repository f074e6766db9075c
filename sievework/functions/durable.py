"""Lineage cuts that survive lost executors: tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset a temporary folder takes its place on one machine, as in tests; on a cluster, whose executors wouldn't share it, this raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sievework-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more. Spark's cleaner deletes them once the driver's garbage is collected, which between short rounds it would seldom be."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as soon as it has ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into a checkpoint, without its history. Spark deletes it with its last user where spark.cleaner.referenceTracking.cleanCheckpoints says so."""
    checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        # a new frame: a frame takes the setting when it is made
        return df.select("*").checkpoint(eager=True)


class Shelf:
    """Compressed tables in the shared folder that belong to one computation. Each is a cut; it goes when it is dropped, the rest when the computation has ended. What outlives the computation is cut() before that."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/sievework/{what}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.made = 0

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self.tables.clear()
        self._delete(self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        to = f"{self.folder}/{self.made}"
        with freeing(self.spark):
            df.write.option("compression", "zstd").parquet(to)
        made = self.spark.read.schema(df.schema).parquet(to)
        self.tables.append((made, to))
        return made

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables that keep() returned; nothing that is still to be computed may read them. Others are passed over."""
        for df in dfs:
            for entry in [e for e in self.tables if e[0] is df]:
                self._delete(entry[1])
                self.tables.remove(entry)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
