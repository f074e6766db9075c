"""The scan cache: results that depend on a file's bytes alone, found again by path, size and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text

CACHED = ("Ok", "DecodeFailed")
# Endings that may hold more than one frame.
MAYBE_ANIMATED = (".gif", ".png", ".apng", ".webp")


def hits(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached rows that still hold for files of the listing, under the listing's paths."""
    c = cache.withColumn("_u", F.upper("path")).dropDuplicates(["_u"])
    l = listing.select(F.col("path").alias("_path"), F.upper("path").alias("_u"), F.col("size_bytes").alias("_size"), F.col("last_write").alias("_time"))
    return l.join(c, "_u").filter("_size = size_bytes AND _time = last_write").withColumn("path", F.col("_path")).drop("_u", "_path", "_size", "_time")


def misses(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """The files that must be read: no entry of their path, size and time."""
    have = cache.select(F.upper("path").alias("_u"), F.col("size_bytes").alias("_size"), F.col("last_write").alias("_time"))
    return listing.join(have, (F.upper("path") == F.col("_u")) & (F.col("size_bytes") == F.col("_size")) & (F.col("last_write") == F.col("_time")), "left_anti")


def to_store(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("status").isin(*CACHED))


def pruned(cache: DataFrame, seen: DataFrame, roots: list[str], recursive: bool = True) -> DataFrame:
    """The cache without entries inside the scanned roots that weren't seen. Only after a scan that ran to its end. The roots are the user's few folders."""
    test = text.is_inside if recursive else text.is_directly_inside
    inside = reduce(lambda a, b: a | b, [test(F.col("path"), F.lit(r)) for r in roots], F.lit(False))
    gone = cache.select("path").filter(inside).join(seen.select(F.upper("path").alias("_u")), F.upper("path") == F.col("_u"), "left_anti")
    return cache.join(gone, "path", "left_anti")


def migrated(old: DataFrame) -> DataFrame:
    """Entries without a frame count: those of endings that may be animated are read again, the others have one frame."""
    return old.filter(~F.lower(text.extension(F.col("path"))).isin(*MAYBE_ANIMATED)).withColumn("frame_count", F.coalesce("frame_count", F.lit(1)))


def upserted(cache: DataFrame, scanned: DataFrame) -> DataFrame:
    """The cache with what was scanned in place of older entries."""
    new = to_store(scanned)
    return cache.join(new.select(F.upper("path").alias("_u")), F.upper("path") == F.col("_u"), "left_anti").unionByName(new, allowMissingColumns=True)
