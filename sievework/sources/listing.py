"""Where files come from: a recursive listing as a Spark data source, their bytes, and what a scan makes of them."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.functions import text
from sievework.functions.hashing import fingerprint_udf
from sievework.functions.imaging import details_udf
from sievework.operators import cache as caching
from sievework.schema import CATALOG, DECODE_FAILED, EXTENSIONS, LISTING, OK, ONLINE_ONLY, REVIEW_FOLDER, UNREADABLE
from sievework.sources.pixels import with_pixels

HIDDEN, SYSTEM = 0x2, 0x4  # attribute bits
FAN_OUT = 64
"""Folders that are listed as one task each; deeper ones with their ancestor."""


def _attributes(s: os.stat_result, name: str) -> int:
    """The file system's attribute bits; where it has none, a leading dot tells nothing: such files are listed."""
    return getattr(s, "st_file_attributes", 0)


def candidate(path: str) -> tuple:
    """The listing row of one file."""
    s = os.stat(path)
    return path, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None), _attributes(s, os.path.basename(path))


def availability(path: str) -> str:
    """Local, OnlineOnly (its bytes are elsewhere; asking doesn't fetch them) or Unavailable, as the disk has it now."""
    try:
        s = os.stat(path)
    except (OSError, ValueError):
        return "Unavailable"
    return "OnlineOnly" if _attributes(s, os.path.basename(path)) & text.ONLINE_ONLY_BITS else "Local"


def may_enter(path: str, review: str = REVIEW_FOLDER) -> bool:
    """Not a review folder, whatever its case, and not a link."""
    return os.path.basename(path).upper() != review.upper() and not os.path.islink(path)


def walk(root: str, extensions: tuple[str, ...], recursive: bool = True) -> Iterator[tuple]:
    """Rows of the files below root with one of the endings; hidden and system entries and what can't be read are passed over. No file is opened."""
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        try:
            if e.is_dir(follow_symlinks=False):
                if recursive and may_enter(e.path):
                    yield from walk(e.path, extensions)
            elif os.path.splitext(e.name)[1].lower() in extensions and stat.S_ISREG((s := e.stat()).st_mode) and not _attributes(s, e.name) & (HIDDEN | SYSTEM):
                yield candidate(e.path)
        except OSError:
            continue


class _Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))

    def partitions(self):
        """The root's own files, and each folder below it down to where there are FAN_OUT tasks."""
        if not self.recursive:
            return [_Folder(self.root, False)]
        flat, deep = [self.root], [self.root]
        parts = []
        while deep and len(parts) + len(deep) < FAN_OUT:
            folder = deep.pop(0)
            parts.append(_Folder(folder, False))
            try:
                deep += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and may_enter(e.path))
            except OSError:
                continue
        return parts + [_Folder(f, True) for f in deep] or [_Folder(flat[0], True)]

    def read(self, partition):
        yield from walk(partition.path, self.extensions, partition.recursive)


class ListingSource(DataSource):
    """spark.read.format("sievework_listing").option("path", root): path, size_bytes, last_write, attributes. Unlike the file sources it lists names that begin with _ or . too. Folders are on a disk that driver and executors share."""

    @classmethod
    def name(cls):
        return "sievework_listing"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _Reader(self.options)


def listing(spark: SparkSession, roots: list[str], recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(listing, missing): files below the roots, each once though roots overlap, and a catalog row for each root that isn't there."""
    spark.dataSource.register(ListingSource)
    seen: dict[str, str] = {}
    for r in roots:
        full = os.path.abspath(r)
        seen.setdefault(full.upper(), full)
    there = [r for r in seen.values() if os.path.isdir(r)]
    read = [spark.read.format("sievework_listing").option("path", r).option("recursive", str(recursive)).load() for r in there]
    found = reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], LISTING)
    files = found.withColumn("_u", F.upper("path")).dropDuplicates(["_u"]).drop("_u")
    gone = spark.createDataFrame([(r, 0, datetime(1970, 1, 1), UNREADABLE, "The folder can't be read.") for r in seen.values() if r not in there], "path string, size_bytes long, last_write timestamp_ntz, status string, error string")
    return files, _as_catalog(gone)


def _as_catalog(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG.fields])


def analysed(files: DataFrame, fingerprint=fingerprint_udf, details=details_udf) -> DataFrame:
    """Catalog rows of files (path, size_bytes, last_write) from their bytes, each read once. What can't be read or decoded is a row that says so; a file that can't be decoded keeps its digest. fingerprint, details: other decoders as pandas UDFs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = problem = None
                try:
                    with open(batch.column("path")[i].as_py(), "rb") as f:
                        content = f.read()
                except OSError as e:
                    problem = type(e).__name__
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([problem], pa.string())], [*row.schema.names, "content", "problem"])

    got = files.select("path", "size_bytes", "last_write").mapInArrow(read, "path string, size_bytes long, last_write timestamp_ntz, content binary, problem string")
    got = got.select("*", F.upper(F.sha2("content", 256)).alias("sha256"), fingerprint("content").alias("fp"), details("content").alias("dt")).drop("content")
    status = F.when(F.col("problem").isNotNull(), UNREADABLE).when(F.col("fp.p_hash").isNull(), DECODE_FAILED).otherwise(OK)
    rows = got.select("path", "size_bytes", "last_write", status.alias("status"), "sha256", "fp.p_hash", "fp.d_hash", "dt.width", "dt.height", text.exif_text(F.col("dt.camera_make")).alias("camera_make"), text.exif_text(F.col("dt.camera_model")).alias("camera_model"), text.exif_date(F.col("dt.taken_raw")).alias("date_taken"), F.coalesce("dt.frame_count", F.lit(1)).alias("frame_count"), F.col("problem").alias("error"))
    return _as_catalog(rows)


def scan(spark: SparkSession, roots: list[str], cache: DataFrame | None = None, recursive: bool = True, online_only_too: bool = False) -> DataFrame:
    """The catalog of the roots, with from_cache. A file whose path, size and time the cache knows isn't opened; one whose bytes are elsewhere is left unread unless asked for; the rest are analysed."""
    files, missing = listing(spark, roots, recursive)
    old = cache if cache is not None else spark.createDataFrame([], CATALOG)
    hit = caching.hits(files, old)
    rest = caching.misses(files, old)
    away = F.lit(False) if online_only_too else text.is_online_only(F.col("attributes"))
    skipped = _as_catalog(rest.filter(away).withColumn("status", F.lit(ONLINE_ONLY)))
    wanted = rest.filter(~away)
    fresh = with_pixels(analysed(wanted), wanted)
    return _as_catalog(hit).withColumn("from_cache", F.lit(True)).unionByName(fresh.unionByName(skipped).unionByName(missing).withColumn("from_cache", F.lit(False)))


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty where there is none or it has another form. Where a save was broken off between its two renames the table before it is read. An older one without frame counts is migrated."""
    from pyspark.errors import AnalysisException

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".old"))
    fs = at.getFileSystem(conf)
    try:
        found = spark.read.parquet(path if fs.exists(at) or not fs.exists(old) else path + ".old")
        if "frame_count" not in found.columns:
            return _as_catalog(caching.migrated(found.withColumn("frame_count", F.lit(None).cast("int"))))
        return found.select(*CATALOG.names)
    except AnalysisException:
        return spark.createDataFrame([], CATALOG)


def save_cache(rows: DataFrame, path: str) -> bool:
    """Write the cache beside the old one, then put it in its place; False where that fails, the old one then stays."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at, tmp, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    try:
        caching.to_store(rows).select(*CATALOG.names).write.mode("overwrite").parquet(path + ".new")
        if fs.exists(at):
            fs.delete(old, True)
            fs.rename(at, old)
        done = fs.rename(tmp, at)
        fs.delete(old, True)
        return bool(done)
    except Exception as e:  # noqa: BLE001  a cache that can't be saved costs time, not results
        print(f"cache not saved: {type(e).__name__}")
        return False
