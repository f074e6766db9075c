"""Long work under way: reports at a bounded rate, runs that a later one supersedes, and scans whose finished parts outlive them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from sievework.functions import text
from sievework.operators import cache as caching
from sievework.schema import CATALOG
from sievework.sources.listing import analysed, listing, load_cache, save_cache
from sievework.sources.pixels import with_pixels

EVERY = 0.1  # fixed value: seconds between two reports
PARTS = 16


class Throttle:
    """claim() is true at most once in `every` seconds, whichever thread asks."""

    def __init__(self, every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.every, self.clock, self.last, self.lock = every, clock, None, threading.Lock()

    def claim(self) -> bool:
        with self.lock:
            now = self.clock()
            if self.last is not None and now - self.last < self.every:
                return False
            self.last = now
            return True


class Progress(StreamingQueryListener):
    """Tells report(rows so far) of a session's streams, throttled; the end is always told."""

    def __init__(self, report: Callable[[int], None], throttle: Throttle | None = None):
        self.report, self.throttle, self.rows = report, throttle or Throttle(), 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        if self.throttle.claim():
            self.report(self.rows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.report(self.rows)


class Latest:
    """Runs of which only the last one asked for counts: starting one cancels the jobs of those before it, and their results are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.tag = spark, threading.Lock(), None

    def run(self, make: Callable[[], object]):
        """make()'s result, made of Spark actions of this thread; None where a later run began meanwhile, though make() failed for it."""
        sc, mine = self.spark.sparkContext, f"sievework-{uuid.uuid4()}"
        with self.lock:
            before, self.tag = self.tag, mine
        if before is not None:
            sc.cancelJobsWithTag(before)
        sc.addJobTag(mine)
        try:
            made = make()
        except Exception:
            if self.tag == mine:
                raise
            return None
        finally:
            sc.removeJobTag(mine)
        return made if self.tag == mine else None


def _parts(spark: SparkSession, cache_path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path + ".parts")
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fold(spark: SparkSession, cache_path: str) -> None:
    """Take the parts that a scan finished into the cache. They are deleted only once the cache is saved, so a fold may be broken off and run again."""
    at, fs = _parts(spark, cache_path)
    if not fs.exists(at):
        return
    done = spark.read.schema(CATALOG).option("recursiveFileLookup", "true").parquet(str(at))
    if not save_cache(caching.upserted(load_cache(spark, cache_path), done), cache_path):
        raise OSError(f"{cache_path} could not be saved")
    fs.delete(at, True)


def scan_in_parts(spark: SparkSession, roots: list[str], cache_path: str, stopped: Callable[[], bool] = lambda: False, parts: int = PARTS, recursive: bool = True, online_only_too: bool = False) -> int:
    """Bring the cache up to date with the roots, a share of the files that it misses at a time; the number of shares done. Where stopped() turns true between two shares, or a job is cancelled or fails, the shares done before are in the cache all the same, and the next call goes on from there. A driver that dies leaves them beside the cache, where that call finds them."""
    fold(spark, cache_path)
    files, _ = listing(spark, roots, recursive)
    away = F.lit(False) if online_only_too else text.is_online_only(F.col("attributes"))
    rest = caching.misses(files, load_cache(spark, cache_path)).filter(~away)
    done = 0
    try:
        while done < parts and not stopped():
            share: DataFrame = rest.filter(F.pmod(F.xxhash64(F.upper("path")), F.lit(parts)) == done)
            caching.to_store(with_pixels(analysed(share), share)).select(*CATALOG.names).write.mode("overwrite").parquet(f"{cache_path}.parts/{done}")
            done += 1
    finally:
        fold(spark, cache_path)
    return done
