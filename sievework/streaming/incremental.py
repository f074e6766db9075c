"""Scanning as files arrive: new files of a folder go through the analysis in micro-batches, and the cache table takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions import text
from sievework.functions.hashing import fingerprint_udf
from sievework.functions.imaging import details_udf
from sievework.operators.cache import upserted
from sievework.schema import CATALOG, DECODE_FAILED, OK
from sievework.sources.listing import load_cache, save_cache
from sievework.sources.pixels import with_pixels


def arrivals(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of catalog rows of the files below folder. Spark's file source passes over names that begin with _ or .; sources.listing doesn't."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    got = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("last_write"), F.upper(F.sha2("content", 256)).alias("sha256"), fingerprint_udf("content").alias("fp"), details_udf("content").alias("dt"))
    values = {"status": F.when(F.col("fp.p_hash").isNull(), DECODE_FAILED).otherwise(OK), "p_hash": F.col("fp.p_hash"), "d_hash": F.col("fp.d_hash"), "width": F.col("dt.width"), "height": F.col("dt.height"), "camera_make": text.exif_text(F.col("dt.camera_make")), "camera_model": text.exif_text(F.col("dt.camera_model")), "date_taken": text.exif_date(F.col("dt.taken_raw")), "frame_count": F.coalesce("dt.frame_count", F.lit(1)), "error": F.lit(None)}
    return got.select(*[values.get(f.name, F.col(f.name) if f.name in got.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG.fields])


def keep_cache(rows: DataFrame, cache_path: str, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into the cache. A batch whose save fails isn't committed, and one that is run again leaves the same table."""

    def take(batch: DataFrame, _: int) -> None:
        rows = with_pixels(batch, batch)
        if not save_cache(upserted(load_cache(batch.sparkSession, cache_path), rows), cache_path):
            raise OSError(f"{cache_path} could not be saved")

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
