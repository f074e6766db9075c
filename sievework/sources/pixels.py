"""Perceptual hashes of formats that need a decoder of the JVM: Spark's image source reads them with ImageIO."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import HASHES, fingerprint
from sievework.functions.imaging import header, tiff_fields, upright
from sievework.schema import DECODE_FAILED, OK

JVM = (".jpg", ".jpeg", ".gif", ".tif", ".tiff")
BITS = 0x0102  # fixed value: TIFF's tag of bits a sample


def needs_jvm(path):
    """The formats above, but for names that begin with _ or ., which Spark's file sources pass over."""
    return F.lower(path).rlike(rf"/[^/_.][^/]*({'|'.join(re.escape(e) for e in JVM)})$")


def wide(content: bytes) -> bool:
    """Whether samples have over 8 bits, of which the image source keeps the lower ones of a grey image."""
    return content[:2] in (b"II", b"MM") and (tiff_fields(content)[0].get(BITS) or 8) > 8


@F.pandas_udf(HASHES)
def _hashes(path: pd.Series, data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    out = []
    for p, d, h, w, c in zip(path, data, height, width, channels):
        try:
            with open(p, "rb") as f:
                content = f.read()
            if h < 1 or c == 1 and wide(content):
                raise ValueError("no image that can be read")
            a = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))
            grey = a[:, :, 0] if c < 3 else np.rint(a[:, :, 2::-1] @ np.array([0.299, 0.587, 0.114]))
            out.append(fingerprint(upright(grey, header(content)[6] or 1)))
        except (ValueError, TypeError, OSError):
            out.append((None, None))
    return pd.DataFrame({"p_hash": pd.array([p for p, _ in out], "Int64"), "d_hash": pd.array([d for _, d in out], "Int64")})


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, p_hash, d_hash) of image files; nulls where one can't be decoded. Pixels go to Python in batches of limited bytes (spark.sql.execution.arrow.maxBytesPerBatch). Of a GIF or TIFF the first frame counts."""
    raw = spark.read.format("image").load([re.sub(r"([\\\[\]{}*?,^])", r"\\\1", p) for p in paths]).select("image.*")
    there = raw.select(F.url_decode(F.replace(F.regexp_replace("origin", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))).alias("path"), "data", "height", "width", "nChannels")
    return there.select("path", _hashes("path", "data", "height", "width", "nChannels").alias("fp")).select("path", "fp.*")


def with_pixels(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog rows, with hashes and status Ok for those of files (path) that the JVM can decode. The driver holds their names, as Spark's file index does."""
    paths = [r.path for r in files.filter(needs_jvm(F.col("path"))).select("path").distinct().toLocalIterator()]
    if not paths:
        return rows
    found = hashes(rows.sparkSession, paths).filter("p_hash IS NOT NULL").select(F.col("path").alias("_path"), F.col("p_hash").alias("_p"), F.col("d_hash").alias("_d"))
    mends = (F.col("status") == DECODE_FAILED) & F.col("_p").isNotNull()
    both = rows.join(found, F.col("path") == F.col("_path"), "left")
    return both.withColumns({"p_hash": F.when(mends, F.col("_p")).otherwise(F.col("p_hash")), "d_hash": F.when(mends, F.col("_d")).otherwise(F.col("d_hash")), "status": F.when(mends, OK).otherwise(F.col("status"))}).select(*rows.columns)
