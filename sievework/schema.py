"""The catalog: one row for each file, and the limits by which rows match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("last_write", T.TimestampNTZType()),  # UTC
        T.StructField("status", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("p_hash", T.LongType()),
        T.StructField("d_hash", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("camera_make", T.StringType()),
        T.StructField("camera_model", T.StringType()),
        T.StructField("date_taken", T.TimestampNTZType()),  # the camera's clock
        T.StructField("frame_count", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("last_write", T.TimestampNTZType()), T.StructField("attributes", T.IntegerType())])

# The file endings that are scanned.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp", ".heic", ".heif")
REVIEW_FOLDER = "_Sievework Removed"

OK, DECODE_FAILED, UNREADABLE, UNEXPECTED, ONLINE_ONLY = "Ok", "DecodeFailed", "Unreadable", "UnexpectedError", "OnlineOnlySkipped"


@dataclass(frozen=True)
class Limits:
    """Both Hamming distances must be within these; same_time: capture times that are both known must be equal."""

    p: int
    d: int
    same_time: bool = False

    def __post_init__(self):
        if self.p < 0 or self.d < 0:
            raise ValueError("limits are not negative")


SAME_PHOTO, SIMILAR = Limits(4, 5, True), Limits(14, 14)
LEVELS: dict[str, Limits | None] = {"Exact": None, "SamePhoto": SAME_PHOTO, "Similar": SIMILAR}
