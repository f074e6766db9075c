"""64-bit perceptual hashes: packing bits and distances as column expressions, the cosine transform in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = T.StructType([T.StructField("p_hash", T.LongType()), T.StructField("d_hash", T.LongType())])


def pack(bit, n: int = 64) -> Column:
    """The long whose bit i is set where bit(i) holds."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(bit(i), one(i)).otherwise(F.lit(0).cast("long"))))


def median_hash(values: Column) -> Column:
    """Bit i: value i is over the median of 64, the mean of the two in the middle."""
    wide = F.transform(values, lambda x: x.cast("double"))
    middle = F.element_at(F.array_sort(wide), 32) + F.element_at(F.array_sort(wide), 33)
    return F.transform(F.array(F.struct(wide.alias("v"), (middle / 2).alias("m"))), lambda s: pack(lambda i: F.get(s["v"], i) > s["m"]))[0]


def rising_hash(values: Column, n: int = 63) -> Column:
    """Bit i: value i + 1 is over value i."""
    return pack(lambda i: F.get(values, i + 1) > F.get(values, i), n)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


@lru_cache(1)
def cosines() -> np.ndarray:
    """cos((2x + 1) u pi / 64) for the 8 lowest of 32 frequencies."""
    u, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / 64).astype(np.float32)


def _long(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel().astype(np.uint8), bitorder="little").view(np.int64)[0])


def box(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Stretched to width x height, each pixel the mean of the area it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * m / n

    return weights(grey.shape[0], height) @ grey.astype(np.float64) @ weights(grey.shape[1], width).T


def p_hash(grey32: np.ndarray) -> int:
    """grey32: 32 x 32. The 64 lowest coefficients of its cosine transform against their median; bit v * 8 + u."""
    c = cosines()
    low = (c @ grey32.astype(np.float32) @ c.T).ravel()
    middle = np.sort(low)[31:33].sum(dtype=np.float32) / 2
    return _long(low > middle)


def d_hash(grey9: np.ndarray) -> int:
    """grey9: 8 rows of 9. Right neighbours that are brighter; bit y * 8 + x."""
    return _long(grey9[:, 1:] > grey9[:, :-1])


def fingerprint(grey: np.ndarray) -> tuple[int, int]:
    return p_hash(np.rint(box(grey, 32, 32))), d_hash(np.rint(box(grey, 9, 8)))


@F.pandas_udf(HASHES)
def fingerprint_udf(content: pd.Series) -> pd.DataFrame:
    """Hashes of encoded images; nulls where the bytes are no image that can be read."""
    from sievework.functions.imaging import grey_image

    out = []
    for b in content:
        try:
            out.append(fingerprint(grey_image(bytes(b))))
        except (ValueError, TypeError):
            out.append((None, None))
    return pd.DataFrame({"p_hash": pd.array([p for p, _ in out], "Int64"), "d_hash": pd.array([d for _, d in out], "Int64")})
