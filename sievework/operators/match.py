"""Files that look alike: pairs within both Hamming limits."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.hashing import hamming
from sievework.schema import Limits

NESTED_LOOP = 20_000
"""Rows up to which every pair is compared against a broadcast side: under 2 MB."""


def with_look(files: DataFrame) -> DataFrame:
    """look_p, look_d: the hashes a file is matched by; none for animated ones."""
    still = F.coalesce(F.col("frame_count"), F.lit(1)) <= 1
    both = F.col("p_hash").isNotNull() & F.col("d_hash").isNotNull()
    return files.withColumns({"look_p": F.when(still & both, F.col("p_hash")), "look_d": F.when(still & both, F.col("d_hash"))})


def representatives(files: DataFrame) -> DataFrame:
    """Of the files that have hashes to match by the first, by path, of each set of equal bytes; a file whose bytes aren't known is its own set."""
    w = Window.partitionBy(F.coalesce("sha256", F.concat(F.lit("path:"), F.col("path")))).orderBy(F.upper("path"), "path")
    return with_look(files).filter("look_p IS NOT NULL").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def same_time(a: Column, b: Column) -> Column:
    """Not known to differ."""
    return ~F.coalesce(a != b, F.lit(False))


def _block(h: Column, i: int, n: int) -> Column:
    lo, hi = 64 * i // n, 64 * (i + 1) // n
    return F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << min(hi - lo, 63)) - 1 if hi - lo < 64 else -1).cast("long"))


def similar_pairs(rows: DataFrame, key: str, limits: Limits, cols: tuple[str, str, str] = ("look_p", "look_d", "date_taken"), nested: int | None = None, within: str | None = None) -> DataFrame:
    """(a, b, p, d) for key a < key b within the limits, each pair once; rows with a null hash match nothing. within: a column that both must share.

    Up to `nested` rows (counted first) one side is broadcast and all pairs compared. More are brought together by blocks, without loss: hashes within p bits agree in one of p + 1 blocks, so with both limits small a pair shares one of (p + 1)(d + 1) block pairs; with larger p it agrees but for one bit in one of ceil((p + 1) / 2) blocks, and one side is also put under every such neighbour."""
    p, d, t = cols
    slim = rows.select(F.col(key).alias("k"), F.col(p).alias("p"), F.col(d).alias("d"), F.col(t).alias("t"), *([F.col(within).alias("w")] if within else [])).filter("p IS NOT NULL AND d IS NOT NULL")
    left, right = (slim.select(*[F.col(c).alias(f"{c}{s}") for c in slim.columns]) for s in "ab")
    test = (F.col("ka") < F.col("kb")) & (hamming(F.col("pa"), F.col("pb")) <= limits.p) & (hamming(F.col("da"), F.col("db")) <= limits.d)
    if limits.same_time:
        test &= same_time(F.col("ta"), F.col("tb"))
    if within:
        test = (F.col("wa") == F.col("wb")) & test
    if slim.limit((nested if nested is not None else NESTED_LOOP) + 1).count() <= (nested if nested is not None else NESTED_LOOP):
        found = left.join(F.broadcast(right), test)
    else:
        if (limits.p + 1) * (limits.d + 1) <= 64:
            keys = lambda s: F.explode(F.array(*[F.struct(F.lit(i * 64 + j).alias("no"), _block(F.col(f"p{s}"), i, limits.p + 1).alias("x"), _block(F.col(f"d{s}"), j, limits.d + 1).alias("y")) for i in range(limits.p + 1) for j in range(limits.d + 1)]))
            a, b = left.withColumn("key", keys("a")), right.withColumn("key", keys("b"))
        else:
            n = (limits.p + 2) // 2
            plain = [(i, _block(F.col("pa"), i, n)) for i in range(n)]
            near = [(i, _block(F.col("pb"), i, n).bitwiseXOR(F.lit(m))) for i in range(n) for m in [0, *(1 << j for j in range(64 * (i + 1) // n - 64 * i // n))]]
            a, b = (df.withColumn("key", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), x.alias("x")) for i, x in ks]))) for df, ks in ((left, plain), (right, near)))
        # a pair that meets under several keys is told once
        found = a.join(b, (a["key"] == b["key"]) & test).dropDuplicates(["ka", "kb"])
    return found.select(F.col("ka").alias("a"), F.col("kb").alias("b"), hamming(F.col("pa"), F.col("pb")).alias("p"), hamming(F.col("da"), F.col("db")).alias("d"))
