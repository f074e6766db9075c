"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key with over 1/HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE hot keys, whatever the input."""


def line(rows: int) -> int:
    """Rows up to which a key isn't hot."""
    return max(rows // HOT_SHARE, 64)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left join right on key, where right has one row for each key and a count `n` of left rows that hold it.

    Keys with n over rows / HOT_SHARE are fewer than HOT_SHARE by counting, so they are broadcast and their left rows stay where they are; the other keys are joined by a shuffle in which none is hot. how: inner or left. Null keys match nothing."""
    most = line(rows)
    hot = F.broadcast(right.filter(F.col("n") > most))
    mark = F.broadcast(right.filter(F.col("n") > most).select(F.col(key).alias("_hot")))
    few = left.join(hot, key, "inner")
    rest = left.join(mark, F.col(key) == F.col("_hot"), "left_anti").join(right.filter(F.col("n") <= most).hint("shuffle_merge"), key, how)
    return few.unionByName(rest)


def known(left: DataFrame, counts: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """lookup() where only the count is wanted: left with `n`, 2 or more where counts (key, n > 1) has the key. The hot keys, fewer than HOT_SHARE by counting, are tested by value where the rows are."""
    most = line(rows)
    hot = [F.lit(r[0]) for r in counts.filter(F.col("n") > most).select(key).collect()]
    if not hot:
        return left.join(counts.hint("shuffle_merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.filter(is_hot).withColumn("n", F.lit(most + 1).cast("long"))
    return few.unionByName(left.filter(~is_hot).join(counts.filter(F.col("n") <= most).hint("shuffle_merge"), key, how))


def salted(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, rows: int, spread: str) -> DataFrame:
    """left inner join right on key, for right rows too large to broadcast: a hot key's right row is copied once for each `rows / HOT_SHARE` left rows that hold it, and its left rows are dealt over the copies by the column spread.

    counts: (key, n), the left rows of each key. Only the hot keys with their numbers of copies, under HOT_SHARE rows, are broadcast; the copies come to HOT_SHARE more right rows at most."""
    most = line(rows)
    hot = F.broadcast(counts.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_copies")))
    one = F.coalesce("_copies", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_copies")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_copies")
    return dealt.join(copied.hint("shuffle_merge"), [key, "_salt"]).drop("_salt")


BLOOM = 256
"""Buckets of 32,768 bits each in the filter of wanted(): 1 MB at any size."""


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bloom"), key), F.lit(BLOOM * 32_768))


def wanted(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is among ids, and by chance some others: those whose bit is set in a bitmap of fixed size, which is all that is broadcast. What follows joins exactly; this spares it the rows it would drop."""
    at = _bit(F.col(key))
    maps = ids.select(at.alias("_at")).groupBy((F.col("_at") / 32_768).cast("int").alias("_b")).agg(F.expr("bitmap_construct_agg(_at % 32768)").alias("_map"))
    one = df.withColumn("_at", at).withColumn("_b", (F.col("_at") / 32_768).cast("int")).join(F.broadcast(maps), "_b")
    byte = F.conv(F.hex(F.expr("substring(_map, cast((_at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return one.filter(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_at % 8 as int)) as int)")) != 0).drop("_at", "_b", "_map")
