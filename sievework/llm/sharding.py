"""Operator 1: shards of near-equal bytes from sampled splitters.

Records are ordered by a key. A size-weighted sample of the keys gives quantile splitters; these split the records into ranges, and each range that holds more than its share is sampled again and subdivided until none is overfull. Exact byte and row counts of the ranges turn positions inside a range into positions in the whole order, so the shards come out the same whatever the sample was: the sample decides only how the work is dealt out.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import cut, table, utf8

OVERHEAD = 16
SHARDS = 40
RANGE_ROWS = 1_000_000
"""Rows meant for a range."""
SAMPLE = 64
"""Expected sample keys for each range, fewer where that would make over SAMPLED in all; so what the driver holds is bounded."""
SAMPLED = 1 << 19
RANGES = 1 << 14


ORDERED_ID = "coalesce(cast(cast(doc_id as decimal(20,0)) + 10000000000000000000BD as string), '~')"
"""doc_id as text that sorts as the number does; null last."""


def weighted_sample(rows: DataFrame, key: str, size: Column, total: int, wanted: int) -> list[tuple[str, float]]:
    """Keys drawn with a chance in proportion to their size, by a hash of the key and of the row's place in the order, so that reruns draw the same; about `wanted` of them. Heavy records are sure to be drawn and carry their excess as a weight."""
    rate = wanted / max(total, 1)
    u = (F.xxhash64(F.lit(17), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    want = (size * F.lit(rate)).cast("double")
    got = rows.select(F.col(key).alias("k"), F.greatest(want, F.lit(1.0)).alias("w"), (u < want).alias("drawn")).filter("drawn").groupBy("k").agg(F.sum("w").alias("w"))
    return sorted((r.k, r.w) for r in got.collect())


def quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """The keys that split a weighted sample into parts of equal weight; a key that holds more than a part has one of its own, up to the next key of the sample."""
    if not sample or parts < 2:
        return []
    weights = np.array([w for _, w in sample])
    cum = np.cumsum(weights)
    at = np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts)
    after = np.flatnonzero(weights > cum[-1] / parts) + 1
    return sorted({sample[i][0] for i in (*at, *after[after < len(sample)])})


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most the key."""

    marks = np.array(splitters, dtype=str)

    @F.pandas_udf(T.IntegerType())
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, k.to_numpy(dtype=str), "right"), dtype="int32")

    return place(key)


def splitters(rows: DataFrame, key: str, size: str, parts: int) -> tuple[list[str], list]:
    """Splitters of rows into about `parts` ranges of equal size, and for each range its (rng, b bytes, n rows, lo, hi) in order. Key: a string that isn't null.

    Splitters come from a weighted sample. Ranges of over twice their share are sampled again, in one pass and at eight times the rate each time, and subdivided at the sample's quantiles and at their last key, until all fit or the overfull ones hold a single key."""
    all_ = rows.agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
    total, parts = all_.b or 0, max(1, min(parts, RANGES, all_.n or 1))
    share = max(1, total // parts)
    draws = min(SAMPLE, SAMPLED // parts)
    marks = quantiles(weighted_sample(rows, key, F.col(size), total, draws * parts), parts)
    while True:
        ranged = rows.withColumn("rng", range_of(F.col(key), marks))
        held = ranged.groupBy("rng").agg(F.sum(size).alias("b"), F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("rng").collect()
        over = {r.rng: r for r in held if r.b > 2 * share and r.lo < r.hi}
        if not over:
            return marks, held
        draws *= 8
        own: dict[int, list[tuple[str, float]]] = {rng: [] for rng in over}
        for k, w in weighted_sample(ranged.filter(F.col("rng").isin(list(over))), key, F.col(size), share, draws):
            own[bisect_right(marks, k)].append((k, w))
        # a range's last key parts it at least in two, so every pass gets on
        marks = sorted(set(marks).union(*({r.hi, *quantiles(own[rng], 2 * r.b // share + 1)} for rng, r in over.items())))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """Put every row of docs (doc_id, text) into one of `shards` shards whose sizes are as near to equal as whole records allow.

    The order is by a digest of the text, then doc_id: equal texts stand next to each other and share a shard unless a boundary falls among them; a group of copies larger than a shard is thus spread over several. A record's shard is where the middle of its bytes falls, so a shard is off its share by less than the largest record at either end. slot counts the records of a shard from 0 in that order.

    Null text: size 16, checksum 0, and the digest of the empty text. Null doc_id: after all others of its text. Repeated rows are each kept and take slots of their own. Empty table: empty result. Other columns of docs are ignored. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't `key`)."""
    body = utf8(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.concat(F.md5(body), F.lit(":"), F.expr(ORDERED_ID)).alias("key"))
    rows = cut(rows)
    marks, held = splitters(rows, "key", "size", ranges or max(4 * shards, rows.count() // RANGE_ROWS))
    ranged = rows.withColumn("rng", range_of(F.col("key"), marks))
    spark = docs.sparkSession
    total = sum(r.b for r in held)
    at, before = [], (0, 0)
    for r in held:
        at.append((r.rng, *before))
        before = (before[0] + r.b, before[1] + r.n)
    starts = spark.createDataFrame(at, "rng int, bytes_before long, rows_before long")  # one row for each range
    w = Window.partitionBy("rng").orderBy("key")
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(w)})
        .join(F.broadcast(starts), "rng")
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * (bytes_before + upto) - size) * {shards}) div {max(1, 2 * total)}")).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = cut(placed)
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


#: The SQL folds crc32 over the text's bytes with the usual reflected polynomial 0xEDB88320.
SQL = {
    "op1_sharding": """
WITH RECURSIVE bits AS (SELECT i::BIGINT AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, octet_length(encode(t)) + 16 AS size, md5(t) AS k, hex(encode(t)) AS h FROM d),
c AS (SELECT doc_id, size, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]))) AS text_crc32 FROM s, crc),
o AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
p AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""
}
