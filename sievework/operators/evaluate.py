"""How good the limits are: recall and false positives over a grid, and precision from labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.hashing import hamming
from sievework.schema import OK, ONLINE_ONLY

# The buckets pairs are labelled in, and the normal quantile of a 95 % interval.
BUCKETS = (("0–2", 0, 2), ("3–4", 3, 4), ("5–6", 5, 6), ("7–8", 7, 8))
Z = 1.959964
STILL = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
GRID = (2, 14)
TOP = 100


def grid(spark) -> DataFrame:
    n = GRID[1] - GRID[0] + 1
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).select((F.col("i") + GRID[0]).alias("p_limit"), (F.col("j") + GRID[0]).alias("d_limit"))


def _counts(distances: DataFrame, by: list[str]) -> DataFrame:
    """Distances as counts of (p, d): the grid meets a few thousand counts, not the pairs."""
    return distances.groupBy(*by, "p", "d").agg(F.count("*").alias("c"))


def recall(variants: DataFrame, kind: str | None = None) -> DataFrame:
    """variants (kind, p, d) -> for each pair of limits the share within both; null where there is nothing."""
    rows = variants if kind is None else variants.filter(F.col("kind") == kind)
    c = _counts(rows, [])
    return grid(variants.sparkSession).join(F.broadcast(c), F.lit(True), "left").groupBy("p_limit", "d_limit").agg(F.try_divide(F.coalesce(F.sum(F.when((F.col("p") <= F.col("p_limit")) & (F.col("d") <= F.col("d_limit")), F.col("c"))), F.lit(0)), F.sum("c")).alias("recall"))


def false_positives(pairs: DataFrame) -> DataFrame:
    """pairs (p, d) of unrelated files -> for each pair of limits how many are within both."""
    c = _counts(pairs, [])
    return grid(pairs.sparkSession).join(F.broadcast(c), F.lit(True), "left").groupBy("p_limit", "d_limit").agg(F.coalesce(F.sum(F.when((F.col("p") <= F.col("p_limit")) & (F.col("d") <= F.col("d_limit")), F.col("c"))), F.lit(0)).alias("false_positives"))


def nearest_rank(values: DataFrame, by: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(by, percent, value): the value at place ceil(percent / 100 * n), the first at least; found from running counts of the distinct values."""
    w = Window.partitionBy(by).orderBy(value)
    counts = values.groupBy(by, value).agg(F.count("*").alias("c")).withColumns({"upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(by))})
    at = counts.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / 100)))
    return at.groupBy(by, "percent").agg(F.min(value).alias(value))


def top_false_positives(pairs: DataFrame, n: int = TOP) -> DataFrame:
    """The n closest of unrelated pairs (a, b, p, d); ties by their ids."""
    return pairs.orderBy(F.greatest("p", "d"), F.col("p") + F.col("d"), "a", "b").limit(n)


def bucket_of(p: Column, d: Column) -> Column:
    """The name of the bucket of max(p, d); null outside all."""
    m, out = F.greatest(p, d), F.lit(None).cast("string")
    for name, lo, hi in BUCKETS:
        out = F.when(m.between(lo, hi), name).otherwise(out)
    return out


def look_alike_pairs(members: DataFrame) -> DataFrame:
    """keeper x member for the members that hashes decide."""
    return members.filter("rank > 1 AND kind <> 'Identical' AND p_distance IS NOT NULL AND d_distance IS NOT NULL").select(F.col("group_id").alias("keeper"), F.col("path").alias("member"), F.col("p_distance").alias("p"), F.col("d_distance").alias("d"))


def populations(pairs: DataFrame) -> DataFrame:
    """(bucket, population) with the empty ones, and a row '' for the pairs outside all."""
    per = pairs.groupBy(F.coalesce(bucket_of(F.col("p"), F.col("d")), F.lit("")).alias("bucket")).agg(F.count("*").alias("c"))
    names = pairs.sparkSession.createDataFrame([(b[0],) for b in BUCKETS] + [("",)], "bucket string")
    return names.join(per, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("population"))


def stratified(pairs: DataFrame, per_bucket: int, seed: int) -> DataFrame:
    """Up to per_bucket pairs of each bucket in the order of a seeded digest of their paths: the draw depends on seed and pairs alone."""
    if per_bucket < 1:
        raise ValueError("per_bucket is 1 at least")
    rows = pairs.withColumns({"bucket": bucket_of(F.col("p"), F.col("d")), "draw": F.md5(F.concat_ws("|", F.lit(str(seed)), "keeper", "member"))}).filter("bucket IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "keeper", "member"))).filter(F.col("nth") <= per_bucket)


def wilson(share: Column, n: Column) -> Column:
    """struct<low, high>; null unless n > 0. n may be fractional."""
    z2 = Z * Z
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = Z / (1 + z2 / n) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def bucket_precision(labels: DataFrame, buckets: DataFrame) -> DataFrame:
    """labels (bucket, verdict same, different or null), buckets (bucket, hi, population) -> labelled, same, unlabelled, precision and its interval; a bucket without labels has none."""
    per = labels.groupBy("bucket").agg(F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "same").alias("same"), F.count_if(F.col("verdict").isNull()).alias("unlabelled"))
    out = buckets.join(per, "bucket", "left").fillna(0, ["labelled", "same", "unlabelled"])
    share = F.try_divide(F.col("same").cast("double"), F.col("labelled"))
    return out.withColumn("precision", share).withColumn("interval", wilson(F.col("precision"), F.col("labelled").cast("double")))


def overall_precision(per_bucket: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit that ends a bucket: precision of the buckets up to it weighted by population, the effective sample size 1 / sum(w^2 / n), and the interval. Null where the population is 0 or a populated bucket has no label."""
    edges = per_bucket.select("hi").distinct().join(F.broadcast(per_bucket.sparkSession.createDataFrame([(t,) for t in limits], "hi int")), "hi").withColumnRenamed("hi", "up_to")
    rows = edges.join(F.broadcast(per_bucket.filter("population > 0")), F.col("hi") <= F.col("up_to"), "left")
    whole = F.sum("population").over(Window.partitionBy("up_to"))
    w = rows.withColumn("w", F.col("population") / whole)
    out = w.groupBy("up_to").agg(F.count("hi").alias("b"), F.count_if(F.col("labelled") == 0).alias("bare"), F.sum(F.col("w") * F.col("precision")).alias("s"), F.sum(F.try_divide(F.col("w") * F.col("w"), F.col("labelled"))).alias("v"))
    ok = (F.col("b") > 0) & (F.col("bare") == 0)
    return out.select("up_to", F.when(ok, F.col("s")).alias("precision"), F.when(ok, F.try_divide(F.lit(1.0), F.col("v"))).alias("n_eff")).withColumn("interval", wilson(F.col("precision"), F.col("n_eff")))


def rule_effect(labels: DataFrame, times: DataFrame, buckets: DataFrame) -> DataFrame:
    """What the capture-time rule does to the labelled pairs of each bucket, with a row '' for all: sampled, removed, removed of each verdict, and the population scaled to what is kept (half away from zero)."""
    t = times.select("path", "date_taken")
    both = labels.join(t.select(F.col("path").alias("keeper"), F.col("date_taken").alias("ka")), "keeper", "left").join(t.select(F.col("path").alias("member"), F.col("date_taken").alias("kb")), "member", "left")
    gone = F.coalesce(F.col("ka") != F.col("kb"), F.lit(False))
    per = both.groupBy("bucket").agg(F.count("*").alias("sampled"), F.count_if(gone).alias("removed"), F.count_if(gone & (F.col("verdict") == "same")).alias("removed_same"), F.count_if(gone & (F.col("verdict") == "different")).alias("removed_different"))
    rows = buckets.join(per, "bucket", "left").fillna(0, ["sampled", "removed", "removed_same", "removed_different"])
    rows = rows.withColumn("kept_population", F.when(F.col("sampled") == 0, F.col("population")).otherwise(F.round(F.col("population") * (F.col("sampled") - F.col("removed")) / F.col("sampled")).cast("long")))
    cols = ("population", "sampled", "removed", "removed_same", "removed_different", "kept_population")
    return rows.select("bucket", *cols).unionByName(rows.agg(*[F.sum(c).alias(c) for c in cols]).withColumn("bucket", F.lit("")))


def originals(files: DataFrame, seed: int) -> DataFrame:
    """The files a synthetic run may draw: still formats whose bytes are here, with draw, the digest that orders them for this seed. The order depends on seed and paths alone."""
    still = F.lower("path").rlike(f"[.]({'|'.join(STILL)})$")
    return files.filter(still & (F.col("status") != ONLINE_ONLY)).withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), "path")))


def drawn(files: DataFrame, seed: int, n: int) -> DataFrame:
    """The first n originals in draw order that could be decoded, with nth from 1: what drawing one by one until n are decoded would give. Each partition gives n rows at most to the sort."""
    first = originals(files, seed).filter(F.col("status") == OK).orderBy("draw", "path").limit(n)
    return first.withColumn("nth", F.row_number().over(Window.orderBy("draw", "path")))


def times_read(labels: DataFrame, files: DataFrame) -> DataFrame:
    """The labelled paths (keeper, member), each once, with date_taken; readable is false where the catalog has none or could not decode it."""
    paths = labels.select(F.col("keeper").alias("path")).unionByName(labels.select(F.col("member").alias("path"))).distinct()
    return paths.join(files.select("path", "date_taken", F.col("status").alias("_s")), "path", "left").select("path", "date_taken", F.coalesce(F.col("_s") == OK, F.lit(False)).alias("readable"))


def unreadable(read: DataFrame) -> DataFrame:
    """One row: how many labelled paths could not be read. read: of times_read."""
    return read.agg(F.count("*").alias("paths"), F.count_if(~F.col("readable")).alias("unreadable"))


def variant_distances(variants: DataFrame, originals_: DataFrame, key: str) -> DataFrame:
    """variants joined with their original on key, with the distances p and d of the hashes; a variant whose original is missing or without hashes has no row."""
    o = originals_.filter("p_hash IS NOT NULL AND d_hash IS NOT NULL").select(key, F.col("p_hash").alias("_p"), F.col("d_hash").alias("_d"))
    return variants.join(o, key).withColumns({"p": hamming(F.col("p_hash"), F.col("_p")), "d": hamming(F.col("d_hash"), F.col("_d"))}).drop("_p", "_d")


def beyond(pairs: DataFrame, n: int = TOP) -> DataFrame:
    """One row: how many pairs a report of the first n leaves out, and the line that says so (null: none)."""
    rest = F.greatest(F.count("*") - n, F.lit(0))
    return pairs.agg(rest.alias("more")).withColumn("line", F.when(F.col("more") > 0, F.concat(F.lit("… and "), F.col("more").cast("string"), F.lit(" more"))))
