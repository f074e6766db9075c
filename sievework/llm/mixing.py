"""Operator 4: mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document d of source s gets a rate w = min(cap, exp(lambda_s * x)), x = (size / mean size of the source) ** TILT, which is the rate that strays least from 1 in relative entropy (a document's strain counting size / x) while the source's words come to its target: sum of w * size = target. lambda is the root of the convex dual's gradient, found by Newton steps kept inside a bracket. A rate depends on source and size alone, so the steps run over counts of (source, size) and not over documents. Rates become whole copies by systematic rounding in order of size: the running sum of rates is rounded, and a document takes the steps it spans, so errors cancel between neighbours of like size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.functions.hot import line

from .common import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
TILT = 0.25
"""0: one rate for a whole source. 1: a document's strain doesn't depend on its size, so that long documents take most of the change."""
STEPS = 400
"""Newton steps, halvings of the bracket among them, after which something is wrong: a halving adds a bit, so far fewer are enough."""
CLOSE = 1e-9
"""Newton stops when every source's words are this near to its target, relative to it."""


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; null: none. Counted as the places where such a run starts: white-space runs become one blank, and blanks are what is left beside the other characters."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "))) + 1).cast("long")


def exact_sum(x: Column) -> Column:
    """The sum in decimals, which is the same in whatever order rows come: reruns agree to the last bit."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n) -> source, source_size, target: shares of all words by weight, none above cap times its source.

    Sources by code point, null last, take the weights in turn. Capping the sources whose share is too high and dealing out the excess by weight until none is above ends at one water level L: target = min(cap * size, weight * L). Sorted by cap * size / weight, the capped ones come first, so L follows from running sums. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("n").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    return (
        per.withColumn("weight", w)
        .withColumn("full", (F.col("source_size") * cap).cast("double"))
        .withColumn("full_at", F.col("full") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
        # the first source that the level doesn't fill sets it
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(whole)["level"])
        .select("source", "source_size", F.least("full", F.col("weight") * F.col("level")).alias("target"))
    )


def rates(counts: DataFrame, goal: DataFrame, cap: int = CAP, tilt: float = TILT) -> DataFrame:
    """counts (source, n, c) with goal (source, source_size, target) -> source, lam: the dual's root for each source with 0 < target < cap * size. The others need none: their rate is 0 or cap."""
    mean = counts.groupBy("source").agg((F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean"))
    goal = goal.alias("g").join(mean.alias("m"), F.expr("g.source <=> m.source")).select("g.source", "source_size", "target", "mean")
    ratio = F.log(F.col("target") / F.col("source_size"))
    state = cut(goal.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)).select("source", "target", "mean", ratio.alias("lam"), F.lit(-1e6).cast("double").alias("lo"), F.lit(1e6).cast("double").alias("hi"), F.lit(1.0).alias("off")))
    for _ in range(STEPS):
        s, k = state.alias("s"), counts.filter("n > 0").alias("k")
        x = F.pow(F.col("n") / F.col("mean"), F.lit(tilt))
        u = F.col("lam") * x
        w = F.when(u < F.log(F.lit(float(cap))), F.exp(u)).otherwise(F.lit(float(cap)))
        words = F.col("n") * F.col("c")
        sums = (
            k.join(s, F.expr("k.source <=> s.source"))
            .groupBy("s.source", "target", "mean", "lam", "lo", "hi")
            .agg(exact_sum(words * w).alias("f"), exact_sum(F.when(u < F.log(F.lit(float(cap))), words * w * x).otherwise(0.0)).alias("slope"))
        )
        off = F.col("f") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(off, F.col("slope"))
        # outside its bracket, or where all rates are capped, a step halves the bracket, or doubles away from 0 while there is none
        half = F.when((F.col("lo1") > -1e6) & (F.col("hi1") < 1e6), (F.col("lo1") + F.col("hi1")) / 2).when(F.col("lo1") > -1e6, F.greatest(F.col("lam") * 2, F.col("lam") + 1)).otherwise(F.least(F.col("lam") * 2, F.col("lam") - 1))
        state = cut(
            sums.withColumns({"lo1": lo, "hi1": hi, "step": step})
            .withColumn("next", F.when(F.abs(off) <= F.col("target") * CLOSE, F.col("lam")).when((F.col("step") > F.col("lo1")) & (F.col("step") < F.col("hi1")), F.col("step")).otherwise(half))
            .select("source", "target", "mean", F.col("next").alias("lam"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), (F.abs(off) / F.col("target")).alias("off"))
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    else:
        raise ArithmeticError("a source's rate did not settle")
    return state.select("source", "mean", "lam")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, tilt: float = TILT, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, source, keep...) -> doc_id, keep..., size, source_size, target, rate, copies, taken.

    Null text or one without words: size 0, no copies. Null source: a source of its own, last. A source without words: target 0. Repeated rows: each counts and gets its own copies. Empty table: empty result. Where copies of documents are of one size, doc_id decides which takes the odd copy; reruns agree. Other columns are ignored."""
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), *(F.col(c).alias(f"_{c}") for c in keep)))
    counts = cut(rows.groupBy("source", "n").agg(F.count("*").alias("c")))
    # documents of one source and size, such as the copies of one text, are ranked in parts where they are over a thousandth of all; so such sizes are under a thousand
    most = line(counts.agg(F.sum("c")).first()[0] or 0)
    hot = F.broadcast(counts.filter(F.col("c") > most).select("source", "n", F.ceil(F.col("c") / most).cast("int").alias("p")))
    sized = rows.alias("r").join(hot.alias("h"), F.expr("r.source <=> h.source AND r.n = h.n"), "left").select("r.*", F.pmod(F.xxhash64("doc_id"), F.coalesce("p", F.lit(1))).cast("int").alias("b"))
    cells = sized.groupBy("source", "n", "b").agg(F.count("*").alias("c"))
    goal = cut(targets(counts.select("source", (F.col("n") * F.col("c")).alias("n")), weights, cap))
    lam = rates(counts, goal, cap, tilt)
    goal = cut(goal.alias("g").join(lam.alias("l"), F.expr("g.source <=> l.source"), "left").select("g.source", "source_size", "target", "mean", "lam"))
    u = F.col("lam") * F.pow(F.col("n") / F.col("mean"), F.lit(tilt))
    rate = F.when(F.col("n") == 0, 0.0).when(F.col("lam").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)).when(u < F.log(F.lit(float(cap))), F.exp(u)).otherwise(F.lit(float(cap)))
    before = Window.partitionBy("source").orderBy(F.col("n").desc(), "b").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each source, size and part: the running sum of rates before it
    cells = cut(
        cells.alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source")).select("c.source", "n", "b", "c", "source_size", "target", rate.alias("rate"))
        .withColumn("start", F.coalesce(F.sum(F.col("c") * F.col("rate")).over(before), F.lit(0.0)))
    )
    cell = Window.partitionBy("source", "n", "b").orderBy("doc_id", *(f"_{c}" for c in keep))
    up = lambda i: F.floor(F.col("start") + i * F.col("rate") + F.lit(0.5 - 1e-9))
    return (
        sized.withColumn("i", F.row_number().over(cell)).alias("d")
        .join(cells.alias("k"), F.expr("d.source <=> k.source AND d.n = k.n AND d.b = k.b"))
        .withColumn("copies", F.least(F.lit(cap), F.greatest(F.lit(0), up(F.col("i")) - up(F.col("i") - 1))).cast("long"))
        .select("d.doc_id", *(F.col(f"d._{c}").alias(c) for c in keep), F.col("d.n").alias("size"), "source_size", "target", "rate", "copies", (F.col("copies") * F.col("d.n")).alias("taken"))
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
