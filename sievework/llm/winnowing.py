"""Operator 8: document fingerprints by winnowing, in DataFrame operations only.

The k-grams are of K words; each word is hashed once, each k-gram's hash is made of its words' hashes, and of every window of WINDOW consecutive k-grams the least hash is selected, the rightmost of equals. A selection is one long: a hash of 34 bits, then 30 bits that fall as the position grows, so that the least long is the least hash, rightmost. No string of Spark's has 2 ** 30 words.

A fingerprint is the distinct selections, each a hash with its position. A word of over LONG characters counts as so many words of one character, so text without blanks is fingerprinted too: two texts that share WINDOW + K - 1 such consecutive words share a selection at known places. A text of up to SHORT characters is fingerprinted by its characters besides, and two such texts are compared by those. Both sizes are chosen so that a text with its last third replaced shares a selection with itself: over SHORT characters the rest holds WINDOW + K - 1 whole words, runs of blanks counted as one; up to that its k-grams fill a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, lower_ascii, table, tasks

K = 5
WINDOW = 12
LONG = 24
SHORT = 640
"""(WINDOW + K - 1) words of LONG characters, their blanks and a word that is cut come to two thirds of so many characters."""
CHARS, CHAR_WINDOW = 8, 16
TINY = 24
"""Up to so many characters, all grams of TINY_CHARS characters are selected."""
TINY_CHARS = (2, 4, 8)
BITS = 30
PLACES = (1 << BITS) - 1
NO_ID = -(2**63) + 1
"""Stands for a null doc_id in keys."""


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case; null or none: empty."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def grams(units: Column, k: int | Column) -> Column:
    """The packed hashes of the k-grams of an array; fewer than k: one of them all."""
    own = F.transform(units, lambda w: F.xxhash64(w))
    of = lambda h, i: F.xxhash64(*(F.get(h, i + j) for j in range(k))) if isinstance(k, int) else F.xxhash64(F.slice(h, i + 1, k))
    packed = lambda h, i: of(h, i).bitwiseAND(F.lit(~PLACES)).bitwiseOR((F.lit(PLACES) - i).cast("long"))
    return let(own, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(units) - k)), lambda i: packed(h, i)))


def winnow(units: Column, k: int, window: int | Column) -> Column:
    """The distinct selections of an array that has any."""
    least = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - window + 1)), lambda i: F.array_min(F.slice(v, i, window)))
    return F.array_distinct(let(grams(units, k), least))


def none() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def selections(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The selections by words as an array of longs in order of position. Fewer than k words: one k-gram of them all; no word: empty. Fewer k-grams than a window: one window of them all."""
    return let(words(text), lambda w: F.when(F.size(w) == 0, none()).otherwise(winnow(w, k, window)))


def pieces(text: Column) -> Column:
    """The text's words, those of over LONG characters as their characters."""
    long = lambda w: F.length(w) > LONG
    return let(words(text), lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))))).otherwise(ws))


def char_selections(text: Column) -> Column:
    """The selections by characters of a text of up to SHORT of them, blanks included; a longer one: empty."""

    def chosen(c: Column) -> Column:
        n = F.size(c)
        kept = n - (n / 3).cast("int")
        sizes = F.when(n == 1, F.array(F.lit(1))).otherwise(F.filter(F.array(*map(F.lit, TINY_CHARS)), lambda k: k <= n))
        every = F.array_distinct(F.flatten(F.transform(sizes, lambda k: grams(c, k))))
        return F.when(n <= TINY, every).otherwise(winnow(c, CHARS, F.least(F.lit(CHAR_WINDOW), kept - CHARS + 1)))

    n = F.length(text)
    return F.when((n > 0) & (n <= SHORT), let(F.split(lower_ascii(text), ""), chosen)).otherwise(none())


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """(words, chars): the selections by pieces, and by characters where the text is short. Null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    by_words = let(pieces(text), lambda w: F.when(F.size(w) == 0, none()).otherwise(winnow(w, k, window)))
    return F.struct(by_words.alias("words"), char_selections(text).alias("chars"))


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, BITS)))


def positions(selected: Column) -> Column:
    """The words at which the selected k-grams start."""
    return F.transform(selected, lambda v: F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES)))


def whole(f: Column) -> Column:
    """All selections of a fingerprint, those by words first."""
    return F.concat(f["words"], f["chars"])


def digest(f: Column) -> Column:
    return F.md5(whole(f).cast("string"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays' hashes; two empty ones: 1."""
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: let(F.size(F.array_intersect(s["a"], s["b"])), lambda both: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 1.0).otherwise(both / (F.size(s["a"]) + F.size(s["b"]) - both))))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are: by characters where both texts are short and one of them has a word, else by words."""
    by_chars = (F.size(a["chars"]) > 0) & (F.size(b["chars"]) > 0) & (F.size(a["words"]) + F.size(b["words"]) > 0)
    return F.when(by_chars, jaccard(a["chars"], b["chars"])).otherwise(jaccard(a["words"], b["words"]))


def key() -> tuple[Column, Column]:
    """A row's key without nulls, so that joins and windows on it share one shuffle."""
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("d")


def chain(docs: DataFrame) -> DataFrame:
    """The distinct (id, d, n) in descending doc_id (null last), then d, each with nxt and prev, structs of its neighbours; the last is followed by the first. Ranges of the order are handled each by itself; their ends, one row for each range, are joined up."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("d")]
    light = docs.select("doc_id", *key(), F.length(F.coalesce("text", F.lit(""))).alias("n")).distinct()
    dealt = cut(light.repartitionByRange(tasks(docs.sparkSession), *order).withColumn("rng", F.spark_partition_id()))
    w = Window.partitionBy("rng").orderBy(*order)
    me = F.struct("id", "d", "n")
    inner = cut(dealt.withColumns({"nxt": F.lead(me).over(w), "prev": F.lag(me).over(w)}))
    ends = inner.filter("nxt IS NULL").select("rng", me.alias("last")).join(inner.filter("prev IS NULL").select("rng", me.alias("first")), "rng")
    by = Window.orderBy("rng")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("rng", F.coalesce(F.lead("first").over(by), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(by), F.last("last").over(whole)).alias("before"))
    return inner.join(F.broadcast(ends), "rng").select("id", "d", "n", F.coalesce("nxt", "after").alias("nxt"), F.coalesce("prev", "before").alias("prev"))


def edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced from the next document, and how alike they are.

    Null text counts as empty. Rows equal in doc_id and text are judged as one and returned as often as they come; the next document is the next row that differs. Null doc_id: after all others. A table of one document: it is its own next. Empty table: empty result. Other columns are ignored. A text is fingerprinted where it is read and shuffled once with its id and fingerprint; what the document before it needs of it, a prefix and the fingerprint, once more."""
    # both sides take the same columns of the one shuffle of the texts; doc_id follows from id
    own = docs.select(*key(), F.coalesce("text", F.lit("")).alias("text"), fingerprint(F.col("text"), k, window).alias("f"))
    linked = own.join(cut(chain(docs)).hint("shuffle_merge"), ["id", "d"]).select("id", "d", "text", "f", "n", "prev")
    one = Window.partitionBy("id", "d").orderBy("d")
    sent = (
        linked.withColumn("i", F.row_number().over(one)).filter("i = 1")
        .select(F.col("prev.id").alias("id"), F.col("prev.d").alias("d"), F.expr("substring(text, 1, prev.n div 3)").alias("prefix"), F.col("f").alias("next_selected"))
    )
    both = linked.drop("prev").join(sent.hint("shuffle_merge"), ["id", "d"])
    third = F.expr("n div 3").cast("int")
    result = let(
        F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("prefix", F.lit(1), third)),
        lambda e: let(
            F.struct(e.alias("e"), F.col("f"), fingerprint(e, k, window).alias("g")),
            lambda s: F.struct(
                F.sha2(s["e"].cast("binary"), 256).alias("edited_sha256"), digest(s["f"]).alias("fingerprint"), digest(s["g"]).alias("edited_fingerprint"),
                likeness(s["f"], s["g"]).alias("near_edited"), likeness(s["f"], F.col("next_selected")).alias("near_next"), F.size(whole(s["f"])).alias("n_selected"),
            ),
        ),
    )
    return both.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), result.alias("r")).select("doc_id", "n_chars", "r.*")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
