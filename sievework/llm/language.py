"""Operator 10: language identification by word-first backoff.

A known word scores by the logarithm of its frequency in each language; an unseen word falls back to the longest character n-grams of it that are known, from N down to single letters. Words and n-grams are counted in Spark over the whole texts of a sample of the labelled rows, about PER_LANGUAGE distinct texts a language drawn by a hash; only the tables of the most frequent ones, whose sizes have limits, come to the driver and are sent to every task. Every document is then judged on its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Shelf, table, tasks


# characters such as ½ and ² that count as word characters to the pattern language but are neither letters nor decimal digits; the planes above hold ideographs alone
NUMERALS = {ord(c): " " for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_NUMERAL = frozenset(map(chr, NUMERALS))
WORD = re.compile(r"[^\W\d_]+")
"""A run of letters in a text without NUMERALS."""


def letters(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    if not text.isascii() and not _NUMERAL.isdisjoint(text):
        text = text.translate(NUMERALS)
    return WORD.findall(text.lower())


N = 5
PER_LANGUAGE = 300
"""Labelled texts that a language's model is fitted on, about; all of them where there are no more."""
LANGUAGES = 200
"""Languages up to which each has its full share. Where there are more, each is fitted on fewer documents and keeps fewer words and n-grams, one at least; none is left out."""
WORDS = 20_000
"""Most frequent words kept for a language."""
GRAMS = 20_000
"""Most frequent n-grams kept for a language and length."""
SEEN = 3
"""Occurrences in the sample from which a word counts as known."""
UNDETERMINED = "und"
SEGMENT = 1 << 16
REMEMBERED = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    rows: np.ndarray  # a row of log frequencies for each known word
    grams: dict[str, int]
    gram_rows: np.ndarray


def training(docs: DataFrame) -> DataFrame:
    """The labelled documents that may be learned from: lang isn't null and crc32 of doc_id as text, mod 3, isn't 1."""
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    """Null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def share(limit: int, languages: int, power: int = 1) -> int:
    """What is left of a language's limit among so many languages."""
    return max(1, limit * LANGUAGES**power // max(LANGUAGES, languages) ** power)


def sample(labelled: DataFrame) -> DataFrame:
    """(lang, t) of a sample of labelled (text, lang): distinct texts whose digest is below a line that lets about PER_LANGUAGE of a language's texts through, so reruns draw alike and no language is sorted. A language of up to so many texts keeps all."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}")).select("lang", F.xxhash64("text").alias("d"), F.col("text").alias("t"))
    per = rows.select("lang", "d").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    each = per.withColumn("each", F.greatest(F.lit(1), F.floor(F.lit(PER_LANGUAGE) * F.least(F.lit(1.0), F.lit(LANGUAGES) / F.count("*").over(Window.partitionBy())))))
    # where a line lets none through, as it may with few texts, the least digest's text is drawn
    low = rows.groupBy("lang").agg(F.min("d").alias("low"))
    lines = each.join(low, "lang").select("lang", "low", F.when(F.col("n") <= F.col("each"), F.lit(float(2**63))).otherwise((F.col("each") / F.col("n") * 2 - 1) * float(2**63)).alias("line"))
    return rows.join(F.broadcast(lines), "lang").filter("d <= line OR d = low").select("lang", "d", "t").dropDuplicates(["lang", "d"]).select("lang", "t")


def pieces(text: str) -> Iterator[str]:
    """A text in segments, cut between words."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def words_of(texts: Iterable[tuple[str, str]]) -> Counter:
    """How often each (lang, word) is in (lang, text), letters in lower case."""
    found: Counter = Counter()
    for lang, text in texts:
        for part in pieces(text):
            for w, n in Counter(letters(part)).items():
                found[lang, w] += n
    return found


def grams_of(words: Iterable[tuple[str, str, int]]) -> Counter:
    """How often each (lang, length, n-gram) is in words (lang, word, n)."""
    found: Counter = Counter()
    for lang, w, n in words:
        for k in range(1, N + 1):
            for i in range(len(w) - k + 1):
                found[lang, k, w[i : i + k]] += n
    return found


def tables(drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """drawn (lang, t) -> counts of words and of n-grams, both (lang, k, key, n); k is 0 for words. Counted in parts, summed by a shuffle."""
    schema = "lang string, k int, key string, n long"

    def batch_of(rows: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "k", "key", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(Counter({(lang, 0, w): n for (lang, w), n in words_of(zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), strict=True)).items()}))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(grams_of(zip(b.column("lang").to_pylist(), b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)))

    total = lambda df: df.groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))
    words = total(drawn.select("lang", "t").repartition(tasks(drawn.sparkSession)).mapInArrow(count_words, schema))
    return words, total(words.select("lang", "key", "n").repartition(tasks(drawn.sparkSession)).mapInArrow(count_grams, schema))


def frequent(counts: DataFrame, limits: Column) -> DataFrame:
    """The keys (k, key) that are among a language's most frequent of a length, by its limit: those over the least count that leaves no more than so many. Ties at the limit go together. The counts' own counts are summed up, not the keys sorted."""
    per = counts.groupBy("lang", "k", "n").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("lang", "k").orderBy(F.col("n").desc())
    line = per.withColumn("upto", F.sum("c").over(upto)).withColumn("first", F.row_number().over(upto)).filter((F.col("upto") <= limits) | (F.col("first") == 1)).groupBy("lang", "k").agg(F.min("n").alias("line"))
    return counts.join(F.broadcast(line), ["lang", "k"]).filter("n >= line").select("k", "key", "n")


def fit(drawn: DataFrame) -> Model:
    """The model of a sample (lang, t): log frequencies with add-half smoothing over the sample's counts. Only words and n-grams within the limits come to the driver."""
    with Shelf(drawn.sparkSession, "language") as shelf:
        words, grams = (shelf.keep(x) for x in tables(shelf.keep(drawn)))
        both = words.unionByName(grams)
        totals = {(r.lang, r.k): (r.n, r.m) for r in both.groupBy("lang", "k").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect()}
        languages = sorted({lang for lang, _ in totals})
        # a table has a column a language, so the square keeps its size
        n_words, n_grams = (share(limit, len(languages), 2) for limit in (WORDS, GRAMS))
        known = frequent(both, F.when(F.col("k") == 0, n_words).otherwise(n_grams)).filter((F.col("n") >= SEEN) | (F.col("k") == 1)).select("k", "key").distinct()
        kept = shelf.keep(both.join(known, ["k", "key"], "left_semi"))
        got = kept.toArrow()
    return model(languages, totals, zip(*(got.column(c).to_pylist() for c in ("lang", "k", "key", "n")), strict=True))


def model(languages: list[str], totals: dict[tuple[str, int], tuple[int, int]], counts: Iterable[tuple[str, int, str, int]]) -> Model:
    """From the kept counts (lang, k, key, n) and the totals of all. The keys are in order, whatever order the counts come in."""
    at = {lang: j for j, lang in enumerate(languages)}
    held: tuple[dict, dict] = ({}, {})
    for lang, k, key, n in counts:
        held[k > 0].setdefault(key, {})[at[lang]] = n

    def rows(side: dict) -> np.ndarray:
        out = np.zeros((len(side), len(languages)))
        for i, key in enumerate(sorted(side)):
            for j, n in side[key].items():
                out[i, j] = n
        lengths = np.array([0 if side is held[0] else len(key) for key in sorted(side)], np.int64)
        sums = np.array([[totals.get((lang, k), (0, 0))[0] for lang in languages] for k in range(N + 1)], float).reshape(N + 1, len(languages))
        return np.log((out + 0.5) / (sums[lengths] + 0.5 * (len(side) + 1)))

    return Model(languages, {w: i for i, w in enumerate(sorted(held[0]))}, rows(held[0]), {g: i for i, g in enumerate(sorted(held[1]))}, rows(held[1]))


class Judge:
    def __init__(self, model: Model):
        self.m = model
        self.forget()

    def forget(self) -> None:
        """Drop what was worked out for unseen words."""
        self.at = dict(self.m.words)
        self.rows = self.m.rows
        self.used = len(self.rows)

    def parts(self, word: str) -> list[int]:
        """The word's known n-grams of the greatest length of which any is known; none where no letter is."""
        grams = self.m.grams
        for k in range(min(N, len(word)), 0, -1):
            at = [grams[g] for i in range(len(word) - k + 1) if (g := word[i : i + k]) in grams]
            if at:
                return at
        return []

    def learn(self, words: list[str]) -> None:
        """Give unseen words rows beside the known ones: the mean rows of their parts, zeros where they have none."""
        if self.used + len(words) > len(self.rows):
            more = np.zeros((max(1024, len(words), self.used // 2), len(self.m.languages)))
            self.rows = np.concatenate([self.rows[: self.used], more])
        parts = [self.parts(w) for w in words]
        some = [i for i, at in enumerate(parts) if at]
        if some:
            n = np.array([len(parts[i]) for i in some])
            flat = self.m.gram_rows[[x for i in some for x in parts[i]]]
            self.rows[self.used + np.array(some)] = np.add.reduceat(flat, np.cumsum(n) - n) / n[:, None]
        self.at.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of the whole text and the model's share of belief in it."""
        if not self.m.languages or not text:
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.m.languages)), 0
        for part in pieces(text):
            words = letters(part)
            if not words:
                continue
            if self.used > len(self.m.words) + REMEMBERED:
                self.forget()
            ids = list(map(self.at.get, words))
            if None in ids:
                self.learn(sorted({w for w, i in zip(words, ids, strict=True) if i is None}))
                ids = list(map(self.at.get, words))
            n += len(ids)
            total += self.rows[ids].sum(axis=0)
        if not n:
            return UNDETERMINED, 0.0
        # words of a text aren't independent: belief is formed from the square root of their number
        mean = total / math.sqrt(n)
        p = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.m.languages[best], float(p[best] / p.sum())


PREDICTION = "lang_pred string, score double"


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """docs (text, keep...) -> keep..., lang_pred, score. Narrow. Only the text is looked at. Null text or one without letters: und, score 0. Ties go to the language first in order. A run of letters of any length is one word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tables' limits
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", " + PREDICTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            found = [judge.judge(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, learned only from what training() allows.

    Null lang: judged, never learned from. Without any labelled text every document is und. Null doc_id, repeated rows: each row gets its result. Empty table: empty result. Other columns are ignored."""
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(sample(training(docs))), ("doc_id", "held_out"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
