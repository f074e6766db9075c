"""The corpus pipeline: five stages, each one of the training-data operators, from documents to token ids. Driver scripts delete this file together with sievework/llm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import language, minhash, mixing, sentencepiece_scan, suffixes
from sievework.llm.common import scratch, table, wanted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE = 5
PERCENT = 80
REPEAT = 200
"""Bytes of the shortest repeated string that is removed: under the length of a passage of 50 words."""


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told stay, whatever it is; null, empty and letterless texts go. A null lang takes the language found. Where no row may be learned from, no language can be told: all but null, empty and letterless texts stay, and a null lang stays null."""
    model = language.fit(language.sample(language.training(docs)))
    told = F.col("lang_pred") if model.languages else F.lit(None).cast("string")
    # a model of one language without words judges every text with letters to be in it
    judged = language.identify(docs.select(*COLUMNS), model if model.languages else language.model(["any"], {}, []), COLUMNS)
    return judged.filter(F.col("lang_pred") != language.UNDETERMINED).select("doc_id", "text", F.coalesce("lang", told).alias("lang"), "source", "n_chars")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SHINGLE words, PERCENT similarity) the document of the least doc_id stays; rows without a doc_id are kept only where no numbered document is in their group."""
    # a row is known by its doc_id and its text, as several may share either
    number = F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("id")
    rows = docs.select(*COLUMNS, number, F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"))
    gone = minhash.near_duplicates(rows, SHINGLE, PERCENT, ("d",)).filter("NOT kept").select(number, "d")
    return rows.join(gone, ["id", "d"], "left_anti").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of REPEAT bytes or more that stands anywhere else too is removed, as the operator judges it; a stretch gives way to whole characters, so what stays is text. Documents of which nothing is left go; n_chars is counted anew."""
    spans = suffixes.repeated(docs, REPEAT)
    rows = docs.select(*COLUMNS).withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63) + 1)), "d": F.xxhash64(F.coalesce("text", F.lit("")))})
    clean = rows.join(spans.select("id", "d").hint("shuffle_merge"), ["id", "d"], "left_anti").select(*COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                t, left, at = (text or "").encode("utf-8", "replace"), [], 0
                for p in parts:
                    s, e = p["s"], p["e"]
                    while s < e and t[s] & 0xC0 == 0x80:
                        s += 1
                    while e < len(t) and e > s and t[e] & 0xC0 == 0x80:
                        e -= 1
                    left.append(t[at:s])
                    at = e
                left.append(t[at:])
                out.append(b"".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("lang"), batch.column("source"), pa.array([len(x) for x in out], pa.int64())], list(COLUMNS))

    cut_ = wanted(rows, spans.select("id"), "id").join(spans.hint("shuffle_merge"), ["id", "d"]).select("doc_id", "text", "lang", "source", "spans")
    return clean.unionByName(cut_.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long").filter("n_chars > 0"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document comes as often as the mix takes it, and not at all where it takes none. Null or empty texts have no words and aren't taken; a null doc_id or source counts as any other; equal rows are taken as often as the mix takes them together. Empty table: empty result."""
    # a row is known by all its columns, so rows that share a doc_id or a text keep their own numbers of copies, and equal rows have one in common
    whole = F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())))
    rows = docs.select(*COLUMNS).withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63) + 1)), "d": whole})
    copies = mixing.mix(rows, keep=("id", "d")).groupBy("id", "d").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = rows.join(copies.hint("shuffle_merge"), ["id", "d"]).dropDuplicates(["id", "d"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, whole, as operator 9 returns them: null and empty texts have none; null and repeated doc_ids keep a row each. Empty table: empty result."""
    return sentencepiece_scan.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("repeats", stage_repeats),
    ("mixing", stage_mixing),
    ("tokens", stage_tokens),
]

ORACLE_SQL = None
"""Sketches, refinement rounds, Newton steps and Viterbi paths have no SQL; tests/llm hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        to = scratch(spark, f"stage-{name}")
        made.write.option("compression", "zstd").parquet(to)
        docs = spark.read.parquet(to)
    return docs
