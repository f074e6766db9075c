import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_tables import ROWS, SCHEMA

from sievework.llm import mixing, sentencepiece_scan


def test_stages(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, "").persist()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tuple(made.columns) == corpus_pipeline.COLUMNS, name
            assert made.filter("n_chars <> length(text)").count() == 0
        if name == "language":
            assert made.count() > 60 and made.filter("text IS NULL").count() == 0
        if name == "near_duplicates":
            texts = [r.text for r in made.filter("doc_id IS NOT NULL").collect()]
            assert len(texts) == len(set(texts))
        if name == "repeats":
            passage = ROWS[52][1].split(" ")[-60:-50]
            assert made.count() > 30 and made.filter(F.contains("text", F.lit(" ".join(passage)))).count() <= 1
        docs = made
    assert docs.filter("NOT round_trip").count() == 0 and docs.count() > 20


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0 and "ids" in docs.columns
    assert sentencepiece_scan.ENCODED


def test_language_without_labels(spark):
    texts = ["clean words", "漢字", None, "", "12 34 !?", "é"]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.stage_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(0, "clean words", None), (1, "漢字", None), (5, "é", None)]


def test_near_duplicates_by_row(spark):
    copy = "one two three four five six seven"
    rows = [(1, copy), (None, copy), (2, copy), (2, "this text stands alone of its kind here"), (None, "and this one has no number at all"), (None, None), (3, copy.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.stage_near_duplicates(spark, docs, "").collect()}
    assert got == {rows[0], rows[3], rows[4], rows[5]}


def test_mixing_takes_each_row_as_often_as_asked(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(i % 40, text(10 + i % 3), "en", f"s{i % 3}") for i in range(100)] + [(None, text(12), "en", "s1") for _ in range(60)] + [(7, "same row again", "en", "s2")] * 5 + [(8, None, None, None), (9, "", "en", "s0")]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for x in mixing.mix(docs, keep=("source",)).collect():
        want[x.doc_id, x.size, x.source] += x.copies
    made = corpus_pipeline.stage_mixing(spark, docs, "").collect()
    # of rows alike in doc_id, size and source any may take the odd copy
    assert Counter((x.doc_id, len(x.text.split(" ")), x.source) for x in made) == +want and len(made) > 100
    assert {(x.doc_id, x.text, x.source) for x in made} <= {(i, t, s) for i, t, _, s in rows}
