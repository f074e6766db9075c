"""Operator 5: licence scans. One Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text; the expression after a tag is parsed by a shunting-yard parser and evaluated to the licences it names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and the labels they add.
NOTICES = {
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
TAGS = ("spdx license identifier", "license expression")
MARK = re.compile(r"[ \t]*[:=]?")
"""What may stand between a tag and its expression."""
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: with binds tightest, then and, then or.
BINDS = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
"""Lower case, and a blank for every byte outside the words. All bytes of a character beyond ASCII belong to words, so this works on UTF-8 bytes."""
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, *TAGS]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def parse(text: str, at: int = 0, stop: int | None = None) -> list | str | None:
    """The licence expression that begins at a place of a text, on its line and before stop, as a tree of [operator, left, right] and lower-case names; None where there is none. Reading stops at the first token that can't continue it, and an operator or parenthesis left open is dropped."""
    out: list = []
    ops: list[str] = []

    def reduce() -> None:
        op = ops.pop()
        right, left = out.pop(), out.pop()
        out.append([op, left, right])

    operand = True
    end = at
    for m in TOKEN.finditer(text, at, len(text) if stop is None else stop):
        t = m[0].lower().rstrip(".")
        gap = text[end : m.start()]
        if gap.strip() or "\n" in gap or "\r" in gap:
            break
        end = m.end()
        if operand:
            if t == "(":
                ops.append(t)
            elif t == ")" or t in BINDS:
                break
            else:
                out.append(t)
                operand = False
        elif t == ")":
            while ops and ops[-1] != "(":
                reduce()
            if not ops:
                break
            ops.pop()
        elif t in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[t]:
                reduce()
            ops.append(t)
            operand = True
        else:
            break
    if operand and ops:
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    while ops:
        if ops[-1] == "(":
            ops.pop()
        elif len(out) > 1:
            reduce()
        else:
            break
    return out[-1] if out else None


def names(tree: list | str | None, most: int = 1 << 18) -> set[str]:
    """All licences the expression names; with makes one name of a licence and its exception. A with that would make over `most` names, which no valid expression does, gives both sides' names as they are."""
    if tree is None:
        return set()
    todo, sets = [(tree, False)], []
    while todo:
        t, ready = todo.pop()
        if isinstance(t, str):
            sets.append({t})
        elif not ready:
            todo += [(t, True), (t[2], False), (t[1], False)]
        else:
            right, left = sets.pop(), sets.pop()
            if t[0] == "with" and len(left) * len(right) <= most:
                sets.append({f"{x} with {y}" for x in left for y in right})
            else:
                # the smaller set is put into the larger, so a long chain takes no square of time
                small, large = sorted((left, right), key=len)
                large |= small
                sets.append(large)
    return sets[0]


def written(tree: list | str) -> str:
    """The tree as text, each operation in parentheses."""
    todo, out = [tree], []
    while todo:
        t = todo.pop()
        if isinstance(t, str):
            out.append(t)
        else:
            todo += [")", t[2], f" {t[0]} ", t[1], "("]
    return "".join(out)


def spans(raw: bytes, tags: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the words first..last of each tag stand in the text's characters; tags in order."""
    ends = {n for tag in tags for n in tag}
    places, chars, upto = {}, 0, 0
    for n, m in enumerate(WORD.finditer(raw.translate(_FOLD))):
        if n in ends:
            # a word starts and ends at a character's edge
            chars += len(raw[upto : m.start()].decode())
            places[n] = (chars, chars + len(raw[m.start() : m.end()].decode()))
            upto = m.start()
    return [(places[first][0], places[last][1]) for first, last in tags]


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text.

    The words are laid out between single blanks, so a phrase is found where its words stand consecutively, at any separators; overlapping places all count. score: 0 without any finding; 1 with an identifier tag that parses; else 1 - 0.5 ** (number of phrases found)."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(_FOLD).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    line = b" " + b" ".join(words) + b" "
    starts, base, more, tags, upto, seen = [], set(), set(), [], 0, 0
    for end, phrase in automaton().iter(line.decode("latin-1")):
        # ends come in order: blanks are counted once over the whole line
        seen += line.count(b" ", upto, end)
        upto = end
        first = seen - phrase.count(" ") - 1
        if phrase in BASE:
            starts.append(first)
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            starts.append(None)
            more.add(NOTICES[phrase])
        else:
            tags.append((first, seen - 1))
    expressions = []
    if tags:
        whole = raw.decode()
        found = spans(raw, tags)
        for (_, at), (stop, _) in zip(found, [*found[1:], (len(whole), None)], strict=True):
            tree = parse(whole, MARK.match(whole, at).end(), stop)
            if tree is not None:
                expressions.append(written(tree))
                more |= {f"spdx:{name}" for name in names(tree)}
    places = [x for x in starts if x is not None]
    score = 1.0 if expressions else 1.0 - 0.5 ** len(starts)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, sorted(set(expressions))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row for each row; narrow, no shuffle.

    Null or empty text: no words, counts 0, places null, labels '', score 0. Null doc_id, repeated rows: each row gets its result. Empty table: empty result. Other columns are ignored."""
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows = [(ids[i].as_py(), *scan(texts[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
