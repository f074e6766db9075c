"""Operator 6: repeated strings of MIN bytes, by bucket-pointer refinement over anchored suffixes.

Every byte offset has a bucket identifier for the 1, 2, 4, .. Q bytes from it, each made from the identifiers of half that length at the offset and at the later one, so one round's updates serve the next. Of the offsets in a string of MIN bytes the one with the least Q-gram identifier (the rightmost of equals) is its anchor: it depends on the string's bytes alone, so equal strings have equal anchors at equal distances, and only the suffixes at anchors, one in some 185 bytes, are put into buckets. A record is an anchor with the run of starts it is the anchor of.

Buckets are refined from the inside out. The bytes that all strings of a record have in common are its core: a core that nothing else has ends the matter, none of its strings is repeated. The bytes from its first string's start to its last one's end are its outer string: an outer string that something else has ends it too, all are repeated. What is in between is cut into pieces by the distance from anchor to start, the same grid for all, and the pieces' longer cores and shorter outers refine the bucket further; at pieces of one start core and outer are the string itself. Each round sorts only what the one before left open, with a witness for each string already settled in the same bucket, and a repeated passage leaves open a few pieces at its two ends. Identifiers of longer strings are 128-bit digests of their bytes in place of ranks, which would need all suffixes in one order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, cut, known, slices, table, utf8, wanted

MIN = 400
Q = 32
PIECE = 4 << 20
FAN = 8
"""A piece is cut into so many for the next round."""
_LOW = np.uint64(0xFFFFFF)

RECORD = "id long, d long, lo long, a long, x int, y int, core long, outer binary"
NAMES = ["id", "d", "lo", "a", "x", "y", "core", "outer"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


@lru_cache(1)
def _codes() -> tuple[np.ndarray, list[np.uint64]]:
    r = np.random.default_rng(40_961)
    return r.integers(1, 1 << 63, 256, dtype=np.uint64), [np.uint64(int(x) | 1) for x in r.integers(1, 1 << 63, 24, dtype=np.uint64)]


def buckets(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The identifier of the q bytes (a power of two) from each offset of data that has so many."""
    table_, code = _codes()
    b, h, r = table_[data], 1, 0
    while h < q:
        later = b[h:] * code[r]
        b = b[:-h] ^ (later >> np.uint64(29))
        b += later
        b *= code[r + 1]
        h, r = 2 * h, r + 1
    b ^= b >> np.uint64(32)
    return b


def anchors(data: np.ndarray, least: int, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """For each offset with `least` bytes from it, the anchor of that string; and all buckets. data: under 2 ** 24 bytes."""
    b = buckets(data, q)
    key = (b & ~_LOW) | (_LOW - np.arange(len(b), dtype=np.uint64))
    width, done = least - q + 1, 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
    return (_LOW - (key & _LOW)).astype(np.int64), b


def pieces(text: bytes, size: int, least: int) -> Iterator[tuple[int, bytes]]:
    """A long text in parts that overlap by one byte less than a string."""
    at = 0
    while True:
        yield at, text[at : at + size + least - 1]
        at += size
        if at + least > len(text):
            return


def runs(texts: list[bytes], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first start, last start, anchor, core identifier) of each record; offsets within the text. Short texts are worked on together."""

    def work(group: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        at, bucket = anchors(data, least)
        lens = np.array([len(t) for _, _, t in group])
        begin = np.cumsum(lens) - lens
        good = np.repeat(np.tile([True, False], len(group)), np.column_stack([lens - least + 1, np.full(len(group), least - 1)]).ravel())[: len(at)]
        new = good & np.concatenate(([True], (at[1:] != at[:-1]) | ~good[:-1]))
        last = good & np.concatenate(((at[1:] != at[:-1]) | ~good[1:], [True]))
        s, e = np.flatnonzero(new), np.flatnonzero(last)
        owner = np.searchsorted(begin, s, "right") - 1
        anchor = at[s]
        core = bucket[anchor].view(np.int64)
        shift = np.array([off for _, off, _ in group])[owner] - begin[owner]
        yield from zip(np.array([i for i, _, _ in group])[owner].tolist(), (s + shift).tolist(), (e + shift).tolist(), (anchor + shift).tolist(), core.tolist(), strict=True)

    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        for off, part in pieces(t, PIECE, least):
            if group and size + len(part) > PIECE // 4:
                yield from work(group)
                group, size = [], 0
            group.append((i, off, part))
            size += len(part)
    if group:
        yield from work(group)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(KINDS), KINDS, strict=True)], NAMES)


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the key of a row in the rounds: id (doc_id; null has a number of its own) and d, from the text's digest."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"))


def first_records(docs: DataFrame, least: int) -> DataFrame:
    """A record for each anchor: its starts p lie at distances x <= a - p <= y. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, ds = part.column("id").to_pylist(), part.column("d").to_pylist()
                texts = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column("text")]
                rows = []
                for i, lo, hi, a, core in runs(texts, least):
                    rows.append((ids[i], ds[i], lo, a, a - hi, a - lo, core, xxhash.xxh3_128_digest(texts[i][lo : hi + least])))
                    if len(rows) == 50_000:
                        yield _out(rows)
                        rows = []
                yield _out(rows)

    return keyed(docs).select("id", "d", "text").mapInArrow(run, RECORD)


def settle(shelf: Shelf, records: DataFrame) -> DataFrame:
    """Those records whose core something else has too, with `n`: null unless something else has their outer string. Takes records' table over. Keys are counted with partial sums, and hot ones are looked up without a shuffle."""
    total = records.count()
    cores = shelf.keep(records.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"))
    alive = shelf.keep(known(records, cores, "core", total).drop("n"))
    shelf.drop(records, cores)
    outers = shelf.keep(alive.groupBy("outer").agg(F.count("*").alias("n")).filter("n > 1"))
    found = shelf.keep(known(alive, outers, "outer", total, "left"))
    shelf.drop(alive, outers)
    return found


def unsettled(shelf: Shelf, found: DataFrame) -> DataFrame:
    """What the next round works on: the records still open, and of the settled ones a witness for each distinct outer string in an open record's bucket, for an open piece may equal a part of a settled one."""
    open_ = found.filter("n IS NULL").select(*NAMES[:7])
    settled = found.filter("n IS NOT NULL").groupBy("outer").agg(F.min(F.struct(*NAMES[:7])).alias("r")).select("r.*")
    return shelf.keep(open_.unionByName(settled.join(open_.select("core").distinct(), "core", "left_semi")))


def contexts(docs: DataFrame, open_: DataFrame, least: int) -> DataFrame:
    """open_ records with ctx, the bytes from their first string's start to their last one's end."""
    by = open_.groupBy("id", "d").agg(F.collect_list(F.struct("lo", "a", "x", "y")).alias("recs"))
    texts = wanted(keyed(docs).select("id", "d", "text"), open_.select("id").distinct(), "id")
    joined = texts.join(by.hint("shuffle_merge"), ["id", "d"]).select("id", "d", "recs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i in range(part.num_rows):
                    t = (part.column("text")[i].as_py() or "").encode("utf-8", "replace")
                    key = part.column("id")[i].as_py(), part.column("d")[i].as_py()
                    for r in part.column("recs")[i].as_py():
                        rows.append((*key, r["lo"], r["a"], r["x"], r["y"], t[r["a"] - r["y"] : r["a"] - r["x"] + least]))
                        if len(rows) == 10_000:
                            yield flush(rows)
                            rows = []
                yield flush(rows)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, [*KINDS[:6], pa.binary()], strict=True)], [*NAMES[:6], "ctx"])

    return joined.mapInArrow(run, "id long, d long, lo long, a long, x int, y int, ctx binary")


def refine(ctx: DataFrame, open_: DataFrame | None, size: int, least: int) -> DataFrame:
    """The open stretches of distances (x, y of open_, or all) cut at multiples of `size`, each with the core and outer string that it has in its record's bytes."""
    base = ctx.select("id", "d", "lo", "a", F.col("y").alias("far"), "ctx", "x", "y")
    if open_ is not None:
        base = base.drop("x", "y").join(open_.groupBy("id", "d", "lo").agg(F.collect_list(F.struct("x", "y")).alias("parts")).hint("shuffle_merge"), ["id", "d", "lo"])
    else:
        base = base.withColumn("parts", F.array(F.struct("x", "y"))).drop("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                far, text = c["far"][i], c["ctx"][i]
                key = c["id"][i], c["d"][i], c["lo"][i], c["a"][i]
                for part in c["parts"][i]:
                    for k in range(part["x"] // size, part["y"] // size + 1):
                        x, y = max(part["x"], k * size), min(part["y"], (k + 1) * size - 1)
                        # text[0] is at distance far before the anchor
                        core = text[far - k * size : far + least - ((k + 1) * size - 1)]
                        rows.append((*key, x, y, xxhash.xxh3_64_intdigest(core, k) - (1 << 63), xxhash.xxh3_128_digest(text[far - y : far - x + least])))
                        if len(rows) == 50_000:
                            yield _out(rows)
                            rows = []
            yield _out(rows)

    return base.select("id", "d", "lo", "a", "far", "ctx", "parts").mapInArrow(run, RECORD)


def repeated(docs: DataFrame, least: int = MIN) -> DataFrame:
    """docs (doc_id, text) -> id, d, spans: for each text with repeated strings of `least` bytes or more the stretches (s, e) of bytes they cover, sorted, merged and disjoint. Equal rows share theirs."""
    with Shelf(docs.sparkSession, "repeats") as shelf:
        stretch = lambda df: shelf.keep(df.filter("n IS NOT NULL").select("id", "d", (F.col("a") - F.col("y")).alias("s"), (F.col("a") - F.col("x") + least).alias("e")))
        found = settle(shelf, shelf.keep(first_records(docs, least)))
        spans, open_, ctx = stretch(found), unsettled(shelf, found), None
        shelf.drop(found)
        size = least - Q + 1
        while size > 1 and not open_.isEmpty():
            size = -(-size // FAN)
            first = ctx is None
            if first:
                ctx = shelf.keep(contexts(docs, open_, least))
            found = settle(shelf, shelf.keep(refine(ctx, None if first else open_, size, least)))
            shelf.drop(open_)
            spans = spans.unionByName(stretch(found))
            open_ = unsettled(shelf, found)
            shelf.drop(found)
        return cut(merged(spans))


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a text made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                one: list[dict] = []
                for s, e in sorted((p["s"], p["e"]) for p in parts):
                    if one and s <= one[-1]["e"]:
                        one[-1]["e"] = max(one[-1]["e"], e)
                    else:
                        one.append({"s": s, "e": e})
                out.append(one)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("d"), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["id", "d", "spans"])

    # a set: equal rows tell the same
    return spans.groupBy("id", "d").agg(F.collect_set(F.struct("s", "e")).alias("parts")).mapInArrow(run, "id long, d long, spans array<struct<s:bigint,e:bigint>>")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def removal(docs: DataFrame, least: int = MIN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: what is left of each text without every byte that a string of `least` bytes covers which starts anywhere else too, in the same document or another. All strings are judged on the input.

    Null or empty text, and texts under `least` bytes: nothing is removed. Rows with equal texts of `least` bytes or more, repeated rows too: all is removed. The returned text is the remaining bytes, a character of which only a part is left as U+FFFD; n_bytes is the input's. Null doc_id: treated as any other. Empty table: empty result. Other columns are ignored. Only texts with something to remove are shuffled."""
    spans = repeated(docs, least)
    rows = keyed(docs)
    body = utf8(F.col("text"))
    clean = rows.select("doc_id", "id", "d", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("kept_sha256"), F.coalesce("text", F.lit("")).alias("text")).join(spans.select("id", "d").hint("shuffle_merge"), ["id", "d"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, parts in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans"), strict=True):
                t, left, at = (text.as_py() or "").encode("utf-8", "replace"), [], 0
                for p in (parts := parts.as_py()):
                    left.append(t[at : p["s"]])
                    at = p["e"]
                left = b"".join([*left, t[at:]])
                rows.append((doc.as_py(), len(t), len(t) - len(left), len(parts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    cut_ = wanted(rows, spans.select("id"), "id").join(spans.hint("shuffle_merge"), ["id", "d"]).select("doc_id", "text", "spans").mapInArrow(run, REMOVED)
    return clean.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", "text").unionByName(cut_)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))
