"""Operator 7: near duplicates by SetSketch registers.

A register keeps the least of exponential variates that the shingles draw, on an exponential scale and truncated to 16 bits: K = floor(1 - log_B(min)), within 0 and 65,535. Registers of a union are the greater of two, so sketches merge; two sets agree in a register about as often as their similarity. Bands of registers bring candidates together; of a candidate pair the similarity is estimated by maximum likelihood from the numbers of registers that are greater, equal and less, given both set sizes; what may reach the threshold is verified on the full sets.

No bucket is expanded into pairs. Documents of one set are one node. Every node is first compared with the least node of all its buckets, and linked nodes become one component. A bucket of several components stays open: each of its nodes outside its largest component is compared with one node of that, in rounds, as long as these are worth it; at last whatever isn't in a bucket's largest component is compared with all of the bucket that it isn't joined to, in blocks that return links alone, and of these no more than connect what all of them do. So no pair that shares a bucket is left undecided, and the pairs stay about as many as the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.components import connected_components

from . import blocks
from .common import Shelf, cut, lookup, salted, slices, table, wanted
from .shingling import shingles

ROWS, BANDS = 6, 48
"""A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 6) ** 48 = 5e-7."""
M = ROWS * BANDS
BASE = 1.001
RATE = 20.0
TOP = 65_535
SIGMAS = 5.0
"""A pair is verified unless its estimate is this many standard deviations below the threshold."""
ENOUGH = 256
"""Rounds go on until the comparisons that are left are so many for each row of the buckets, or a round has settled less than a tenth of them; then all of them are made, in blocks."""
WORK = 1 << 15
_A, _B = (x.astype(np.uint32) | np.uint32(1) for x in np.random.default_rng(77).integers(0, 1 << 32, (2, M), dtype=np.uint64))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x M, uint16); an empty set's are 0."""
    out = np.zeros((len(sets), M), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))
    least = np.full((len(full), M), 0xFFFFFFFF, np.uint32)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < len(full):
        # documents up to WORK shingles at a time, which the processor's cache holds; a longer one in pieces
        last = max(first + 1, int(np.searchsorted(at, at[first] + WORK, "right")) - 1)
        for lo in range(int(at[first]), int(at[last]), WORK):
            hi = min(lo + WORK, int(at[last]))
            cuts = np.clip(at[first:last], lo, hi) - lo
            cuts = cuts if last > first + 1 else np.zeros(1, np.int64)
            l, h, buf, tmp = low[lo:hi], high[lo:hi], np.empty(hi - lo, np.uint32), np.empty(hi - lo, np.uint32)
            for j in range(M):
                np.multiply(l, _A[j], out=buf)
                np.multiply(h, _B[j], out=tmp)
                np.add(buf, tmp, out=buf)
                m = np.minimum.reduceat(buf, cuts)
                np.minimum(least[first:last, j], m, out=least[first:last, j])
            if last > first + 1:
                break
        first = last
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    out[full] = np.clip(np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of each pair of sketches (pairs x M) of sets of na and nb elements at which the numbers of registers greater, less and equal are likeliest."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        pu, pv = p(u - v * j), p(v - u * j)
        eps = 1e-12
        return up * np.log(np.maximum(pu, eps)) + down * np.log(np.maximum(pv, eps)) + same * np.log(np.maximum(1 - pu - pv, eps))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5.0) - 1) / 2
    for _ in range(30):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(c) > likelihood(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each sketch and band (sketches x BANDS, int64)."""
    codes = np.random.default_rng(5).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    salt = np.random.default_rng(6).integers(1, 1 << 63, BANDS, dtype=np.uint64)
    parts = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = salt + np.zeros((len(parts), 1), np.uint64)
    for j in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (parts[:, :, j] + np.uint64(1)) * codes[:, j]
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _sets(part: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """The shingle sets of a batch's texts, their registers and their digests (null: empty set)."""
    sets = shingles([(x.as_py() or "").encode("utf-8", "replace") for x in part.column("text")], k)
    return sets, registers(sets), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def _id() -> Column:
    """doc_id without nulls, for joins."""
    return F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("id")


def sketches(docs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, keep...) -> doc_id, n_shingles, digest of the set (null: empty set), bands (their keys), keep... Narrow."""
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, regs, digests = _sets(part, k)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band_keys(regs).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), digests, bands, *(part.column(n) for n in keep)], ["doc_id", "n_shingles", "digest", "bands", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>" + kept)


def full_sets(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """need (node, id, digest) -> node, n, regs, items: the node's whole set and its sketch, from its document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, regs, digests = _sets(part, k)
                yield pa.RecordBatch.from_arrays([part.column("id"), digests, pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "digest", "n", "regs", "items"])

    found = wanted(docs.select(_id(), "text"), need.select("id"), "id").mapInArrow(run, "id long, digest binary, n long, regs binary, items binary")
    # a node's own document alone, so copies don't meet in one task
    return found.join(need.hint("shuffle_merge"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select("node", "n", "regs", "items")


def linked(shelf: Shelf, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as a table of the shelf: those that the sketches' estimate doesn't rule out, confirmed on the full sets. pairs: a table. b may be hot; a isn't more often than a node's bands."""
    near = 1.0 - percent / 100.0
    floor = percent / 100.0 - SIGMAS * float(np.sqrt(percent / 100.0 * near / M))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M)
            j = estimate(get("ra"), get("rb"), batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
            keep = pa.array(j >= floor)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                # both are sorted and distinct
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(bool(len(p)) and 100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    def brought(pairs: DataFrame, columns: dict[str, str]) -> DataFrame:
        per = pairs.groupBy("b").agg(F.count("*").alias("n"))
        side = lambda s: sets.select(F.col("node").alias(s), *(F.col(c).alias(short + s) for c, short in columns.items()))
        return salted(pairs.join(side("a").hint("shuffle_merge"), "a"), side("b"), "b", per, pairs.count(), "a")

    # sizes alone rule out pairs whose smaller set is too small
    sized = brought(pairs, {"n": "n", "regs": "r"}).filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    maybe = shelf.keep(sized.mapInArrow(guess, "a long, b long"))
    found = shelf.keep(brought(maybe, {"items": "i"}).mapInArrow(confirm, "a long, b long"))
    shelf.drop(maybe)
    return found


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def undecided(shelf: Shelf, here: DataFrame, open_: DataFrame) -> DataFrame:
    """The groups in which the rest is compared: open buckets, or all open buckets of one largest component as one group where that makes fewer comparisons, as when near copies meet in many bands. here: a row for each node of an open bucket."""
    cost = open_.groupBy("main").agg(F.sum((F.col("n") - F.col("c")) * F.col("n")).alias("cost"))
    family = shelf.keep(here.select("main", "node", "size", "component").distinct())
    out = F.sum((F.col("component") != F.col("main")).cast("long"))
    wide = shelf.keep(family.groupBy("main").agg(F.count("*").alias("f"), out.alias("o")).join(cost, "main").withColumn("n", F.col("f")).filter("f * o <= cost").select("main", "n"))
    rows = lambda df, grp: df.select(grp.alias("grp"), "node", F.col("component").alias("part"), (F.col("component") != F.col("main")).alias("seeks"), "size")
    one = lookup(family, wide, "main", family.count())
    other = here.drop("n").join(wide.select(F.col("main").alias("_wide")), F.col("main") == F.col("_wide"), "left_anti")
    return shelf.keep(rows(one, F.struct(F.lit(0).alias("kind"), F.col("main").alias("at"))).unionByName(rows(other, F.struct(F.lit(1).alias("kind"), F.col("key").alias("at")))).withColumn("grp", F.concat(F.col("grp.kind").cast("string"), F.lit(":"), F.col("grp.at").cast("string"))))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, keep...) -> doc_id, n_shingles, keep..., component_id, kept. Documents whose sets of k-word shingles have 100 * intersection >= percent * union are linked; component_id is the least doc_id reachable.

    Words: runs other than white space, A-Z in lower case. Fewer than k words: the whole sequence is the one shingle. Null, empty or blank text: an empty set, linked with nothing and kept. Equal sets are linked, so all but the least doc_id of a group of copies go. Repeated rows of one doc_id share its result. Null doc_id: the row takes part and belongs to a component, but is the least of none; kept where its component has no other id. Empty table: empty result. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles."""
    with Shelf(docs.sparkSession, "near") as shelf:
        made = shelf.keep(sketches(docs, k, keep))
        whole = shelf.keep(made.drop("bands"))
        alike = made.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
        banded = shelf.keep(alike.withColumn("node", F.monotonically_increasing_id()))
        shelf.drop(made)
        nodes = shelf.keep(banded.drop("bands"))
        cells = banded.select("node", "size", F.explode("bands").alias("key"))
        hubs = shelf.keep(cells.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
        total = hubs.agg(F.sum("n")).first()[0] or 0
        crowd = shelf.keep(lookup(wanted(cells, hubs.select("key"), "key"), hubs, "key", total).select("key", "node", "size", "hub"))  # only buckets of two or more
        shelf.drop(banded, hubs)
        first = shelf.keep(crowd.groupBy("node").agg(F.min("hub").alias("hub")))
        sets = shelf.keep(full_sets(docs, nodes.join(first.select("node"), "node").select("node", _id(), "digest"), k))

        asked = [shelf.keep(first.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))]
        shelf.drop(first)
        links = [linked(shelf, asked[0], sets, percent)]
        before = None
        while True:
            comp = connected_components(union(links))
            placed = shelf.keep(crowd.drop("hub").join(comp, "node", "left").withColumn("component", F.coalesce("component", F.col("node"))))
            per = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
            open_ = shelf.keep(per.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts"), F.sum("c").alias("n")).filter("parts > 1").select("key", F.col("m.component").alias("main"), F.col("m.c").alias("c"), "n"))
            left = open_.agg(F.sum((F.col("n") - F.col("c")) * F.col("n"))).first()[0] or 0
            if not left:
                break
            last = left <= ENOUGH * max(total, 1000) or (before is not None and left > 0.9 * before)
            before = left
            here = shelf.keep(lookup(placed, open_, "key", total))
            shelf.drop(placed)
            if last:
                links.append(shelf.keep(blocks.links(shelf, undecided(shelf, here, open_), sets, percent)))
                comp = connected_components(union(links))
                break
            # the least of the largest component in an order of the round, the same in all buckets; what a node meets in most of its buckets with that component is likest to it
            order = F.struct(F.xxhash64("node", F.lit(len(asked))).alias("h"), "node")
            pick = here.filter("component = main").groupBy("key").agg(F.min(order).alias("p"), F.first("n").alias("n")).select("key", F.col("p.node").alias("b"), "n")
            votes = lookup(here.filter("component <> main").select("key", "node", "main"), pick, "key", total).groupBy("node", "main", "b").agg(F.count("*").alias("votes"))
            met = votes.groupBy("node", "main").agg(F.max(F.struct("votes", "b")).alias("v")).select(F.col("node").alias("a"), F.col("v.b").alias("b"))
            tell = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            new = shelf.keep(tell(met).distinct().join(tell(union(asked)), ["a", "b"], "left_anti"))
            shelf.drop(here, open_)
            asked.append(new)
            links.append(linked(shelf, new, sets, percent))
        shelf.drop(sets, crowd, *asked)
        node_of = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
        least = node_of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
        named = shelf.keep(lookup(node_of, least, "component", max(1, nodes.count())).select("digest", "component_id", F.col("copies").alias("n")))
        some = lookup(whole.filter("digest IS NOT NULL"), named, "digest", whole.count()).select("doc_id", "n_shingles", *keep, "component_id")
        none = whole.filter("digest IS NULL").select("doc_id", "n_shingles", *keep, F.col("doc_id").alias("component_id"))
        return cut(some.unionByName(none).withColumn("kept", F.expr("doc_id <=> component_id")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


SQL = {
    "op7_minhash": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
}
