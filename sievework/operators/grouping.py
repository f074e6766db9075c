"""Groups of duplicates: sets connected by equal bytes and look-alike hashes, split around keepers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.durable import Shelf, cut
from sievework.functions.hashing import hamming
from sievework.operators.components import connected_components
from sievework.operators.match import representatives, same_time, similar_pairs, with_look
from sievework.operators.ranking import keeper_reasons, order_struct, rank_keys, rank_order
from sievework.schema import LEVELS, SAME_PHOTO, Limits

ONE_PASS = 100_000
"""Units of a set up to which one task finds its keepers, best first; some 20 MB."""


def candidates(files: DataFrame) -> DataFrame:
    """Files with anything to match by, whatever their status."""
    return files.filter("sha256 IS NOT NULL OR (p_hash IS NOT NULL AND d_hash IS NOT NULL)")


def links(files: DataFrame, limits: Limits | None, nested: int | None = None) -> DataFrame:
    """(a, b) paths that are linked: each file with the first of its bytes, a star and not all pairs, and look-alike representatives."""
    first = files.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("b"), F.count("*").alias("n")).filter("n > 1")
    equal = files.select("sha256", F.col("path").alias("a")).join(first, "sha256").filter("a <> b").select("a", "b")
    if limits is None:
        return equal
    return equal.unionByName(similar_pairs(representatives(files), "path", limits, nested=nested).select("a", "b"))


def sets(files: DataFrame, limits: Limits | None, nested: int | None = None) -> DataFrame:
    """files in sets of two or more, with component_id, the least path."""
    comp = connected_components(links(files, limits, nested)).select(F.col("node").alias("path"), F.col("component").alias("component_id"))
    return files.join(comp, "path")


def units(rows: DataFrame) -> DataFrame:
    """rows (component_id and rank keys) with unit, the files of a set that match the same files: equal bytes, hashes and time. A file without hashes takes those of a copy of its bytes that has them."""
    by_sha = rows.filter("sha256 IS NOT NULL AND look_p IS NOT NULL").groupBy("component_id", "sha256").agg(F.min_by(F.struct("look_p", "look_d"), F.struct(F.upper("path"), F.col("path"))).alias("twin"))
    out = rows.join(by_sha, ["component_id", "sha256"], "left").withColumns({"look_p": F.coalesce("look_p", "twin.look_p"), "look_d": F.coalesce("look_d", "twin.look_d")}).drop("twin")
    return out.withColumn("unit", F.sha2(F.concat_ws("|", "component_id", F.coalesce("sha256", F.concat(F.lit("path:"), F.col("path"))), F.coalesce(F.col("look_p").cast("string"), F.lit("-")), F.coalesce(F.col("look_d").cast("string"), F.lit("-")), F.coalesce(F.col("date_taken").cast("string"), F.lit("-"))), 256))


def homes(sha: list, p: list, d: list, taken: list, limits: Limits | None) -> np.ndarray:
    """Each unit's keeper, for units of one set, best first: the first unit left takes every unit left that matches it, over and over."""
    n = len(sha)
    codes: dict = {}
    own = np.array([-i - 1 if s is None else codes.setdefault(s, len(codes)) for i, s in enumerate(sha)])
    has = np.array([x is not None and y is not None for x, y in zip(p, d, strict=True)], bool)
    a, b = (np.array([x or 0 for x in c], np.int64).view(np.uint64) for c in (p, d))
    known, time = np.array([t is not None for t in taken], bool), np.array([t or 0 for t in taken], np.int64)
    home, left = np.full(n, -1), np.arange(n)
    while len(left):
        i = left[0]
        near = own[left] == own[i]
        if limits and has[i]:
            close = has[left] & (np.bitwise_count(a[left] ^ a[i]) <= limits.p) & (np.bitwise_count(b[left] ^ b[i]) <= limits.d)
            near |= close & (~(known[left] & known[i]) | (time[left] == time[i])) if limits.same_time else close
        near[0] = True
        home[left[near]] = i
        left = left[~near]
    return home


def in_one_pass(v: DataFrame, limits: Limits | None) -> DataFrame:
    """v (component_id, unit, o, sha256, look_p, look_d, date_taken) -> unit, keeper_unit. Each set is worked through in rank order by one task."""
    taken = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_taken)").alias("taken")
    rows = v.select("component_id", "unit", "o", "sha256", "look_p", "look_d", taken).repartition("component_id").sortWithinPartitions("component_id", "o").drop("o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            unit, *values = (list(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array([unit[i] for i in homes(*values, limits)], pa.string())], ["unit", "keeper_unit"])

        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("component_id", "unit", "sha256", "look_p", "look_d", "taken")), strict=True):
                if at != key:
                    if held:
                        yield done()
                    key, held = at, []
                held.append(row)
        if held:
            yield done()

    return rows.mapInArrow(run, "unit string, keeper_unit string")


def in_rounds(v: DataFrame, limits: Limits | None, nested: int | None, most: int) -> DataFrame:
    """in_one_pass() for sets of any size. Taking the best file left, and with it every file left that matches it, over and over, picks the first maximal independent set in rank order; every other unit goes to its best-ranked neighbour in that set. In a round the units with no better undecided neighbour become keepers, and their neighbours are decided; so each round decides the best unit of every set at least. Once no set has over `most` undecided units the rest is done in one pass each."""
    near = similar_pairs(v, "unit", limits, nested=nested, within="component_id").select("a", "b") if limits else None
    # units of the same bytes that differ in hash or time
    same = v.filter("sha256 IS NOT NULL").alias("x").join(v.filter("sha256 IS NOT NULL").alias("y"), F.expr("x.component_id = y.component_id AND x.sha256 = y.sha256 AND x.unit < y.unit")).select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))
    edges = (near.unionByName(same) if near is not None else same).distinct()
    order = v.select("unit", "o")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with Shelf(v.sparkSession, "split") as shelf:
        # (worse, better)
        ranked = shelf.keep(both.join(order.select(F.col("unit").alias("a"), F.col("o").alias("oa")), "a").join(order.select(F.col("unit").alias("b"), F.col("o").alias("ob")), "b").filter("ob < oa").select("a", "b", "ob"))
        left, state, keepers = ranked, shelf.keep(v.select("component_id", "unit")), []
        while not state.groupBy("component_id").count().filter(F.col("count") > most).isEmpty():
            new = shelf.keep(state.join(left.select(F.col("a").alias("unit")).distinct(), "unit", "left_anti").select("unit"))
            keepers.append(new)
            lost = left.join(new.select(F.col("unit").alias("b")), "b", "left_semi").select(F.col("a").alias("unit")).distinct()
            after = shelf.keep(state.join(new, "unit", "left_anti").join(lost, "unit", "left_anti"))
            shelf.drop(state)
            state, before = after, left
            left = shelf.keep(left.join(state.select(F.col("unit").alias("a")), "a", "left_semi").join(state.select(F.col("unit").alias("b")), "b", "left_semi"))
            if before is not ranked:
                shelf.drop(before)
        rest = in_one_pass(v.join(state.select("unit"), "unit", "left_semi"), limits)
        keepers.append(rest.filter("unit = keeper_unit").select("unit"))
        kept = shelf.keep(reduce(DataFrame.unionByName, keepers))
        home = ranked.join(kept.select(F.col("unit").alias("b")), "b", "left_semi").groupBy("a").agg(F.min_by("b", "ob").alias("keeper_unit"))
        return cut(kept.select("unit", F.col("unit").alias("keeper_unit")).unionByName(home.join(kept.select(F.col("unit").alias("a")), "a", "left_anti").select(F.col("a").alias("unit"), "keeper_unit")))


def split(rows: DataFrame, limits: Limits | None, nested: int | None = None, most: int = ONE_PASS) -> DataFrame:
    """rows with keeper_unit, the unit that the file's unit is grouped around: the best file left takes every file left that matches it, over and over. Copies of one file are one unit however many there are. Sets of up to `most` units are worked through by one task each, larger ones in rounds."""
    rows = cut(units(rows))
    v = cut(rows.groupBy("component_id", "unit").agg(F.min(order_struct()).alias("o"), F.first("sha256").alias("sha256"), F.first("look_p").alias("look_p"), F.first("look_d").alias("look_d"), F.first("date_taken").alias("date_taken")))
    large = v.groupBy("component_id").count().filter(F.col("count") > most).select("component_id")
    if large.isEmpty():
        found = in_one_pass(v, limits)
    else:
        found = in_one_pass(v.join(large, "component_id", "left_anti"), limits).unionByName(in_rounds(cut(v.join(large, "component_id", "left_semi")), limits, nested, most))
    return rows.join(found, "unit")


def group(files: DataFrame, level: str | Limits | None = "SamePhoto", nested: int | None = None) -> DataFrame:
    """A row for each member of each group of two or more: group_id (the keeper's path), component_id, rank within the group, kind, the distances to the keeper, and the catalog's columns and rank keys.

    Keys are measured against the whole connected set. Files without bytes' digest and hashes take no part. level: a name of LEVELS, or limits of one's own."""
    limits = LEVELS[level] if isinstance(level, str) else level
    rows = rank_keys(with_look(sets(candidates(files), limits, nested)), "component_id")
    members = split(rows, limits, nested)
    best = members.groupBy("keeper_unit").agg(F.min(F.struct(order_struct().alias("o"), "path", "sha256", "look_p", "look_d", "date_taken")).alias("_best"), F.count("*").alias("_size")).filter("_size > 1")
    out = members.join(best, "keeper_unit")
    p, d = hamming(F.col("look_p"), F.col("_best.look_p")), hamming(F.col("look_d"), F.col("_best.look_d"))
    kind = (
        F.when(F.col("path") == F.col("_best.path"), "Keeper")
        .when(F.coalesce(F.col("sha256") == F.col("_best.sha256"), F.lit(False)), "Identical")
        .when(F.coalesce((F.col("p_distance") <= SAME_PHOTO.p) & (F.col("d_distance") <= SAME_PHOTO.d), F.lit(False)) & same_time(F.col("date_taken"), F.col("_best.date_taken")), "SamePhoto")
        .otherwise("Similar")
    )
    out = out.withColumns({"p_distance": p, "d_distance": d}).withColumns({"kind": kind, "group_id": F.col("_best.path")}).drop("_best", "_size", "unit", "keeper_unit", "look_p", "look_d")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*rank_order())))


def groups(members: DataFrame) -> DataFrame:
    """(group_id, keeper, rival, reason) of each group."""
    return keeper_reasons(members, "group_id")
