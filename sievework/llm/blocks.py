"""Comparing sets within groups, block by block, without a row for each pair.

A group's rows are cut into blocks of bounded size; a task gets one block of rows that look for partners and one of all rows, counts the elements that each two sets share, and returns of the links it finds as many as connect what all of them do. Elements in many sets of both blocks are counted by matrix products, rarer ones by their lists of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, lookup

ROWS = 2048
ITEMS = 1 << 20
"""A block has about so many rows and elements at most; a single set may be larger."""
COLUMNS = 2048
DENSE = 64
"""An element is counted by a matrix product where its pairs are over 1 / DENSE of all pairs."""
PAIRS = 1 << 21


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left has in common with each of right (left x right). Sets are sorted and distinct."""
    o, n = len(left), len(right)
    out = np.zeros((o, n), np.int64)
    x = np.concatenate(left) if o else np.empty(0, np.uint64)
    y = np.concatenate(right) if n else np.empty(0, np.uint64)
    if not len(x) or not len(y):
        return out
    words, col_x = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(words, y), len(words) - 1)
    known = words[at] == y
    col_y, row_y = at[known], np.repeat(np.arange(n), [len(s) for s in right])[known]
    row_x = np.repeat(np.arange(o), [len(s) for s in left])
    nx, ny = np.bincount(col_x, minlength=len(words)), np.bincount(col_y, minlength=len(words))
    dense = nx * ny * DENSE > o * n
    column = np.cumsum(dense) - 1
    dx, dy = dense[col_x], dense[col_y]
    order_x, order_y = np.argsort(column[col_x[dx]], kind="stable"), np.argsort(column[col_y[dy]], kind="stable")
    cx, rx, cy, ry = column[col_x[dx]][order_x], row_x[dx][order_x], column[col_y[dy]][order_y], row_y[dy][order_y]
    for lo in range(0, int(dense.sum()), COLUMNS):
        a, b = np.zeros((o, COLUMNS), np.float32), np.zeros((n, COLUMNS), np.float32)
        i, j = np.searchsorted(cx, (lo, lo + COLUMNS)), np.searchsorted(cy, (lo, lo + COLUMNS))
        a[rx[i[0] : i[1]], cx[i[0] : i[1]] - lo] = 1
        b[ry[j[0] : j[1]], cy[j[0] : j[1]] - lo] = 1
        out += (a @ b.T).astype(np.int64)
    # the others: each place of x meets all places of y with its element
    sx = ~dx & (ny[col_x] > 0)
    if sx.any():
        order = np.argsort(col_y, kind="stable")
        places, begin = row_y[order], np.cumsum(ny) - ny
        cols, rows = col_x[sx], row_x[sx]
        upto, flat, lo = np.cumsum(ny[cols]), out.ravel(), 0
        while lo < len(cols):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            k = ny[cols[lo:hi]]
            first = np.repeat(begin[cols[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            flat += np.bincount(np.repeat(rows[lo:hi], k) * n + places[first], minlength=o * n)
            lo = hi
    return out


def compare(nodes: list[int], parts: list[int], seek: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(a, b) with similar sets, a of the rows that seek, b of the rest and of another part: a spanning forest of all such pairs over their parts, so parts that the pairs connect are connected by it, and there are fewer links than parts. seek: which rows seek; the others are sought."""
    s, t = np.flatnonzero(seek), np.flatnonzero(~seek)
    if not len(s) or not len(t):
        return []
    # the root of each part's tree, by the part's place
    names, part = np.unique(np.array(parts), return_inverse=True)
    root = np.arange(len(names))
    size = np.array([len(x) for x in sets])
    both = shared([sets[i] for i in s], [sets[i] for i in t])
    near = (100 * both >= percent * (size[s][:, None] + size[t][None, :] - both)) & (both > 0)
    found = []
    for i, row in zip(s, near, strict=True):
        met = t[row]
        trees, first = np.unique(root[part[met]], return_index=True)
        for tree, j in zip(trees, met[first], strict=True):
            if tree != root[part[i]]:
                root[root == tree] = root[part[i]]
                found.append((nodes[i], nodes[j]))
    return found


def links(shelf: Shelf, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows, a table of the shelf (grp, node, part, seeks, size), sets (node, items) -> (a, b) with similar sets: of each block's pairs a spanning forest over the parts, so what all pairs connect is connected, and the links are fewer than the rows.

    A group's blocks: seekers in x parts by all rows in y parts, by their numbers and sizes; each seeker goes to y blocks and each row to x."""
    cells = lambda n, size: F.greatest(F.ceil(n / ROWS), F.ceil(size / ITEMS), F.lit(1)).cast("int")
    seeking = F.when(F.col("seeks"), F.col("size")).otherwise(0)
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"), cells(F.sum(F.col("seeks").cast("int")), F.sum(seeking)).alias("x"), cells(F.count("*"), F.sum("size")).alias("y"))
    # groups of one block, which may be many, need no table of their own
    large = shelf.keep(groups.filter("x > 1 OR y > 1"))
    dealt = lookup(rows, large, "grp", rows.count(), "left").withColumns({"x": F.coalesce("x", F.lit(1)), "y": F.coalesce("y", F.lit(1))})
    h = F.xxhash64("node", F.lit(3))
    one = dealt.filter("seeks").select("grp", "node", "part", F.lit(True).alias("seeks"), F.pmod(h, "x").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"))
    other = dealt.select("grp", "node", "part", F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i"), F.pmod(h, "y").cast("int").alias("j"))
    whole = one.unionByName(other).join(sets.select("node", "items").hint("shuffle_merge"), "node").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            found = compare(held[0], held[1], np.array(held[2], bool), held[3], percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("grp", "i", "j", "node", "part", "seeks")]
            for row in range(batch.num_rows):
                here = c[0][row], c[1][row], c[2][row]
                if here != key:
                    if key is not None:
                        yield done()
                    key, held = here, ([], [], [], [])
                held[0].append(c[3][row])
                held[1].append(c[4][row])
                held[2].append(c[5][row])
                held[3].append(np.frombuffer(batch.column("items")[row].as_py(), np.uint64))
        if key is not None:
            yield done()

    return whole.select("grp", "i", "j", "node", "part", "seeks", "items").mapInArrow(run, "a long, b long")
