"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.durable import Shelf, cut
from sievework.functions.hot import salted

SMALL = 1_000_000
"""Edges up to which one task finds all components, in one pass and some 100 MB."""


def roots(edges: Iterator[tuple]) -> Iterator[tuple]:
    """(node, least node of its set) of every node of the edges, by union-find."""
    up: dict = {}

    def find(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in edges:
        up.setdefault(a, a)
        up.setdefault(b, b)
        p, q = find(a), find(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    return ((x, find(x)) for x in up)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """edges (a, b) -> node, component: the least node of its set, a row for each node that has an edge.

    Up to `small` edges, counted, one task joins them. Beyond that by rounds of two steps over all edges. Large star: every greater neighbour of a node is linked to the least of the node and its neighbours. Small star: the smaller neighbours are, and the node itself. Each pair of steps halves the depth of the trees at least, so the rounds grow with the logarithm of the nodes, and a round without change ends them. A node's neighbours are only reduced to their least, which partial aggregation does before the shuffle, and the joins deal a hub's edges over copies of its row. Edges with a null end and loops are left out, though a looped node counts as a node."""
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    with Shelf(spark, "components") as shelf:
        all_ = shelf.keep(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if all_.count() <= small:
            kind = all_.schema["u"].dataType.simpleString()

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found, types = [], None
                pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                found = list(roots(pairs))
                types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], types), pa.array([y for _, y in part], types)], ["node", "component"])

            return cut(all_.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))
        loops = all_.filter("u = v").select(F.col("u").alias("node"))
        now, mark = shelf.keep(all_.filter("u <> v")), None
        while True:
            rows = now.count()
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = shelf.keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")))
            # each edge (u > v): its greater end goes to the least neighbour of the lesser one
            large = salted(now, near.select(F.col("u").alias("v"), "m"), "v", near.select(F.col("u").alias("v"), "n"), rows, "u").select("u", F.col("m").alias("v")).filter("u <> v")
            kept = shelf.keep(large.unionByName(near.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
            low = shelf.keep(kept.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
            small_ = salted(kept, low.select("u", "m"), "u", low.select("u", "n"), rows, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
            after = shelf.keep(small_.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
            shelf.drop(now, near, kept, low)
            now = after
            # the same edges as before give the same count and sums of digests
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))).first()
            if seen == mark:
                break
            mark = seen
        stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        found = stars.unionByName(tops)
        return cut(found.unionByName(loops.join(found, "node", "left_anti").withColumn("component", F.col("node"))))
