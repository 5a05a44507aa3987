"""Connected components of a distributed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import scratch


def _forest(batches):
    """Spanning stars of the edges of each batch: a batch's edges in, at most one edge per node out."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x] = top
                x = up
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                parent.setdefault(a, a)
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def _stars(edges: DataFrame, up_only: bool) -> DataFrame:
    """One large-star (up_only False) or small-star step; edges have v < u in and out."""
    both = edges if up_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if up_only:  # every smaller neighbour, and the node itself, to the least one
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:  # every larger neighbour to the least one
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u long, v long) undirected edges -> (node, component): the smallest node that is reachable, for every node of an edge.

    Edges of equal or null ends add nothing. Batches are first shortened to stars by union-find, each on its own, then large-star and
    small-star steps alternate until the edge set stays the same. Both steps keep at most as many edges as there were. Every step is a
    written table; a component is never gathered as a whole, but the edges of one hub, once each, meet in a join by node, whose skewed partitions
    adaptive execution splits.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    now = scratch.save(edges.mapInArrow(_forest, "u long, v long").distinct(), name)
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:
        after = scratch.save(_stars(_stars(now, up_only=False), up_only=True), name)
        scratch.drop(now)
        now, before = after, seen
        seen = print_of(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
