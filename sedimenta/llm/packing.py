"""Operator 6: conflict-constrained best-fit packing of documents into bins of fixed size.

Documents longer than a bin fill whole bins alone; what is left of them is packed like any other document, the longest first. A bin carries bitmaps of the
sources and of the duplicate clusters of its documents; a document may join if neither its source nor its cluster is there. Bins stand in
the order of the room left, and the search goes up from the first with enough room until it finds a compatible one, which thereby is the tightest;
without one a new bin is opened.

Documents are dealt into groups of bounded size by a hash of their doc_id, so that a source or cluster of any size spreads over all; each group is packed on its own.

Cases: null and empty texts have length zero and take a place in a bin as well; a null source is a source of its own; a null cluster (null text)
conflicts with nothing; rows of an equal doc_id each get a row, and share a cluster if their text is equal; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in a bin, and documents in a group, about.
CAPACITY, GROUP_DOCS = 8_192, 4_096
_BITS = 24


def best_fit(items: list[tuple[int, int, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) for each item (length, source, cluster), in the order given; lengths are within capacity."""
    room: list[int] = []  # room left << _BITS | bin, ascending
    sources, clusters, out = [], [], []
    for length, source, cluster in items:
        source_bit, cluster_bit = 1 << source, 0 if cluster is None else 1 << cluster
        at = bisect_left(room, length << _BITS)
        while at < len(room):
            b = room[at] & ((1 << _BITS) - 1)
            if not sources[b] & source_bit and not clusters[b] & cluster_bit:
                break
            at += 1
        if at < len(room):
            left = room.pop(at) >> _BITS
        else:
            b, left = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        sources[b] |= source_bit
        clusters[b] |= cluster_bit
        out.append((b, capacity - left))
        insort(room, (left - length) << _BITS | b)
    return out


def cluster_of(text: str = "text"):
    """Documents that differ in case and white space only are duplicates."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(F.col(text))), r"\s+", " "))


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, length=None, cluster=None) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, start) for each piece of each row of docs (doc_id, source, text).

    length and cluster are columns of docs: bytes of text and its normalised hash if not given; n_tokens is a piece's part of length. bin_id is the same for pieces in one bin.
    """
    size = F.coalesce((length if length is not None else F.octet_length(F.col("text").cast("binary"))).cast("long"), F.lit(0).cast("long"))
    own = F.when(F.col("text").isNotNull(), cluster if cluster is not None else cluster_of())
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), own.cast("string").alias("cluster"), F.pmod(F.xxhash64("doc_id", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1))), F.lit(groups)).cast("long").alias("g")
    )

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, sources, clusters = (table.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster"))
        number_s: dict = {}
        number_c: dict = {}
        # a doc_id below all for null; the cluster last, for a fixed order of equal lengths
        order = sorted(range(len(ids)), key=lambda i: (-(sizes[i] % capacity), ids[i] is not None, ids[i] or 0, clusters[i] or "", sources[i] or ""))
        rest = [i for i in order if sizes[i] % capacity or not sizes[i]]
        placed = best_fit([(sizes[i] % capacity, number_s.setdefault(sources[i], len(number_s)), None if clusters[i] is None else number_c.setdefault(clusters[i], len(number_c))) for i in rest], capacity)
        bins = 1 + max((b for b, _ in placed), default=-1)
        rows = [(ids[i], sizes[i] // capacity, sizes[i] % capacity, b, start) for i, (b, start) in zip(rest, placed)]
        for i in order:
            for k in range(sizes[i] // capacity):
                rows.append((ids[i], k, capacity, bins, 0))
                bins += 1
        base = table.column("g")[0].as_py() << 32
        columns = list(zip(*rows))
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "piece": pa.array(columns[1], pa.int32()), "n_tokens": pa.array(columns[2], pa.int64()), "bin_id": pa.array([base + b for b in columns[3]], pa.int64()), "start": pa.array(columns[4], pa.int64())})

    return items.groupBy("g").applyInArrow(run, "doc_id long, piece int, n_tokens long, bin_id long, start long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into bins of 8,192 bytes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("n_tokens", "n_bytes")
