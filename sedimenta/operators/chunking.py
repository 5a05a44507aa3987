"""Chunks, first-seen blocks and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import constants as C
from sedimenta.operators.ordering import running_total


def chunks(files: DataFrame, size: int = C.CHUNK_SIZE, with_bytes: bool = False) -> DataFrame:
    """(file_index, chunk_no, raw_len, h32): fixed-size chunks with their SHA-256; an empty file has none."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    parts = files.where(F.octet_length("content") > 0).select("file_index", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    chunk = F.expr(f"substring(content, chunk_no * {size} + 1, {size})")
    out = parts.select("file_index", F.col("chunk_no").cast("long").alias("chunk_no"), chunk.alias("chunk"))
    return out.select("file_index", "chunk_no", F.octet_length("chunk").cast("long").alias("raw_len"), F.sha2("chunk", 256).alias("h32"), *["chunk"] * with_bytes)


def first_seen(parts: DataFrame) -> DataFrame:
    """(h32, file_index, chunk_no, raw_len): where each distinct chunk comes first."""
    return parts.groupBy("h32").agg(F.min(F.struct("file_index", "chunk_no", "raw_len")).alias("f")).select("h32", "f.file_index", "f.chunk_no", "f.raw_len")


def blocks(parts: DataFrame) -> DataFrame:
    """first_seen with block_id: dense from 1 in the order of files and chunks."""
    first = first_seen(parts)
    before = running_total(first.groupBy("file_index").agg(F.count("*").alias("n")), "n", "file_index", "before").select("file_index", "before")
    row = F.row_number().over(Window.partitionBy("file_index").orderBy("chunk_no"))
    return first.withColumn("_row", row).join(before, "file_index").select("h32", "file_index", "chunk_no", "raw_len", (F.col("before") + F.col("_row")).alias("block_id"))


def spans(parts: DataFrame, with_blocks: DataFrame | None = None) -> DataFrame:
    """(file_index, span_no, block_id, span_raw_len, span_flags): each chunk with its block; a file's last span is flagged."""
    own = (with_blocks if with_blocks is not None else blocks(parts)).select("h32", "block_id")
    last = parts.groupBy("file_index").agg(F.max("chunk_no").alias("_last"))
    joined = parts.join(own, "h32").join(last, "file_index")
    return joined.select("file_index", F.col("chunk_no").alias("span_no"), "block_id", F.col("raw_len").alias("span_raw_len"), F.when(F.col("chunk_no") == F.col("_last"), C.SPAN_LAST).otherwise(0).alias("span_flags"))


def dedupe_report(files: DataFrame, size: int) -> DataFrame:
    """For each file its chunks and bytes, and those that no earlier file or chunk has."""
    new = first_seen(chunks(files, size)).groupBy("file_index").agg(F.count("*").alias("new_chunks"), F.sum("raw_len").alias("new_bytes"))
    known = files.select("file_index", F.ceil(F.octet_length("content") / size).cast("long").alias("chunks"), F.octet_length("content").cast("long").alias("raw_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = known.join(new, "file_index", "left").select("file_index", "chunks", zero("new_chunks"), "raw_bytes", zero("new_bytes"))
    return out.withColumn("kept_ratio", F.when(F.col("raw_bytes") > 0, F.round(F.col("new_bytes") / F.col("raw_bytes"), 6)).otherwise(F.lit(0.0)))
