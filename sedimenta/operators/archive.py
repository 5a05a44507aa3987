"""Encoded archives: lanes, blocks, spans, reconstruction and verification."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import codecs
from sedimenta.functions import constants as C
from sedimenta.operators import chunking


class Archive(NamedTuple):
    """files (file_index, path, raw_size, crc32), spans, and blocks (block_id, tag, codec, raw_len, comp_len, raw_crc32, h32, payload)."""

    files: DataFrame
    spans: DataFrame
    blocks: DataFrame


def _mapped(df: DataFrame, schema: str, one) -> DataFrame:
    """df with the columns of schema added; one makes a row's values from its content."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    kept = [c for c in df.columns if c != "content"]

    def run(batches):
        for batch in batches:
            rows = [one(b or b"") for b in batch.column(len(kept)).to_pylist()]
            made = [pa.array([r[i] for r in rows], types[f.split()[1]]) for i, f in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *made], names=[*kept, *names])

    return df.select(*kept, "content").mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", " + schema)


def probe(files: DataFrame, probe_bytes: int = C.PROBE_BYTES, level: int = C.PROBE_LEVEL) -> DataFrame:
    """(file_index, raw_size, probe_len, gain): how much the head of each file compresses."""

    def one(b):
        n = len(codecs.compress(b, C.CODEC_ZLIB, level))
        return n, 1 - n / len(b) if b else 0.0

    return _mapped(files.select("file_index", "raw_size", F.substring("content", 1, probe_bytes).alias("content")), "probe_len long, gain double", one)


def encode_whole(files: DataFrame, level: int = 3) -> DataFrame:
    """Each file as one block."""

    def one(b):
        codec, payload = codecs.best_codec(b, level)
        return codec, len(payload), payload

    return _mapped(files.select("file_index", "raw_size", F.crc32("content").alias("raw_crc32"), "content"), "codec int, comp_len long, payload binary", one)


def codec_counts(blocks: DataFrame) -> DataFrame:
    name = F.when(F.col("codec") == C.CODEC_STORE, "STORE").when(F.col("codec") == C.CODEC_ZSTD, "ZSTD").when(F.col("codec") == C.CODEC_ZLIB, "ZLIB").otherwise(F.format_string("unknown(%d)", "codec"))
    return blocks.groupBy(name.alias("codec")).agg(F.count("*").alias("blocks"), F.sum("comp_len").alias("comp_bytes"))


def roundtrip(files: DataFrame) -> DataFrame:
    """(file_index, whole_ok, zstd_ok, motif_ok, motifs): whether decoding gives each file back."""

    def one(b):
        codec, payload = codecs.best_codec(b)
        motifs = [m for m, _, _ in codecs.top_motifs(b[: C.PROBE_BYTES])]
        back = codecs.motif_decode(codecs.motif_encode(b, motifs), motifs, len(b))
        return codecs.decompress(payload, codec, len(b)) == b, codecs.decompress(codecs.compress(b, C.CODEC_ZSTD), C.CODEC_ZSTD, len(b)) == b, back == b, len(motifs)

    return _mapped(files.select("file_index", "content"), "whole_ok boolean, zstd_ok boolean, motif_ok boolean, motifs int", one)


def roundtrip_delta(files: DataFrame) -> DataFrame:
    """(file_index, raw_size, ops_len, ok): each file as a delta against the first of its ten."""
    base = files.where("file_index % 10 = 0").select(F.col("file_index").alias("b"), F.col("content").alias("base"))
    both = files.join(base, F.col("b") == F.col("file_index") - F.col("file_index") % 10).select("file_index", "raw_size", "content", "base")

    def run(batches):
        for batch in batches:
            ops = [codecs.delta_encode(c, b) for c, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ok = [codecs.delta_decode(o, b, len(c)) == c for o, c, b in zip(ops, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(o) for o in ops], pa.int64()), pa.array(ok)], names=["file_index", "raw_size", "ops_len", "ok"])

    return both.mapInArrow(run, "file_index long, raw_size long, ops_len long, ok boolean")


def build(files: DataFrame, chunk_size: int = C.CHUNK_SIZE, level: int = 3) -> Archive:
    """The chunked lane for all files: deduplicated blocks, compressed where they are first seen."""
    parts = chunking.chunks(files, chunk_size, with_bytes=True)
    thin = parts.drop("chunk")
    known = chunking.blocks(thin)
    spans = chunking.spans(thin, known)
    first = parts.join(known.select("file_index", "chunk_no", "block_id"), ["file_index", "chunk_no"])

    def one(b):
        codec, payload = codecs.best_codec(b, level)
        return codec, len(payload), payload

    blocks = _mapped(first.select("block_id", F.lit("CHNK").alias("tag"), "raw_len", "h32", F.crc32("chunk").alias("raw_crc32"), F.col("chunk").alias("content")), "codec int, comp_len long, payload binary", one)
    return Archive(files.select("file_index", "path", "raw_size", F.crc32("content").alias("crc32")), spans, blocks)


def reconstruct(archive: Archive) -> DataFrame:
    """(file_index, content) from spans and blocks; a file's spans are its own, so a group is a file."""
    raw = _decoded(archive.blocks)
    joined = archive.spans.join(raw, "block_id")
    pieces = joined.groupBy("file_index").agg(F.array_sort(F.collect_list(F.struct("span_no", F.expr("substring(raw, 1, span_raw_len)").alias("raw")))).alias("p"))

    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(p) for p in batch.column(1).to_pylist()], pa.binary())], names=["file_index", "content"])

    whole = pieces.select("file_index", F.col("p.raw").alias("raw")).mapInArrow(join, "file_index long, content binary")
    return archive.files.select("file_index").join(whole, "file_index", "left").select("file_index", F.coalesce("content", F.lit(b"")).alias("content"))


def _decoded(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = [codecs.decompress(p or b"", c, n) for p, c, n in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["block_id", "raw"])

    return blocks.select("block_id", "codec", "raw_len", "payload").mapInArrow(run, "block_id long, raw binary")


def verify(archive: Archive) -> DataFrame:
    """(file_index, raw_size, ok) of every file, good or bad: size and checksum of what is reconstructed."""
    back = reconstruct(archive)
    good = (F.octet_length("content") == F.col("raw_size")) & (F.crc32("content") == F.col("crc32"))
    return archive.files.join(back, "file_index", "left").select("file_index", "raw_size", F.coalesce(good, F.lit(False)).alias("ok"))


def micro_entry_spans(entries: DataFrame) -> DataFrame:
    """Entries (file_index, raw_size, block_id) laid out in their blocks and found again from span flags: (block_id, entry) is the join's key."""
    order = Window.partitionBy("block_id").orderBy("file_index")
    laid = entries.select("file_index", "raw_size", "block_id", (F.row_number().over(order) - 1).cast("long").alias("entry"), F.coalesce(F.sum("raw_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    spans = laid.select("file_index", "block_id", F.col("raw_size").alias("span_raw_len"), F.shiftleft("entry", 16).bitwiseOR(F.lit(C.SPAN_LAST | C.SPAN_MICRO).cast("long")).alias("flags"))
    table = laid.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("entry", "offset", "raw_size"))).alias("e"))  # at most an entry table
    flat = table.select("block_id", F.posexplode("e").alias("no", "x")).select("block_id", F.col("no").cast("long").alias("entry"), F.col("x.offset").alias("offset"), F.col("x.raw_size").alias("raw_size"))
    found = spans.withColumn("entry", F.shiftrightunsigned("flags", 16)).join(flat, ["block_id", "entry"])
    return found.select("file_index", "block_id", "entry", "offset", "span_raw_len", (F.col("raw_size") == F.col("span_raw_len")).alias("fits"))


def chain_depth(edges: DataFrame) -> DataFrame:
    """(file_index, depth): how many bases a file needs, for edges (file_index, base). Jumps double each round, so rounds are the depth's logarithm."""
    state = edges.select("file_index", F.col("base").alias("jump"), F.when(F.col("base").isNull(), 0).otherwise(1).alias("depth"))
    while True:
        far = state.select(F.col("file_index").alias("jump"), F.col("jump").alias("_jump"), F.col("depth").alias("_depth"))
        state = state.join(far, "jump", "left").select("file_index", F.col("_jump").alias("jump"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        if not state.where("jump IS NOT NULL").limit(1).count():
            return state.select("file_index", "depth")
