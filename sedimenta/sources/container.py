"""The archive as one file: sections with tagged, length-prefixed payloads.

Layout: magic and version; then sections of a four-byte tag and a 64-bit length: HEAD (JSON), CHNK for each block, FIDX (the files with
their spans) and END!. All numbers are little-endian. Writing streams the blocks in order of their ids through one writer, as a file has one end;
it goes to a temporary name and is renamed when whole. Reading keeps payload places only, and executors fetch payloads.
"""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import constants as C
from sedimenta.operators.archive import Archive

# Fixed layouts of the format.
FILE_HEADER = struct.Struct("<4sH")
SECTION = struct.Struct("<4sQ")
CHUNK = struct.Struct("<QBBHIII32s")
COUNT = struct.Struct("<I")
FILE = struct.Struct("<HQQIIBBH")
SPAN = struct.Struct("<QII")


def write(archive: Archive, target: str) -> None:
    """Writes an archive to a path of the driver."""
    if os.path.isdir(target):
        raise IsADirectoryError(target)
    temporary = f"{target}.tmp"
    totals = archive.files.selectExpr("count(*) AS files", "coalesce(sum(raw_size), 0) AS raw_bytes").first().asDict()
    head = json.dumps({"format": C.FORMAT_VERSION, "stats": totals}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    section = lambda tag, payload: SECTION.pack(tag, len(payload)) + payload
    with open(temporary, "wb") as f:
        f.write(FILE_HEADER.pack(C.MAGIC, C.FORMAT_VERSION) + section(b"HEAD", head))
        for b in archive.blocks.orderBy("block_id").toLocalIterator():
            payload = bytes(b.payload or b"")
            f.write(section(b"CHNK", CHUNK.pack(b.block_id, b.codec, 0, 0, b.raw_len, len(payload), b.raw_crc32, bytes.fromhex(b.h32)) + payload))
        own = archive.spans.groupBy("file_index").agg(F.array_sort(F.collect_list(F.struct("span_no", "block_id", "span_raw_len", "span_flags"))).alias("s"))
        records, n = [], 0
        for r in archive.files.join(own, "file_index", "left").orderBy("file_index").toLocalIterator():
            path = r.path.encode()
            spans = b"".join(SPAN.pack(s.block_id, s.span_raw_len, s.span_flags) for s in r.s or [])
            records.append(FILE.pack(len(path), 0, r.raw_size, r.crc32, len(r.s or []), 0, 0, 0) + path + spans)
            n += 1
        f.write(section(b"FIDX", COUNT.pack(n) + b"".join(records)) + section(b"END!", b""))
    os.replace(temporary, target)


def parse(data: bytes) -> tuple[dict, list[tuple], list[tuple], list[tuple]]:
    """(head, blocks with the place of their payload, files, spans) of an archive's bytes; damage raises."""
    if len(data) < FILE_HEADER.size or FILE_HEADER.unpack_from(data) != (C.MAGIC, C.FORMAT_VERSION):
        raise ValueError("not an archive of this version")
    at, head, blocks, files, spans, ended = FILE_HEADER.size, {}, {}, [], [], False
    while not ended:
        if at + SECTION.size > len(data):
            raise ValueError("the archive ends within a section header")
        tag, size = SECTION.unpack_from(data, at)
        at += SECTION.size
        if at + size > len(data):
            raise ValueError("the archive ends within a section")
        if tag == b"HEAD":
            head = json.loads(data[at : at + size])
        elif tag == b"CHNK":
            block_id, codec, _, _, raw_len, comp_len, crc, h32 = CHUNK.unpack_from(data, at)
            blocks[block_id] = (block_id, codec, raw_len, comp_len, crc, h32.hex(), at + CHUNK.size)
        elif tag == b"FIDX":
            (n,), p = COUNT.unpack_from(data, at), at + COUNT.size
            for i in range(n):
                path_len, _, raw_size, crc, n_spans, _, _, _ = FILE.unpack_from(data, p)
                p += FILE.size
                files.append((i, data[p : p + path_len].decode("utf-8", "replace"), raw_size, crc))
                p += path_len
                for k in range(n_spans):
                    spans.append((i, k, *SPAN.unpack_from(data, p)))
                    p += SPAN.size
        ended = tag == b"END!"
        at += size
    return head, list(blocks.values()), files, spans


def read(spark: SparkSession, source: str) -> Archive:
    """The tables of an archive on a path that driver and executors share; the index is read on the driver, payloads on executors."""
    with open(source, "rb") as f:
        _, blocks, files, spans = parse(f.read())
    where = spark.createDataFrame(blocks, "block_id long, codec int, raw_len long, comp_len long, raw_crc32 long, h32 string, place long")

    def fetch(batches):
        with open(source, "rb") as f:
            for batch in batches:
                payloads = []
                for place, size in zip(batch.column(6).to_pylist(), batch.column(3).to_pylist()):
                    f.seek(place)
                    payloads.append(f.read(size))
                b = batch.columns
                yield pa.RecordBatch.from_arrays([b[0], pa.array(["CHNK"] * batch.num_rows), *b[1:6], pa.array(payloads, pa.binary())], names=["block_id", "tag", "codec", "raw_len", "comp_len", "raw_crc32", "h32", "payload"])

    return Archive(
        spark.createDataFrame(files, "file_index long, path string, raw_size long, crc32 long"),
        spark.createDataFrame(spans, "file_index long, span_no long, block_id long, span_raw_len long, span_flags long"),
        where.mapInArrow(fetch, "block_id long, tag string, codec int, raw_len long, comp_len long, raw_crc32 long, h32 string, payload binary"),
    )


def info(archive: Archive) -> DataFrame:
    """Blocks and bytes by tag and by codec, and in all."""
    b = archive.blocks.select("tag", "codec", "raw_len", "comp_len")
    return b.groupingSets([["tag"], ["codec"], []], "tag", "codec").agg(F.count("*").alias("n"), F.sum("raw_len").alias("raw_bytes"), F.sum("comp_len").alias("comp_bytes"))


def extract(archive: Archive, target: str) -> None:
    """Writes every file below target, a folder that executors share; absolute paths and those that climb out are refused."""
    from sedimenta.operators.archive import reconstruct

    bad = archive.files.where(F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), ".."))
    if bad.limit(1).count():
        raise ValueError("a path leaves the target folder")

    def put(rows):
        for r in rows:
            path = os.path.join(target, r.path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "wb") as f:
                f.write(bytes(r.content))
            os.replace(path + ".part", path)

    reconstruct(archive).join(archive.files.select("file_index", "path"), "file_index").foreachPartition(put)
