"""Features of bytes, computed batch by batch next to the data; one pass, no shuffle."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import codecs
from sedimenta.functions.constants import CLASS_MEDIA, CODEC_ZLIB, MEDIA_OFFSETS, MOTIF_LENGTH, PROBE_BYTES, PROBE_LEVEL, SEEDED_CRC


def entropy(b: bytes) -> float:
    """Shannon entropy of bytes, as a share of 8 bits."""
    if not b:
        return 0.0
    p = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / len(b)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / 8)


def distinct_pairs(b: bytes) -> float:
    """Distinct overlapping byte pairs, as a share of all; 1 below two bytes."""
    if len(b) < 2:
        return 1.0
    x = np.frombuffer(b, np.uint8).astype(np.int32)
    return float(np.count_nonzero(np.bincount(x[:-1] << 8 | x[1:], minlength=65536)) / (len(b) - 1))


def windows(b: bytes, step: int, most: int, length: int = MOTIF_LENGTH) -> list[bytes]:
    return [b[i : i + length] for i in range(0, len(b) - length + 1, step)[:most]]


def motif_score(b: bytes) -> float:
    """The share of windows that came before; 0 below two windows' length."""
    if len(b) < 2 * MOTIF_LENGTH:
        return 0.0
    found = [crc32(w) for w in windows(b, 4, 4096)]
    return 1 - len(set(found)) / len(found)


def signature(b: bytes) -> list[int]:
    return [crc32(w) for w in windows(b, 8, 512)]


def simhash(b: bytes, most: int = 8192) -> int:
    """64 votes of 4-byte grams; the upper half are the grams' seeded checksums. Ties are ones."""
    if not b:
        return 0
    grams = [crc32(b[i : i + 4]) for i in range(0, min(len(b), most) - 3, 4)]
    h = np.array(grams, np.uint64)
    h |= (h ^ np.uint64(SEEDED_CRC)) << np.uint64(32)
    ones = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0) if grams else np.zeros(64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones >= len(grams)).tolist()))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def probe_gain(b: bytes) -> float:
    """How much a probe compresses, as a share of it."""
    return 1 - len(codecs.compress(b, CODEC_ZLIB, PROBE_LEVEL)) / len(b) if b else 0.0


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _of_first(f):
    return lambda probes: f(probes[0])


#: Features by name: what they are of a file's probes, and their SQL type. A fingerprint's bits are a signed long.
FEATURES = {
    "entropy": (lambda probes: _mean([entropy(b) for b in probes]), "double"),
    "uniq": (lambda probes: _mean([distinct_pairs(b) for b in probes]), "double"),
    "gain": (lambda probes: min(probe_gain(b) for b in probes), "double"),
    "motif_score": (_of_first(motif_score), "double"),
    "pi_sig": (_of_first(signature), "array<bigint>"),
    "pi_hash64": (_of_first(lambda b: _signed(simhash(b))), "bigint"),
}


def probes(content: Column, ext: Column, probe: int = PROBE_BYTES) -> Column:
    """The parts of a file that features are computed of: its head, and of media of over two probes also what follows a quarter and three quarters."""
    size = F.octet_length(content)
    part = lambda share: content.substr(F.floor(size * F.lit(share)).cast("int") + 1, F.lit(probe))
    return F.when(F.coalesce(F.lower(ext).isin(CLASS_MEDIA), F.lit(False)) & (size > 2 * probe), F.array(*[part(x) for x in MEDIA_OFFSETS])).otherwise(F.array(F.coalesce(part(0.0), F.lit(b""))))


def features_of(df: DataFrame, wanted=tuple(FEATURES), probe: int = PROBE_BYTES) -> DataFrame:
    """df (content, ext and others) without content, with the wanted features of its probes, and no others computed."""
    arrow = {"double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64()}
    chosen = [(n, *FEATURES[n]) for n in wanted]
    names = [c for c in df.columns if c != "content"]

    def run(batches):
        for batch in batches:
            taken = batch.column(len(names)).to_pylist()
            made = [pa.array([f(x) for x in taken], arrow[kind]) for _, f, kind in chosen]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *[n for n, _, _ in chosen]])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"{n} {kind}" for n, _, kind in chosen])
    return df.select(*names, probes(F.col("content"), F.col("ext"), probe).alias("probes")).mapInArrow(run, schema)
