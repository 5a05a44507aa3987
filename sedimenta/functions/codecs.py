"""Byte codecs: general compression, variable integers, bit strings, motif substitution and deltas against a base."""

from __future__ import annotations

import zlib
from collections import Counter

from sedimenta.functions.constants import CODEC_STORE, CODEC_ZLIB, CODEC_ZSTD, MIN_GAIN, MOTIF_LENGTH, MOTIF_MAX


def compress(data: bytes, codec: int = CODEC_ZLIB, level: int = 3) -> bytes:
    if not data or codec == CODEC_STORE:
        return data
    if codec == CODEC_ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    return zlib.compress(data, max(1, min(9, level)))


def decompress(data: bytes, codec: int, raw_len: int) -> bytes:
    if codec == CODEC_STORE or not raw_len:
        out = data
    elif codec == CODEC_ZSTD:
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw_len)
    elif codec == CODEC_ZLIB:
        out = zlib.decompress(data)
    else:
        raise ValueError(f"unknown codec {codec}")
    if len(out) != raw_len:
        raise ValueError(f"{len(out)} bytes instead of {raw_len}")
    return out


def best_codec(data: bytes, level: int = 3, codec: int = CODEC_ZLIB, min_gain: float = MIN_GAIN) -> tuple[int, bytes]:
    """(codec, bytes): stored as it is if compression gains less than min_gain."""
    if not data:
        return CODEC_STORE, b""
    small = compress(data, codec, level)
    return (codec, small) if 1 - len(small) / len(data) >= min_gain else (CODEC_STORE, data)


def put_uvarint(n: int) -> bytes:
    """Seven bits a byte, the low ones first; the top bit says that more follow."""
    if n < 0:
        raise ValueError("negative")
    digits = [n >> s & 127 for s in range(0, max(n.bit_length(), 1), 7)]
    return bytes([d | 128 for d in digits[:-1]] + digits[-1:])


def get_uvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place)."""
    for end in range(at, min(len(data), at + 9)):
        if data[end] < 128:
            return sum((b & 127) << 7 * k for k, b in enumerate(data[at : end + 1])), end + 1
    raise ValueError("truncated or oversized integer")


def pack_bits(fields: list[tuple[int, int]]) -> bytes:
    """Fields (value, width) from the most significant bit on, filled up with zeros to a whole byte."""
    text = "".join(f"{v:0{w}b}"[-w:] for v, w in fields if w)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def unpack_bits(data: bytes, widths: list[int]) -> list[int]:
    if sum(widths) > 8 * len(data):
        raise ValueError("not enough bits")
    text, out = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else "", []
    for w in widths:
        out.append(int(text[:w] or "0", 2))
        text = text[w:]
    return out


def top_motifs(sample: bytes, most: int = MOTIF_MAX) -> list[tuple[bytes, int, int]]:
    """(motif, count, first place) of windows at every fourth byte that come twice or more, the most frequent first, then the earliest."""
    places = range(0, len(sample) - MOTIF_LENGTH + 1, 4)
    found = [sample[i : i + MOTIF_LENGTH] for i in places]
    first: dict[bytes, int] = {}
    for i, w in zip(places, found):
        first.setdefault(w, i)
    repeated = [(w, n, first[w]) for w, n in Counter(found).items() if n > 1]
    return sorted(repeated, key=lambda r: (-r[1], r[2]))[:most]


def motif_encode(data: bytes, motifs: list[bytes]) -> bytes:
    """Tokens: 0, length, bytes for what is no motif and 1, number for a motif; the first match from the left wins."""
    number = {m: k for k, m in reversed(list(enumerate(motifs)))}
    out, literal_from, i = [], 0, 0

    def literal(end):
        if end > literal_from:
            out.append(b"\0" + put_uvarint(end - literal_from) + data[literal_from:end])

    while i <= len(data) - MOTIF_LENGTH:
        k = number.get(data[i : i + MOTIF_LENGTH])
        if k is None:
            i += 1
            continue
        literal(i)
        out.append(b"\1" + put_uvarint(k))
        i += MOTIF_LENGTH
        literal_from = i
    literal(len(data))
    return b"".join(out)


def motif_decode(tokens: bytes, motifs: list[bytes], raw_len: int) -> bytes:
    return _decode(tokens, raw_len, lambda at: _motif(tokens, at, motifs))


def _motif(tokens, at, motifs):
    k, at = get_uvarint(tokens, at)
    if k >= len(motifs):
        raise ValueError("no such motif")
    return motifs[k], at


def delta_encode(data: bytes, base: bytes, width: int = 32, stride: int = 8, tries: int = 8, reach: int = 262_144, enough: int = 4096) -> bytes:
    """Operations against a base: 0, length, bytes to add and 1, offset, length to copy; the longest of the first few matches wins."""
    places: dict[bytes, list[int]] = {}
    for i in range(0, len(base) - width + 1, stride):
        own = places.setdefault(base[i : i + width], [])
        if len(own) < tries:
            own.append(i)
    out, literal_from, i = [], 0, 0

    def literal(end):
        if end > literal_from:
            out.append(b"\0" + put_uvarint(end - literal_from) + data[literal_from:end])

    while i <= len(data) - width:
        best, at = 0, 0
        for p in places.get(data[i : i + width], ()):
            n = _common(data, i, base, p, min(reach, len(data) - i, len(base) - p))
            if n > best:
                best, at = n, p
            if best >= enough:
                break
        if not best:
            i += 1
            continue
        literal(i)
        out.append(b"\1" + put_uvarint(at) + put_uvarint(best))
        i += best
        literal_from = i
    literal(len(data))
    return b"".join(out)


def _common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many bytes agree from a[i] and b[j] on, by halving."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def delta_decode(ops: bytes, base: bytes, raw_len: int) -> bytes:
    def copied(at):
        off, at = get_uvarint(ops, at)
        n, at = get_uvarint(ops, at)
        if off + n > len(base):
            raise ValueError("copy out of range")
        return base[off : off + n], at

    return _decode(ops, raw_len, copied)


def _decode(stream: bytes, raw_len: int, other) -> bytes:
    out, at, size = [], 0, 0
    while at < len(stream):
        op, at = stream[at], at + 1
        if op == 0:
            n, at = get_uvarint(stream, at)
            if at + n > len(stream):
                raise ValueError("truncated literal")
            part, at = stream[at : at + n], at + n
        elif op == 1:
            part, at = other(at)
        else:
            raise ValueError(f"unknown operation {op}")
        out.append(part)
        size += len(part)
        if size > raw_len:
            raise ValueError("too long")
    if size != raw_len:
        raise ValueError(f"{size} bytes instead of {raw_len}")
    return b"".join(out)
