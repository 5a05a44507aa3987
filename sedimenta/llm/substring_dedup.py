"""Operator 5: removal of byte strings that an earlier document has, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Equal strings meet in one place
without moving them all: each takes the least hash of its k-grams as its key, neighbours with one key form a run, and a run is sent as its
key with a hash of its bytes, once a pack of documents. Where all runs of a key have the same bytes, the smallest doc_id decides. The rest,
runs that differ and still may share strings, are cut again by the keys of longer k-grams, and these pieces are sent as bytes. The pieces
of a key are joined, with the k-gram that they share as one letter, their suffix array is built by linear grouping (suffix_array.py), and neighbours in it that agree in ``length`` bytes
are one string, whose smallest doc_id decides.

Documents travel in packs, written once; answers come back to them by pack. A pack, a bucket of runs and a block of pieces have bounded
sizes, and a string that is in very many documents counts once a pack.

Cases: null and empty texts have zero bytes, nothing removed and the hash of no bytes; texts under ``length`` bytes keep all; a null doc_id counts
as smaller than any other; rows of an equal doc_id never remove from each other; an empty table gives no rows; other columns pass
through only if named.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm import scratch
from sedimenta.llm.suffix_array import suffix_array

LENGTH = 50
SHORT, LONG = 16, 40
PACK_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
BLOCK_BYTES = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(0x100000001B3, n, 1 << 64))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k-gram."""
    done, width, power = None, 0, data.astype(np.uint64) + np.uint64(1)
    size, rest = 1, k
    while True:  # k in binary: done covers the low bits so far
        if rest & 1:
            done = power[: len(data) - size + 1] if done is None else (n := len(data) - width - size + 1) and done[:n] * _pow(size) + power[width : width + n]
            width += size
        rest >>= 1
        if not rest:
            break
        power = power[:-size] * _pow(size) + power[size:]
        size *= 2
    done = done * _ODD
    done ^= done >> np.uint64(29)
    done *= np.uint64(0xBF58476D1CE4E5B9)
    done ^= done >> np.uint64(32)
    return done


def runs(data: np.ndarray, ends: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last, text number): maximal runs of neighbouring window starts with one key, within texts that lie end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    least, width = _gram_hashes(data, k), 1
    span = length - k + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    whole = np.ones(len(least) + length, np.int8)
    sizes = np.diff(ends, prepend=0)
    for e, n in zip(ends.tolist(), sizes.tolist()):
        whole[e - min(n, length - 1) : e] = 0
    at = np.flatnonzero(whole[: len(least)])
    if not len(at):
        return none.astype(np.uint64), none, none, none
    key = least[at]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1)]))
    first, last = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    return key[new], first, last, np.searchsorted(ends, first, side="right")


class Pack:
    """The documents of a pack, their runs, and which of these stand for others of the pack."""

    def __init__(self, data: bytes, ends: np.ndarray, ids: np.ndarray, length: int):
        from xxhash import xxh3_64_intdigest

        self.bytes, self.data, self.ids, self.length = data, np.frombuffer(data, np.uint8), ids, length
        self.key, self.first, self.last, self.doc = runs(self.data, ends, SHORT, length)
        view = memoryview(data)
        self.content = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(self.first.tolist(), (self.last + length).tolist())), np.uint64, len(self.first))
        self.stands, self.group = _representatives(self.key, self.content, ids[self.doc])

    def settle(self, verdicts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a verdict for each that stands for others: which runs are removed whole, and which are open."""
        own = self.ids[self.doc] > self.ids[self.doc[self.stands]][self.group]
        verdict = verdicts[self.group]
        removed = own | (verdict == 1)
        return np.flatnonzero(removed), np.flatnonzero(~removed & (verdict == 2))

    def pieces(self, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, start, end, doc) of the open runs' bytes, cut by the keys of longer k-grams; start and end bound the bytes in the pack."""
        a, b = self.first[opened], self.last[opened] + self.length
        ends = np.cumsum(b - a)
        joined = np.concatenate([self.data[x:y] for x, y in zip(a, b)]) if len(a) else self.data[:0]
        key, first, last, n = runs(joined, ends, LONG, self.length)
        shift = (a - (ends - (b - a)))[n] if len(n) else n
        return key, first + shift, last + shift + self.length, self.doc[opened][n] if len(n) else n


def _representatives(key: np.ndarray, content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (key, content) one with the least id, in order of position; and for each the number of the one that stands for it."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((ids, content, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])])
    heads = order[new]
    by_place = np.argsort(heads)
    rank = np.empty(len(heads), np.int64)
    rank[by_place] = np.arange(len(heads))
    group = np.empty(len(key), np.int64)
    group[order] = rank[np.cumsum(new) - 1]
    return heads[by_place], group


def _piece_representatives(pack: Pack, cut: tuple) -> tuple[np.ndarray, np.ndarray]:
    key, start, end, doc = cut
    number: dict[bytes, int] = {}
    content = np.fromiter((number.setdefault(pack.bytes[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    return _representatives(key, content, pack.ids[doc])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key * _ODD >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _expand(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def judge_runs(key: np.ndarray, content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A verdict for each run of a bucket: 1 a smaller id has the same bytes, 2 open, 0 neither."""
    if not len(key):
        return np.zeros(0, np.uint8)
    order = np.lexsort((ids, content, key))
    k, c, d = key[order], content[order], ids[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    least = d[new][np.cumsum(new) - 1]
    at_key = np.cumsum(new_key) - 1
    key_starts = np.flatnonzero(new_key)
    mixed = (np.add.reduceat(new.astype(np.int64), key_starts) > 1) & (np.minimum.reduceat(least, key_starts) < np.maximum.reduceat(least, key_starts))
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(d > least, 1, np.where(mixed[at_key], 2, 0))
    return out


def judge_pieces(pieces: list[bytes], ids: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each piece 1 if a smaller id has all of its windows, 0 if none, or 2; and for the latter, in order, which windows.

    Windows can only be equal within a key. Every window of a piece holds the k-gram of its key. Where a piece has it once, the k-gram is one
    letter of the text that is sorted, so that a window is that letter with what surrounds it; pieces that repeat it are sorted in full.
    """
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(piece, len(number)) for piece in pieces), np.int64, len(pieces))
    distinct = list(number)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, own, ids)
    key = np.empty(len(distinct), np.uint64)
    key[own] = keys
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    low, high = np.minimum.reduceat(least[order], new), np.maximum.reduceat(least[order], new)
    mixed = np.repeat(low < high, np.diff(np.append(new, len(order))))
    hard = order[mixed]
    rows = [(k, distinct[i], d) for i, k, d in zip(hard.tolist(), key[hard].tolist(), least[hard].tolist())]
    known: dict[bytes, np.ndarray] = {}  # the least id of each window
    for a, b in _blocks(rows):
        _least_of_block(rows[a:b], length, known)
    codes = (ids > least[own]).astype(np.uint8)
    is_hard = np.zeros(len(distinct), bool)
    is_hard[hard] = True
    asked = np.flatnonzero(is_hard[own] & (codes == 0))
    codes[asked] = 2
    return codes, [known[pieces[i]] < d for i, d in zip(asked.tolist(), ids[asked].tolist())]


def _blocks(rows: list[tuple[int, bytes, int]]):
    """Bounds of parts of about BLOCK_BYTES that don't cut a key's rows."""
    a = size = 0
    for i, (k, piece, _) in enumerate(rows):
        if size >= BLOCK_BYTES and k != rows[i - 1][0]:
            yield a, i
            a, size = i, 0
        size += len(piece)
    if a < len(rows):
        yield a, len(rows)


def _least_of_block(block: list[tuple[int, bytes, int]], length: int, known: dict) -> None:
    """Fills known with the least id of each window of the block's pieces; all pieces of a key are in one block."""
    data = np.frombuffer(b"".join(piece for _, piece, _ in block), np.uint8)
    hashes, at = _gram_hashes(data, LONG), 0
    places = []
    for k, piece, _ in block:
        n = len(piece) - LONG + 1
        found = np.flatnonzero(hashes[at : at + n] == np.uint64(k))
        places.append(int(found[0]) if len(found) == 1 else -1)
        at += len(piece)
    repeats = {k for (k, _, _), place in zip(block, places) if place < 0}
    short, full = [], []
    for (k, piece, d), place in zip(block, places):
        if k in repeats:
            full.append((k, piece, d, piece, k))
        else:
            short.append((k, piece, d, piece[:place] + b"\xff" + piece[place + LONG :], (k, piece[place : place + LONG])))
    for rows, width in ((short, length - LONG + 1), (full, length)):
        if rows:
            _least_by_suffix_array(rows, length, width, known)


def _least_by_suffix_array(rows: list[tuple], length: int, width: int, known: dict) -> None:
    """rows: (key, piece, id, its text, the group in which its windows may be equal); a window is width letters of the text."""
    text = b"".join(r[3] for r in rows)
    owner, starts, at = [-1] * len(text), [], 0
    least = []
    for i, (_, piece, d, own, _) in enumerate(rows):
        n = len(piece) - length + 1
        owner[at : at + n] = [i] * n
        starts.append(at)
        least.append(np.full(n, d, np.int64))
        at += len(own)
    same: list[int] = []
    before = b""

    def close():
        if len(same) > 1:
            groups = defaultdict(list)
            for s in same:
                groups[rows[owner[s]][4]].append(s)
            for group in groups.values():
                d = min(rows[owner[s]][2] for s in group)
                for s in group:
                    least[owner[s]][s - starts[owner[s]]] = d

    for s in suffix_array(text):
        if owner[s] >= 0:
            window = text[s : s + width]
            if window != before:
                close()
                same, before = [], window
            same.append(s)
    close()
    for (_, piece, *_), low in zip(rows, least):
        known[piece] = low


def _packs(docs: DataFrame, keep: list[str], pack_bytes: int) -> DataFrame:
    """(pack_id, n_bytes, body, ends, rest): documents end to end, their ends, and doc_id with the kept columns as an Arrow stream."""

    def run(batches):
        from pyspark import TaskContext

        task, number, tables, total = TaskContext.get().partitionId(), 0, [], 0

        def close():
            table = pa.Table.from_batches(tables)
            texts = [t or b"" for t in table.column("text").to_pylist()]
            sink = pa.BufferOutputStream()
            rest = table.drop_columns(["text"]).combine_chunks()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rest)
            body = b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([_squeeze(np.frombuffer(body, np.uint8))], pa.binary()), pa.array([np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["pack_id", "n_bytes", "body", "ends", "rest"],
            )

        for batch in batches:
            sizes = np.cumsum([len(t.as_buffer() or b"") for t in batch.column("text")])
            a = 0
            while a < batch.num_rows:
                done = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, done + pack_bytes - total, side="right")))
                tables.append(batch.slice(a, b - a))
                total += int(sizes[min(b, batch.num_rows) - 1] - done)
                a = b
                if total >= pack_bytes or a < batch.num_rows:
                    yield close()
                    number, tables, total = number + 1, [], 0
        if tables:
            yield close()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[c for c in keep if c != "doc_id"], F.col("text").cast("binary").alias("text")]
    return docs.select(*columns).mapInArrow(run, "pack_id long, n_bytes long, body binary, ends binary, rest binary")


def _open(body: bytes, ends: bytes, rest: bytes, length: int) -> tuple[Pack, np.ndarray, pa.Table]:
    table = pa.ipc.open_stream(rest).read_all()
    ids = np.array([-(2**63) if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    at = np.frombuffer(ends, "<i8")
    return Pack(_expand(body), at, ids, length), at, table


def _sent(pack_id: int, where: np.ndarray, blob_of) -> list[tuple]:
    """(pack_id, bucket, blob) for each bucket; blob_of gets the numbers that go there, in order."""
    order = np.argsort(where, kind="stable")
    buckets, cut = np.unique(where[order], return_index=True)
    return [(pack_id, int(b), blob_of(part)) for b, part in zip(buckets, np.split(order, cut[1:]))]


def _answers(where: np.ndarray, answers, dtype=np.uint8) -> list[tuple[np.ndarray, np.ndarray]]:
    """The numbers that went to each bucket with what came back."""
    back = {} if answers is None else {x["bucket"]: x["blob"] for x in answers}
    order = np.argsort(where, kind="stable")
    buckets, cut = np.unique(where[order], return_index=True)
    return [(part, np.frombuffer(_expand(back[int(b)]), dtype)) for b, part in zip(buckets, np.split(order, cut[1:]))] if len(where) else []


def _verdicts(pack: Pack, buckets: int, answers) -> np.ndarray:
    out = np.zeros(len(pack.stands), np.uint8)
    for part, codes in _answers(_bucket(pack.key[pack.stands], buckets), answers):
        out[part] = codes
    return out


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts of these sizes laid end to end: the part of each place, and its place within it."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    return part, np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _removed_pieces(pack: Pack, opened: np.ndarray, answers, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that go by the answers for pieces."""
    cut = pack.pieces(opened)
    stands, group = _piece_representatives(pack, cut)
    codes = np.zeros(len(stands), np.uint8)
    windows = (cut[2] - cut[1])[stands] - length + 1
    begins = np.cumsum(windows) - windows
    flags = np.zeros(int(windows.sum()), bool)
    for part, raw in _answers(_bucket(cut[0][stands], buckets), answers):
        codes[part] = raw[: len(part)]
        asked = part[codes[part] == 2]
        which, within = _spread(windows[asked])
        flags[begins[asked][which] + within] = raw[len(part) :] != 0
    ids = pack.ids[cut[3]]
    whole = (ids > ids[stands][group]) | (codes[group] == 1)
    open_ = np.flatnonzero(~whole & (codes[group] == 2))
    which, within = _spread(windows[group[open_]])
    gone = flags[begins[group[open_]][which] + within]
    at = cut[1][open_][which[gone]] + within[gone]
    return np.concatenate([cut[1][whole], at]), np.concatenate([cut[2][whole], at + length])


_SENT = "pack_id long, bucket int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["pack_id", "bucket", "blob"])


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False, length: int = LENGTH, pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text), then the columns of keep and, with_text, the text kept, without
    characters that are cut.

    length may be LONG to any size. bucket_bytes bounds what a task takes from all packs, in bytes of documents.
    """
    if length < LONG:
        raise ValueError(f"length must be {LONG} at least")
    keep = list(keep or [])
    spark = docs.sparkSession
    packs = scratch.save(_packs(docs, keep, pack_bytes), "repeats-packs", "none")
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))

    def send_runs(batches):
        for batch in batches:
            for pack_id, body, ends, rest in zip(*[batch.column(c).to_pylist() for c in ("pack_id", "body", "ends", "rest")]):
                pack, _, _ = _open(body, ends, rest, length)
                key, content, ids = pack.key[pack.stands], pack.content[pack.stands], pack.ids[pack.doc[pack.stands]]
                mixed = key * _ODD
                low = mixed.view(np.uint8).reshape(-1, 8)[:, :5]  # with the bucket, which is of higher bits
                blob = lambda part: len(part).to_bytes(4, "little") + low[part].tobytes() + content[part].tobytes() + _squeeze(np.diff(ids[part], prepend=0))
                if len(key):
                    yield _rows(_sent(pack_id, _bucket(key, buckets), blob))

    def answer_runs(table: pa.Table) -> pa.Table:
        packs_, blobs = table.column("pack_id").to_pylist(), table.column("blob").to_pylist()
        sizes, key, content, ids = [], [], [], []
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 4).reshape(n, 5)
            sizes.append(n)
            key.append(wide.view(np.uint64).reshape(-1))
            content.append(np.frombuffer(blob[4 + 5 * n : 4 + 13 * n], np.uint64))
            ids.append(np.cumsum(np.frombuffer(_expand(blob[4 + 13 * n :]), np.int64)))
        codes = judge_runs(np.concatenate(key), np.concatenate(content), np.concatenate(ids))
        parts = np.split(codes, np.cumsum(sizes)[:-1])
        return pa.Table.from_batches([_rows([(p, b, _squeeze(c)) for p, b, c in zip(packs_, table.column("bucket").to_pylist(), parts)])])

    def send_pieces(batches):
        for batch in batches:
            for pack_id, body, ends, rest, answers in zip(*[batch.column(c).to_pylist() for c in ("pack_id", "body", "ends", "rest", "runs")]):
                if answers is None:
                    continue
                pack, _, _ = _open(body, ends, rest, length)
                _, opened = pack.settle(_verdicts(pack, buckets, answers))
                cut = pack.pieces(opened)
                stands, _ = _piece_representatives(pack, cut)
                key, start, end, ids = cut[0][stands], cut[1][stands], cut[2][stands], pack.ids[cut[3][stands]] if len(stands) else np.zeros(0, np.int64)
                blob = lambda part: _squeeze(np.array([len(part)], "<i8"), key[part], (end - start)[part].astype("<i8"), ids[part], np.frombuffer(b"".join([pack.bytes[start[i] : end[i]] for i in part]), np.uint8))
                if len(key):
                    yield _rows(_sent(pack_id, _bucket(key, buckets), blob))

    def answer_pieces(table: pa.Table) -> pa.Table:
        rows, pieces, keys, ids = [], [], [], []
        for p, b, blob in zip(*[table.column(c).to_pylist() for c in ("pack_id", "bucket", "blob")]):
            raw = _expand(blob)
            n = int.from_bytes(raw[:8], "little")
            key, size, own = (np.frombuffer(raw, t, n, 8 + 8 * n * i) for i, t in enumerate((np.uint64, np.int64, np.int64)))
            at = 8 + 24 * n
            for s in size.tolist():
                pieces.append(raw[at : at + s])
                at += s
            keys.append(key)
            ids.append(own)
            rows.append((p, b, n))
        codes, flags = judge_pieces(pieces, np.concatenate(ids), np.concatenate(keys), length)
        out, at, asked = [], 0, 0
        for p, b, n in rows:
            part = codes[at : at + n]
            more = int((part == 2).sum())
            out.append((p, b, _squeeze(part, *flags[asked : asked + more])))
            at, asked = at + n, asked + more
        return pa.Table.from_batches([_rows(out)])

    def finish(batches):
        for batch in batches:
            for body, ends, rest, by_run, by_piece in zip(*[batch.column(c).to_pylist() for c in ("body", "ends", "rest", "runs", "pieces")]):
                pack, at, table = _open(body, ends, rest, length)
                edge = np.zeros(len(pack.data) + 1, np.int32)
                whole, opened = pack.settle(_verdicts(pack, buckets, by_run)) if by_run is not None else (np.zeros(0, np.int64),) * 2
                np.add.at(edge, pack.first[whole], 1)
                np.add.at(edge, pack.last[whole] + length, -1)
                if by_piece is not None:
                    first, last = _removed_pieces(pack, opened, by_piece, buckets, length)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last, -1)
                gone = np.cumsum(edge)[:-1] > 0
                n_removed, n_spans, sha, texts = [], [], [], []
                for a, b in zip(np.concatenate([[0], at[:-1]]).tolist(), at.tolist()):
                    own = gone[a:b]
                    left = pack.data[a:b][~own].tobytes() if own.any() else pack.bytes[a:b]
                    n_removed.append(b - a - len(left))
                    n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode("utf-8", "ignore") if with_text else None)
                columns = [table.column("doc_id").combine_chunks(), pa.array(np.diff(at, prepend=0), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)]
                columns += [table.column(c).combine_chunks() for c in keep] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *keep, *["kept"] * with_text])

    def by_pack(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("pack_id").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))  # an answer a bucket

    answered = scratch.save(packs.mapInArrow(send_runs, _SENT).groupBy("bucket").applyInArrow(answer_runs, _SENT), "repeats-runs", "none")
    with_runs = packs.join(by_pack(answered, "runs"), "pack_id", "left")
    pieces = scratch.save(with_runs.mapInArrow(send_pieces, _SENT).groupBy("bucket").applyInArrow(answer_pieces, _SENT), "repeats-pieces", "none")
    fields = [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))]
    schema = T.StructType(fields + [docs.schema[c] for c in keep] + [T.StructField("kept", T.StringType())] * with_text)
    return with_runs.join(by_pack(pieces, "pieces"), "pack_id", "left").mapInArrow(finish, schema)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 50 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
