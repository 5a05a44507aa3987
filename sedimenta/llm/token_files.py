"""Operator 1: token ids of documents as flat unsigned integer files with 64-bit offsets.

A set of files is a folder with, for each shard, ``tokens-NNNNNN.bin`` (ids, little-endian unsigned, 16 bits wide if the vocabulary
fits and 32 otherwise), ``offsets-NNNNNN.bin`` (n_docs + 1 little-endian unsigned 64-bit offsets, in ids of the whole set) and
``docs-NNNNNN.bin`` (little-endian signed 64-bit document ids), and ``manifest.json`` with the width and each shard's documents and ids.
Documents stand in ascending doc_id order over all shards; the offset of a shard's first id is the prefix sum of the shards before it.

Cases: a null or empty text is a document of the end id alone; null doc_ids come first and are kept as -2**63, read back as null;
rows of an equal doc_id are all kept, ordered by a hash of their text, and spread over as many shards as their share of the rows is of all; the
strings of a vocabulary's special tokens are coded as the library codes them, as these tokens, unless they are asked for as text; an empty table gives a manifest of empty shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import scratch

NULL_ID = -(2**63)
#: Pre-tokens of the byte-level vocabulary, white space spelt as the Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts with a character from here on go to the library whole: letter classes below are the same in all Unicode versions in use.
PLAIN_BELOW = "Ԁ"
#: Distinct parts that a worker remembers; beyond it begins anew.
MEMORY = 900_000
#: Documents that are encoded at a time.
SLICE = 1_000
#: Shards at most; beyond it they grow.
SHARDS = 10_000


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if "://" not in uri else pafs.FileSystem.from_uri(uri)


#: White space that doesn't stand alone, or is neither a space nor a line break.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")


def _byte_letters() -> dict[int, str]:
    """The letter that the byte-level vocabulary spells each byte with: visible Latin-1 characters themselves, the others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes texts with a tokenizers file.

    Byte-level BPE codes pre-tokens one by one, and a single space or line break between other characters always begins one. So plain texts
    are cut there, and the ids of each part, which the library has coded once, are remembered.
    """

    def __init__(self, path: str, end_id: int, dtype: str, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        kind = json.loads(self.tokenizer.to_str())
        byte_level = kind["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not kind["normalizer"]
        self.split = regex.compile(PRETOKEN).findall if byte_level else None
        added = "".join("|" + re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.foreign = re.compile(f"[{PLAIN_BELOW}-\U0010ffff]{added}").search
        self.model = self.tokenizer.model
        self.letter_of = _byte_letters()
        self.code = "H" if dtype == "<u2" else "I"
        self.dtype, self.end = dtype, np.array([end_id], dtype).tobytes()
        self.line = self.whole("\n")
        #: ids of parts after a space, and of parts at the start of a line
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def plain(self, text: str) -> bool:
        """Whether text may be cut at spaces and line breaks: each stands alone between other characters."""
        odd = text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNEVEN) or self.foreign(text)
        return not odd

    def word(self, pretoken: str) -> bytes:
        """The ids of one pre-token, by the library's model."""
        tokens = self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letter_of))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a part; what it shares with others, such as a mark after a word, is remembered on its own."""
        if part.isalpha() or part[:1] == " " and part[1:].isalpha():  # letters are one pre-token
            return self.word(part)
        out = []
        for w in self.split(part):
            memory, key = (self.inner, w[1:]) if w[0] == " " else (self.first, w)
            if (ids := memory.get(key)) is None:
                ids = memory[key] = self.word(w)
            out.append(ids)
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, as bytes."""
        if len(self.inner) + len(self.first) > MEMORY:
            self.inner, self.first = {}, {}
        lines = [[line.split(" ") for line in t.split("\n")] if t and self.split and self.plain(t) else None for t in texts]
        heads = [[line[0] for line in cut or ()] for cut in lines]
        inner, first = set(), set()
        for text in lines:
            for line in text or ():
                first.add(line.pop(0))
                inner.update(line)
        rest, begin = self.inner, self.first
        for w in inner.difference(rest):
            rest[w] = self.part(" " + w)
        for w in first.difference(begin):
            begin[w] = self.part(w)
        out = []
        ids_of = rest.__getitem__
        for text, cut, head in zip(texts, lines, heads):
            if cut is None:
                out.append((self.whole(text) if text else b"") + self.end)
            else:
                out.append(self.line.join([begin[h] + b"".join(map(ids_of, line)) for h, line in zip(head, cut)]) + self.end)
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257, docs_per_shard: int = 50_000, special_as_text: bool = False) -> dict:
    """Writes the files of docs (doc_id, text) to folder and returns the manifest.

    Shards are doc_id ranges of about docs_per_shard rows, at least as many as there are shuffle partitions and SHARDS at most. A doc_id that
    is several of the quantiles between them has that many shards, by its texts' hashes. Texts are encoded where they
    are read; only ids are shuffled. A task writes under a name of its own and then renames, so that a retried task leaves whole files.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 2**16 else "<u4"
    n_rows = docs.select("doc_id").count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(SHARDS, -(-n_rows // docs_per_shard)))
    steps = [i / n for i in range(1, n)]
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    found = docs.select(F.percentile_approx(own_id, steps, max(10_000, 100 * n)).alias("q")).first().q if steps else []
    bounds = np.array(sorted(found or []), np.int64)
    store, path = open_store(folder)
    store.create_dir(path)

    def encode(batches):
        encoder = Encoder(tokenizer, end_id, dtype, special_as_text)
        gc.disable()  # nothing here is cyclic, and the remembered parts would be walked again and again
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ids, of_text = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
            shard = low + (of_text * np.maximum(high - low, 1) >> 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), batch.column(0), batch.column(2), pa.array(encoder.encode_all(batch.column(1).to_pylist()), pa.binary())],
                names=["shard", "doc_id", "of_text", "ids"],
            )
        gc.enable()

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, out, sizes, ids = task.partitionId(), None, array("Q"), []
        names = [f"{path}/{kind}-{shard:06d}.bin" for kind in ("tokens", "lengths", "docs")]
        own = [f"{name}.{task.taskAttemptId()}" for name in names]
        store, _ = open_store(folder)
        for batch in batches:
            out = out or store.open_output_stream(own[0])
            for blob in batch.column(3):
                out.write(blob.as_buffer())
                sizes.append(len(blob.as_buffer()) // int(dtype[2]))
            ids.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sizes:
            out.close()
            for name, values in zip(own[1:], (np.array(sizes, "<u8"), np.concatenate(ids).astype("<i8"))):
                with store.open_output_stream(name) as f:
                    f.write(values.tobytes())
            for a, b in zip(own, names):
                store.move(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    of_text = F.shiftrightunsigned(F.xxhash64("text"), 32)
    coded = docs.select(own_id.alias("doc_id"), "text", of_text.alias("of_text")).mapInArrow(encode, "shard int, doc_id long, of_text long, ids binary")
    dealt = coded.repartitionById(n, F.col("shard")).sortWithinPartitions("doc_id", "of_text", "ids")
    shards = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard int, n_docs long, n_tokens long").collect())  # a row a shard
    bases = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).tolist()
    live = [[s[0], s[1], s[2], base] for s, base in zip(shards, bases) if s[1]]

    def offsets(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, _, _, base = live[k]
                with store.open_input_file(f"{path}/lengths-{shard:06d}.bin") as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                with store.open_output_stream(f"{path}/offsets-{shard:06d}.bin") as f:
                    f.write((np.concatenate([[0], np.cumsum(lengths)]) + base).astype("<u8").tobytes())
            yield batch

    if live:
        spark.range(0, len(live), 1, len(live)).mapInArrow(offsets, "id long").count()
    manifest = {"dtype": dtype, "end_id": end_id, "shards": live}
    with store.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def map_file(store: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped in a local or mounted folder, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, folder: str, docs_per_batch: int = 2_000) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of a folder of files, from the files alone."""
    store, path = open_store(folder)
    with store.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    live, dtype = manifest["shards"], manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not live:
        return spark.createDataFrame([], schema)

    def read(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, _, _, base = live[k]
                tokens, offsets, ids = (map_file(store, f"{path}/{kind}-{shard:06d}.bin", t) for kind, t in (("tokens", dtype), ("offsets", "<u8"), ("docs", "<i8")))
                for i in range(0, len(ids), docs_per_batch):
                    at = offsets[i : i + docs_per_batch + 1].astype(np.int64)
                    crc = [zlib.crc32(tokens[a - base : b - base].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    part = np.asarray(ids[i : i + docs_per_batch])
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64(), mask=part == NULL_ID), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(live), 1, len(live)).mapInArrow(read, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files of byte_bpe_50k."""
    import public_tokenizers

    folder = scratch.folder(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder)
