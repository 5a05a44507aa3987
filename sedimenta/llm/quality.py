"""Operator 3: quality rules and an isolation forest on their statistics.

A document's rule statistics are computed from its whole text. The forest is grown on a bounded sample of labelled rows of good quality that pass the base rules:
each tree splits a small subsample at random values of random statistics. A document's mean path length over the trees says how
ordinary it is; those with shorter paths than the threshold are anomalous. The threshold is the path length below which a stated share
of the good sample falls, lowered half-way to the longest path of labelled junk below it; without labels nothing is judged anomalous.

Cases: null and empty texts have statistics zero and fail the base rule of 20 words; null labels aren't learned from; rows of an equal doc_id
each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import scratch

#: Labelled rows to learn from, at most: the first by a hash of their doc_id.
SAMPLE = 20_000
TREES, SUBSAMPLE, SEED = 100, 256, 7
#: The share of good labelled rows that the threshold may reject.
MAY_REJECT = 0.002
SYMBOLS = b"#*$%&|<>"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
_NO_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_NO_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def statistics(text: bytes | None, window: int = 8) -> list[int]:
    """The values of COLUMNS for a text in UTF-8."""
    text = text or b""
    words = text.split()  # bytes: at \x20\x09-\x0D only
    n = len(words)
    seen, dup_lines, lines = set(), 0, text.split(b"\n")
    for line in lines:
        if line in seen:
            dup_lines += bool(line.strip())
        else:
            seen.add(line)
    repeated, distinct = 0, set(words)
    if n > window and len(distinct) < n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        key, width = ids, 1
        while width < window:  # ranks of pairs of ranks: equal if and only if the words are
            pair = key[: len(key) - width] * (len(key) + len(number) + 1) + key[width:]
            key = np.unique(pair, return_inverse=True)[1].reshape(-1)
            width *= 2
        twice = np.bincount(key)[key] > 1
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return [n, sum(map(len, words)) - sum(map(len, words_of(text))), len(text.translate(None, _NO_SYMBOL)), dup_lines, repeated,
            len(text.translate(None, _NO_UPPER)), len(lines)]


def words_of(text: bytes) -> list[bytes]:
    """The continuation bytes, which are no code points of their own; all are within words."""
    return [bytes(re.sub(rb"[^\x80-\xbf]+", b"", text))] if not text.isascii() else []


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the COLUMNS) for each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            values = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COLUMNS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(values[:, i]) for i in range(len(COLUMNS))]], names=["doc_id", *COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios in which size cancels, by rows of COLUMNS; path lengths over them isolate what is odd, not what is long."""
    n, chars, symbols, dup, _, upper, lines = stats.astype(float).T
    size, words = np.maximum(chars, 1), np.maximum(n, 1)
    return np.column_stack([np.sqrt(symbols / size), np.sqrt(symbols / words), upper / size, chars / words, dup / np.maximum(lines, 1)])


def grow(x: np.ndarray, span: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> list[tuple]:
    """Trees as arrays: split column (-1 at a leaf), split value, left child (right is one more), path length at a leaf.

    span is the range of each column over all labelled rows. A node's split value is drawn from beyond the range of its rows too, by a part of
    span: what lies outside of all that a tree has seen is cut off early, also in a column that is constant in its rows. A side without rows is
    a leaf at the depth where it was cut off.
    """
    rng, forest = np.random.default_rng(seed), []
    mean_path = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
    wide = np.flatnonzero(span > 0)
    limit = int(np.ceil(np.log2(max(2, min(subsample, len(x))))))
    for _ in range(trees):
        rows = x[rng.choice(len(x), min(subsample, len(x)), replace=False)]
        column, value, left, path = [], [], [], []
        todo = [(rows, 0)]
        while todo:
            own, depth = todo.pop(0)
            if depth >= limit or len(own) <= 1 or not len(wide):
                column.append(-1), value.append(0.0), left.append(-1), path.append(depth + mean_path(len(own)))
                continue
            low, high = own.min(axis=0), own.max(axis=0)
            c = int(rng.choice(wide))
            margin = 0.5 * span[c]
            v = float(rng.uniform(low[c] - margin, high[c] + margin))
            column.append(c), value.append(v), left.append(len(column) + len(todo)), path.append(0.0)
            below = own[:, c] < v
            todo += [(own[below], depth + 1), (own[~below], depth + 1)]
        forest.append((np.array(column), np.array(value), np.array(left), np.array(path)))
    return forest


def path_lengths(x: np.ndarray, forest: list[tuple]) -> np.ndarray:
    """The mean path length of each row."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for column, value, left, path in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := column[at] >= 0).any():
            c = np.maximum(column[at], 0)
            at = np.where(inner, left[at] + (x[rows, c] >= value[at]), at)
        total += path[at]
    return total / max(1, len(forest))


def base_failed():
    """The base rules, which come before the forest."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def train(stats: DataFrame, labels: DataFrame) -> tuple[list[tuple], float]:
    """The forest and its threshold: paths shorter than it are anomalous."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = stats.where(~base_failed()).join(F.broadcast(known), "doc_id").toArrow()  # at most SAMPLE labels
    quality = rows.column("quality").to_numpy() if rows.num_rows else np.zeros(0)
    x = features(np.column_stack([rows.column(c).to_numpy() for c in COLUMNS])) if rows.num_rows else np.zeros((0, 5))
    good = x[quality == 1]
    if len(good) < 2:
        return [], -1.0
    forest = grow(good, x.max(axis=0) - x.min(axis=0))
    paths, junk = np.sort(path_lengths(good, forest)), path_lengths(x[quality == 0], forest)
    at_most = float(paths[int(MAY_REJECT * len(paths))])
    # lowered half-way to the longest path of the junk below it, which loses none of that
    caught = junk[junk < at_most]
    return forest, (at_most + float(caught.max())) / 2 if len(caught) else -1.0


def judge(stats: DataFrame, model: tuple[list[tuple], float]) -> DataFrame:
    """stats with base_failed, path_length and kept."""
    forest, threshold = model

    def run(batches):
        for batch in batches:
            x = features(np.column_stack([batch.column(1 + i).to_numpy() for i in range(len(COLUMNS))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path_lengths(x, forest))], names=[*batch.schema.names, "path_length"])

    out = stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", path_length double")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("path_length") >= threshold) if forest else F.lit(True)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the threshold is from the labels table."""
    stats = scratch.save(rule_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-statistics")
    judged = judge(stats, train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "path_length")
