"""Operator 2: toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

n-grams are of characters, lower-cased, hashed to 2**20 places for each length. Learning: on a bounded sample of labelled rows,
count for each place the documents of either class that have it, take the log-count ratio r, keep the places whose shares differ
well beyond chance, and fit a logistic regression on presence times r. Counting and choosing are aggregations; the driver gets the places that
are kept and which of the sample's documents have them, never a text. The intercept is moved from the sample's share of toxic rows to that of
all labelled rows. Scoring: the sum of the kept places present in the whole text, through the logistic function.

Cases: null and empty texts score what no feature scores; a null or unlabelled toxic value is not learned from; a null doc_id is held out;
without a labelled row of both classes every score is the share of toxic rows, or 0 without any; rows of an equal doc_id each get a row; a
very long text is read slice by slice; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm import scratch

LENGTHS = (3, 4, 5)
PLACES = 20
#: Labelled rows to learn from, at most, of each class: the first by a hash of their doc_id.
SAMPLE = {1: 2_000, 0: 4_000}
#: A place is kept if this many sampled documents have it and its log-likelihood ratio statistic against equal shares is at least this.
LEAST_DOCS, LEAST_G = 4, 20.0
#: Characters that are hashed at a time, and texts.
SLICE, TEXTS = 1 << 18, 256


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased code points of texts in UTF-8, end to end, and where each text ends."""
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum([len(t) for t in lowered])


def hits(data: np.ndarray, ends: np.ndarray, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) once for each place that a document has; data: the characters of documents end to end; kept: which places count."""
    most, found = max(LENGTHS), []
    for begin in range(0, len(data), SLICE):
        part = data[begin : begin + SLICE + most - 1]
        code = part
        for n in range(2, most + 1):
            if len(part) < n:
                break
            code = code[:-1] * np.uint32(0x01000193) ^ part[n - 1 :]
            if n in LENGTHS:
                own = code[:SLICE]
                place = ((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACES)) + np.uint32(LENGTHS.index(n) << PLACES)
                at = np.arange(len(place)) if kept is None else np.flatnonzero(kept[place])
                doc = np.searchsorted(ends, begin + at, side="right")
                inside = begin + at + n <= ends[doc]
                found.append(np.unique((doc[inside].astype(np.int64) << 24) | place[at[inside]]))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> 24, both & ((1 << 24) - 1)


def likelihood_ratio(ones: Column, zeros: Column, n_ones: int, n_zeros: int) -> Column:
    """G of a place that so many documents of either class have: how far its share of either is from one common share."""
    share = (ones + zeros) / F.lit(float(n_ones + n_zeros))
    part = lambda k, n, p: F.when(k > 0, k * F.ln(k / F.greatest(n * p, F.lit(1e-12)))).otherwise(0.0)
    return 2 * sum((part(k, F.lit(float(n)), share) + part(F.lit(float(n)) - k, F.lit(float(n)), 1 - share) for k, n in ((zeros, n_zeros), (ones, n_ones))), F.lit(0.0))


def fit(places: np.ndarray, ratio: np.ndarray, doc: np.ndarray, column: np.ndarray, toxic: np.ndarray, share: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of the places, and the intercept; document doc[i] has place column[i]."""
    n = np.array([(toxic == 0).sum(), toxic.sum()], float)
    w, b, y = np.zeros(len(places)), float(np.log(n[1] / n[0])), toxic.astype(float)
    # Adam on the mean log loss with an L2 term; x is presence times r
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(doc, (w * ratio)[column], len(y)) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(column, off[doc], len(places)) * ratio / len(y) + 1e-4 * w
        gb = off.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w * ratio, b + log_odds(share) - float(np.log(n[1] / n[0]))


def log_odds(share: float) -> float:
    return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def learnt_from(column: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the doc_id as text isn't 0 modulo 5; never those without a doc_id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def places_of(sample: DataFrame) -> DataFrame:
    """(toxic, places): the distinct places of each row of sample (toxic, text), as 32-bit integers."""

    def run(batches):
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, place = hits(*characters([text.as_buffer().to_pybytes()]), None)
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array([place.astype("<i4").tobytes()], pa.binary())], names=["toxic", "places"])

    return sample.mapInArrow(run, "toxic int, places binary")


def counted(sample: DataFrame) -> DataFrame:
    """(place, ones, zeros): how many rows of sample (toxic, places) of either class have a place."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            place = [np.frombuffer(b, "<i4") for b in batch.column(1).to_pylist()]
            own = np.repeat(toxic, [len(p) for p in place])
            key, n = np.unique((np.concatenate(place).astype(np.int64) << 1) | own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 1).astype(np.int32)), pa.array((key & 1) * n), pa.array((1 - (key & 1)) * n)], names=["place", "ones", "zeros"])

    return sample.mapInArrow(run, "place int, ones long, zeros long").groupBy("place").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept) from docs (doc_id, text) and labels (doc_id, toxic)."""
    nothing = np.zeros(0, np.int32), np.zeros(0)
    known = labels.where(F.col("toxic").isin(0, 1) & learnt_from()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.sum("toxic")).first()
    share = (ones or 0) / n if n else 0.0
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in SAMPLE.items()]
    picked = picked[0].unionByName(picked[1]).distinct()  # at most SAMPLE rows
    rows = docs.join(F.broadcast(picked), "doc_id").select("toxic", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sample = scratch.save(places_of(rows), "toxicity-sample")
    n_ones, n_rows = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n_ones < n_rows:
        return *nothing, log_odds(share)
    c, d = F.col("ones").cast("double"), F.col("zeros").cast("double")
    n_zeros = n_rows - n_ones
    chosen = counted(sample).where((c + d >= LEAST_DOCS) & (likelihood_ratio(c, d, n_ones, n_zeros) >= LEAST_G))
    chosen = chosen.select("place", F.ln(((c + 0.5) / (n_ones + 1)) / ((d + 0.5) / (n_zeros + 1))).alias("ratio")).orderBy("place").toArrow()  # at most a row a place
    places, ratio = chosen.column(0).to_numpy().copy(), chosen.column(1).to_numpy().copy()
    if not len(places):
        return *nothing, log_odds(share)

    def keep(batches):
        for batch in batches:
            own = [np.intersect1d(np.frombuffer(b, "<i4"), places, assume_unique=True) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.searchsorted(places, p).astype("<i4").tobytes() for p in own], pa.binary())], names=["toxic", "at"])

    kept = sample.mapInArrow(keep, "toxic int, at binary").orderBy("toxic", "at").toArrow()  # sampled rows, chosen places
    scratch.drop(sample)
    at = [np.frombuffer(b, "<i4") for b in kept.column(1).to_pylist()]
    weights, intercept = fit(places, ratio, np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at), kept.column(0).to_numpy(), share)
    return places, weights, intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], whole_rows: bool = False) -> DataFrame:
    """(doc_id, score) of docs; with whole_rows also row, a struct of all columns of docs."""
    places, values, intercept = model
    row = T.StructType([f for f in docs.schema.fields if whole_rows or f.name == "text"])

    def run(batches):
        kept = np.zeros(len(LENGTHS) << PLACES, bool)
        kept[places] = True
        for batch in batches:
            column = batch.column(1).field("text").cast(pa.binary())
            total = np.full(len(column), intercept)
            for a in range(0, len(column), TEXTS):
                part = column.slice(a, TEXTS)
                data, ends = characters([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part])
                if len(data) and len(places):
                    doc, place = hits(data, ends, kept)
                    total[a : a + TEXTS] += np.bincount(doc, values[np.searchsorted(places, place)], len(part))
            out = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *[batch.column(1)] * whole_rows], names=["doc_id", "score", *["row"] * whole_rows])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())] + [T.StructField("row", row)] * whole_rows)
    return docs.select(F.col("doc_id").cast("long"), F.struct(*[F.col(f"`{f.name}`") for f in row.fields]).alias("row")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (~learnt_from()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
