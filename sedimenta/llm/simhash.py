"""Operator 4: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments; their bit counts are a point whose Manhattan distance to another's is at most the Hamming
distance of the fingerprints. The range join of points within the radius r runs on a grid: the segments are dealt into groups, and as
points within r differ in r segments at most, they agree in all but r groups. So a cell of the grid is a choice of groups with their counts,
and points in reach meet in one. What meets is held against the Manhattan bound and then, exactly, the Hamming distance.

Cells of many fingerprints aren't joined with themselves: their fingerprints meet in the midpoints one bit away instead, at most
65 fingerprints to a midpoint, each linked with the least. That finds every link's component with rows in proportion to the fingerprints.

Cases: null, empty and all-space texts have fingerprint zero and link like any other; null doc_ids are kept and are never a component's id
unless it has no other; rows of an equal doc_id each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import graph, scratch

SEED = 42
LOW = 0x5555555555555555
#: Segments of two bits, dealt into this many groups.
GROUPS = 5
#: Words of a shingle where texts are compared whole, and places that hashed shingles are counted in, to order them.
SHINGLE, PLACES = 5, 1 << 18
#: Turns in which the texts of a shingle are compared with one of them, before those that are still apart are compared with each other.
LEADERS = 3
#: Rows whose texts a worker turns into Python objects at a time.
ROWS = 256
#: Longs of parity bits that tell how far two sets of shingles are apart at least.
PARITIES = 8
#: Bytes that words are hashed by at a time, the base of their polynomials, and shingles of texts that a worker remembers.
BLOCK, BASE, REMEMBERED = 1 << 16, 0x100000001B3, 2_000_000
_TABLES: dict = {}
#: Cells with more fingerprints are linked through midpoints.
DENSE = 48


def _pieces(batches):
    """The same rows in batches of ROWS at most."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # on bytes: A-Z only, and splits at \x20\x09-\x0D only
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(joined, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: n - 1]]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in _pieces(batches):
            bits = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b - (1 << 64) if b >> 63 else b for b in bits], pa.int64())], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, radius: int, groups: int = GROUPS) -> DataFrame:
    """(fp, point, cell): the grid cells of each fingerprint. point holds the 32 counts, each as that many ones in two bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW))
    points = fps.select("fp", low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1)).alias("point"))
    masks = [sum(3 << 2 * s for s in range(32) if s % groups in chosen) for chosen in combinations(range(groups), groups - radius)]
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.col("point").bitwiseAND(F.lit(_signed(m))).alias("counts")) for k, m in enumerate(masks)])
    return points.select("fp", "point", F.explode(grid).alias("cell"))


def links(fps: DataFrame, radius: int = 2, dense: int = DENSE) -> DataFrame:
    """(u, v) pairs within the radius whose components are those of all such pairs; fps (fp) holds distinct fingerprints.

    Outside of dense cells these are all such pairs. Needs radius 2: a midpoint is one bit from both ends.
    """
    if radius != 2:
        raise ValueError("midpoints of dense cells are right for radius 2 only")
    found = scratch.save(cells(fps, radius), "simhash-cells")
    shared = found.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(found.join(shared, "cell"), "simhash-met")
    scratch.drop(found)
    near = lambda a, b: (F.bit_count(F.col(f"a.{a}").bitwiseXOR(F.col(f"b.{b}"))) <= radius)
    few = met.where(F.col("n") <= dense)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") > F.col("b.fp")) & near("point", "point") & near("fp", "fp"))
    many = met.where(F.col("n") > dense).select("fp").distinct()
    ways = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    through = many.select("fp", F.explode(ways).alias("way")).select("fp", F.col("fp").bitwiseXOR(F.col("way")).alias("mid"))
    hubs = through.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("mid", "v")
    stars = through.join(hubs, "mid").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).unionByName(stars)


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK, base % (1 << 64), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial over its bytes, mixed."""
    if not _TABLES:
        letters = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        letters[65:91] = letters[97:123]
        _TABLES.update(letters=letters, space=np.isin(np.arange(256), [32, *range(9, 14)]), up=_powers(BASE), down=_powers(pow(BASE, -1, 1 << 64)))
    out, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + BLOCK)
        if end < len(text):  # at white space, or the word is longer than a block and is hashed by the library
            last = max(text.rfind(c, begin, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if last < begin:
                from xxhash import xxh64_intdigest

                cut = min((k for k in (text.find(c, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if k >= 0), default=len(text))
                out.append(np.array([xxh64_intdigest(text[begin:cut].lower(), SEED)], np.uint64))
                begin = cut
                continue
            end = last + 1
        data = np.frombuffer(text, np.uint8, end - begin, begin)
        edge = np.flatnonzero(np.diff(_TABLES["space"][data], prepend=True, append=True))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES["letters"][data] * _TABLES["up"][: len(data)])])
        found = (sums[edge[1::2]] - sums[edge[::2]]) * _TABLES["down"][edge[::2]]
        out.append((found ^ found >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; of all words, where they are fewer. A shingle's hash is made of its words' hashes."""
    of_word = word_hashes(text or b"")
    size = min(width, len(of_word))
    if not size:
        return np.zeros(0, np.int64)
    found = of_word[: len(of_word) - size + 1] + np.uint64(size)
    for k in range(1, size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + of_word[k : len(of_word) - size + 1 + k]
        found ^= found >> np.uint64(29)
    return np.unique(found).view(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """For each place of PARITIES longs, whether an odd number of the shingles falls on it. Two sets differ in as many shingles as in bits, or more."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def similar(texts: DataFrame, least: float) -> DataFrame:
    """(u, v) fingerprints of all pairs of texts (text_hash, text, fp, component) of different components whose shingles have that Jaccard similarity.

    Of two such sets, each has one in common among its first (1 - least) share and one more, in any order that is the same for all. Here
    the rare come first, by counts of hashed places. Shingles that only one component has are left out; of pairs that share one, those of one text
    of the shingle with its others are compared whole, and then those that are in different components even so and whose parities
    differ in no more bits than sets of their sizes may differ in shingles.
    """
    def count(batches):
        n = np.zeros(PLACES, np.int64)
        for batch in _pieces(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(n, shingles(text) & (PLACES - 1), 1)
        place = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n[place])], names=["place", "n"])

    counted = texts.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(PLACES, np.int64)
    common[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def first(batches):
        for batch in _pieces(batches):
            rows, sizes = [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                often = sent.value[own & (PLACES - 1)]
                share = np.lexsort((own, often))[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1]
                places = np.flatnonzero(often[share] > 1)
                rows.append((own[share[places]], len(own) - places))
            lengths = [len(r) for r, _ in rows]
            of = pa.array(np.repeat(np.arange(len(rows)), lengths))
            kept = [batch.column(i).take(of) for i in (0, 2, 3)]
            token, rest = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(rest.astype(np.int32)), pa.array(token, pa.int64())], names=["h", "fp", "component", "n", "rest", "token"])

    heads = scratch.save(texts.select("text_hash", "text", "fp", "component").mapInArrow(first, "h long, fp long, component long, n int, rest int, token long"), "simhash-heads")
    mixed = lambda rows: rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    met = scratch.save(heads.join(mixed(heads), "token"), "simhash-shared")
    scratch.drop(heads)
    # at their first common shingle two such sets still have all that they must share before them
    shared = least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-6
    sized = (F.col("a.rest") >= shared) & (F.col("b.rest") >= shared)
    names = ("h", "fp", "component")
    pair = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in names]
    # first with one text of each shingle, another one each turn, which joins most of what is alike; then all that are still apart
    found = []
    for turn in range(LEADERS):
        lead = met.groupBy("token").agg(F.min(F.struct(F.xxhash64("h", F.lit(turn)).alias("place"), "component", "h", "fp", "n", "rest")).alias("l")).select("token", "l.component", "l.h", "l.fp", "l.n", "l.rest")
        begun = met.alias("a").join(lead.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & sized).select(pair).distinct()
        found.append(compared(texts, scratch.save(begun, "simhash-pairs"), least))
        if not found[-1].first():
            break
        parts = scratch.save(graph.components(found[-1].select(F.col("component_a").alias("u"), F.col("component_b").alias("v")), "simhash-merged"), "simhash-merged")
        now = met.join(parts.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("token", "h", "fp", "n", "rest", F.coalesce("to", "component").alias("component"))
        left = scratch.save(now.join(mixed(now), "token"), "simhash-shared")
        scratch.drop(met, parts)
        met = left
    def mark(batches):
        for batch in _pieces(batches):
            marks = np.array([parities(shingles(t)) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(marks[:, k]) for k in range(PARITIES)]], names=["h", *bits])

    bits = [f"bits{k}" for k in range(PARITIES)]
    marked = texts.join(met.select(F.col("h").alias("text_hash")).distinct(), "text_hash", "left_semi").select("text_hash", "text").mapInArrow(mark, "h long, " + ", ".join(f"{c} long" for c in bits))
    ready = scratch.save(met.join(marked, "h"), "simhash-marked")
    scratch.drop(met)
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in bits[1:]), F.bit_count(F.col("a.bits0").bitwiseXOR(F.col("b.bits0"))))
    close = differ <= (1 - least) / (1 + least) * (F.col("a.n") + F.col("b.n")) + 1e-6
    apart = ready.alias("a").join(ready.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & sized & close).select(pair).distinct()
    found.append(compared(texts, scratch.save(apart, "simhash-pairs"), least))
    scratch.drop(ready)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))


def compared(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (h_a, h_b and others) whose texts' shingles have that Jaccard similarity; texts (text_hash, text)."""
    keep = pairs.columns

    def compare(batches):
        known, size = {}, 0  # shingles by text, as pairs of one text come together
        for batch in _pieces(batches):
            good = []
            for h, g, x, y in zip(*[batch.column(c).to_pylist() for c in ("h_a", "h_b", "text_a", "text_b")]):
                sets = []
                for key, text in ((h, x), (g, y)):
                    if key not in known:
                        if size > REMEMBERED:
                            known, size = {}, 0
                        known[key] = shingles(text)
                        size += len(known[key])
                    sets.append(known[key])
                both = len(np.intersect1d(*sets, assume_unique=True))
                good.append(both >= least * (len(sets[0]) + len(sets[1]) - both) - 1e-9)
            yield batch.select(keep).filter(pa.array(good, pa.bool_()))

    text = lambda side: texts.select(F.col("text_hash").alias("h_" + side), F.col("text").alias("text_" + side))
    both = pairs.join(text("b"), "h_b").join(text("a"), "h_a").repartition(_width(texts), "h_a").sortWithinPartitions("h_a", "h_b")
    out = scratch.save(both.select(*keep, "text_a", "text_b").mapInArrow(compare, pairs.schema), "simhash-similar")
    scratch.drop(pairs)
    return out


def _width(df: DataFrame) -> int:
    """Partitions of what is computed on, which are many although it has few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, radius: int = 2, least: float | None = None) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id) for each row of docs (doc_id, text); least also links texts by their shingles' Jaccard similarity."""
    marked = scratch.save(fingerprints(docs), "simhash-fp")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    parts = graph.components(links(distinct.select("fp"), radius), "simhash-parts")
    if least is not None:
        parts = scratch.save(parts, "simhash-parts")
        known = marked.select("text_hash", "fp").distinct().join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("text_hash", "fp", F.coalesce("component", "fp").alias("component"))
        texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).repartition(_width(docs), "text_hash").dropDuplicates(["text_hash"]).join(known, "text_hash")
        texts = scratch.save(texts, "simhash-texts")
        more = similar(texts, least)
        scratch.drop(texts)
        parts = graph.components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "simhash-parts")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = scratch.save(rooted.join(least, "component").select("fp", "component_id"), "simhash-classes")
    return marked.join(classes, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, least: float | None = None) -> DataFrame:
    """docs (doc_id, text and others) with one row of each component: the one of its least doc_id."""
    marked = near_duplicates(docs, radius, least)
    best = marked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("nameless")).agg(F.min(F.struct(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True)), "doc_id", "text_hash")).alias("b"))
    chosen = scratch.save(best.select(F.col("b.doc_id").alias("of_id"), F.col("b.text_hash").alias("of_hash")), "simhash-chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left_semi")
    again = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left_semi")
    if again.count() > chosen.count():  # rows that are repeated as they are
        out = out.dropDuplicates(["doc_id", "text_hash"])
    return out.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three words, XXH64, two bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
