"""Operator 8: near-duplicate vectors by NN-descent.

Distinct vectors are nodes. The neighbour graph starts from random projections: for each of some tables, nodes are sorted by the signs of
projections and cut into short blocks, in which each node takes its nearest. Then, round by round, the neighbours of a node, in either
direction, are held against each other, and each keeps the best it met, until rounds change little; a node without new neighbours isn't
asked again. Edges beyond twice the link's angle are left out: no path of two links needs them. The edges of the graph that reach the
threshold are the links.

A list that is full of links is saturated: it is enlarged, and its node meets the links of its links again. Lists that are full even then are of
crowded nodes, whose links are as many as the pairs of a crowd: they are counted against all nodes of their component, chunk against
chunk, and no pair is emitted. Links give components: all those that are met in any block or round, as the stars of what they join there, and not
only those in lists.

A sample of nodes is held against all, which grows until it has seen a stated number of links or is all nodes. While the recall of links falls
short, further tables are added, and at last all nodes are held against all, so that no link is missed; links found on the way are kept.

Cases: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component; vectors of different sizes
never link; equal vectors are one node and link with each other; rows of an equal vec_id each get a row; a null vec_id is kept and never is a component's
id unless it has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm import graph, scratch

LINK = 0.95
TABLES, BITS, BLOCK, NEIGHBOURS, ROUNDS = 8, 12, 512, 12, 4
#: Entries of a list that was saturated, and rounds that fill it.
ENLARGED, MORE_ROUNDS = 48, 2
#: Members of a node's surroundings that meet at a time; larger ones are dealt anew in each round.
SURROUNDINGS = 128
#: Rounds end when they improve less than this share of all lists' entries.
STILL = 0.01
CHUNK = 256
#: Nodes up to which TABLES are enough; with 16 and 61 times as many there are 2 and 2.8 times the tables.
PER_TABLE = 65_536
#: Nodes of the audit's first slice, bytes of its largest, links that it must see, and rows of one product.
AUDIT, SLICE_BYTES, SEEN, BRUTE = 256, 8 << 20, 1000, 2048
#: The least recall, and how often tables are added before all nodes are held against all.
RECALL, MORE = 0.98, 3
_EDGE = "u long, v long, sim double"


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit, key): the unit vector in double precision as bytes, and a hash of the vector; null for those without links."""

    def run(batches):
        import hashlib

        for batch in batches:
            unit, key = [], []
            for values in batch.column(1).to_pylist():
                x = np.array([np.nan if v is None else v for v in values], np.float64) if values else np.zeros(0)
                scale = np.abs(x).max() if len(x) else 0.0
                x = x / scale if np.isfinite(x).all() and scale > 0 else np.zeros(0)
                unit.append((x / np.linalg.norm(x)).tobytes() if len(x) else None)
                key.append(hashlib.md5((x * scale).tobytes()).digest() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.binary()), pa.array(key, pa.binary())], names=["vec_id", "unit", "key"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, unit binary, key binary")


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), sim if isinstance(sim, pa.Array) else pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def _joined(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a symmetric matrix of links, and the least place that each reaches by links, for those that reach a lesser one."""
    own = np.flatnonzero(linked.any(axis=1))
    if not len(own):
        return own, own
    inner = linked[np.ix_(own, own)]
    np.fill_diagonal(inner, True)
    least = np.arange(len(own), dtype=np.int32)
    while True:
        after = np.where(inner, least[None, :], len(own)).min(axis=1)
        after = after[after]
        if (after == least).all():
            break
        least = after
    far = least < np.arange(len(own))
    return own[far], own[least[far]]


def _nearest(ids: np.ndarray, units: list[bytes], floor: float, k: int, link: float):
    """Edges from each of some nodes to its k nearest among them, at floor or above; then stars of all nodes that links join, with a null sim."""
    sizes = np.array([len(x) for x in units])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if len(own) < 2:
            continue
        x = np.frombuffer(b"".join([units[i] for i in own]), np.float64).reshape(len(own), -1)
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        sim[ids[own][:, None] == ids[own][None, :]] = -2
        if k < len(own) - 1:
            part = np.argpartition(-sim, k, axis=1)[:, :k]
            a, b = np.repeat(np.arange(len(own)), k), part.reshape(-1)
        else:
            a, b = np.nonzero(sim >= floor)
        good = sim[a, b] >= floor
        if good.any():
            yield _edges(ids[own[a[good]]], ids[own[b[good]]], sim[a[good], b[good]])
            a, b = _joined(sim >= link)
            if len(a):
                yield _edges(ids[own[a]], ids[own[b]], pa.nulls(len(a), pa.float64()))


def projected(nodes: DataFrame, tables: range, floor: float, link: float, k: int = NEIGHBOURS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges within the blocks of each table; nodes (id, unit)."""

    def place(batches):
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            ids, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in units])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join([units[i] for i in own]), np.float64).reshape(len(own), -1)
                for t in tables:
                    if (t, size) not in planes:
                        planes[t, size] = np.random.default_rng((t, int(size))).standard_normal((size, bits + 1))
                    y = x @ planes[t, size]
                    code = ((y[:, :bits] > 0) << np.arange(bits)[::-1]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t), pa.int32()), pa.array(code, pa.int64()), pa.array(y[:, bits]), pa.array(ids[own]), pa.array([units[i] for i in own], pa.binary())], names=["t", "code", "at", "id", "unit"]
                    )

    def meet(batches):
        ids, units, table = [], [], None
        for batch in batches:
            for t, i, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if ids and (t != table or len(ids) >= block):
                    yield from _nearest(np.array(ids), units, floor, k, link)
                    ids, units = [], []
                table = t
                ids.append(i)
                units.append(x)
        if ids:
            yield from _nearest(np.array(ids), units, floor, k, link)

    placed = nodes.select("id", "unit").mapInArrow(place, "t int, code long, at double, id long, unit binary")
    return placed.repartitionByRange("t", "code", "at").sortWithinPartitions("t", "code", "at", "id").mapInArrow(meet, _EDGE)


def nearest_of_each(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, sim, born): the k best edges of each node, each neighbour once; born is the first round that met it."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def either_way(edges: DataFrame) -> DataFrame:
    """edges (u, v, born) in both directions, each once."""
    return edges.select("u", "v", "born").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "born")).groupBy("u", "v").agg(F.min("born").alias("born"))


def met_around(ways: DataFrame, nodes: DataFrame, turn: int, floor: float, link: float, k: int, crowd: int = SURROUNDINGS) -> DataFrame:
    """Edges and stars among the surroundings of each node u of ways (u, v, born) that has one of this turn.

    Surroundings of more than crowd nodes are dealt into parts by a hash that differs from turn to turn, and each part is a group of its own.
    """

    def join(batches):
        center, ids, units = None, [], []
        for batch in batches:
            for u, part, v, x in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if ids and (u, part) != center:
                    yield from _nearest(np.array(ids), units, floor, k, link)
                    ids, units = [], []
                center = u, part
                ids.append(v)
                units.append(x)
        if ids:
            yield from _nearest(np.array(ids), units, floor, k, link)

    asked = ways.groupBy("u").agg(F.count("*").alias("n"), F.max("born").alias("last")).where((F.col("last") == turn) & (F.col("n") > 1))
    parts = F.ceil(F.col("n") / crowd).cast("int")
    dealt = ways.join(asked, "u").select("u", F.pmod(F.xxhash64("v", F.lit(turn)), parts).cast("int").alias("part"), "v")
    around = dealt.join(nodes.select(F.col("id").alias("v"), "unit"), "v").select("u", "part", "v", "unit")
    return around.repartition("u", "part").sortWithinPartitions("u", "part", "v").mapInArrow(join, _EDGE)


class Graph:
    """The neighbour graph: lists (u, v, sim, born) of nodes, and tables of stars (u, v) that links join.

    report, if given, is filled with the directed links in the lists after each round.
    """

    def __init__(self, nodes: DataFrame, floor: float, link: float, report: dict | None = None):
        self.nodes, self.floor, self.link, self.turn = nodes, floor, link, 0
        self.lists: DataFrame | None = None
        self.stars: list[DataFrame] = []
        self.links_by_round: list[int] = [] if report is None else report.setdefault("links_by_round", [])

    def absorb(self, found: DataFrame, k: int) -> tuple[int, float]:
        """Takes edges and stars into the lists of those that found names; returns the entries of all lists and their sum."""
        met = scratch.save(found, "nn-met")
        self.stars.append(met.where("sim IS NULL").select("u", "v"))
        edges = met.where("sim IS NOT NULL").withColumn("born", F.lit(self.turn))
        after = scratch.save(nearest_of_each(edges if self.lists is None else edges.unionByName(self.lists), k), "nn-lists")
        if self.lists is not None:
            scratch.drop(self.lists)
        self.lists = after
        n, total, links = after.agg(F.count("*"), F.coalesce(F.sum("sim"), F.lit(0.0)), F.count(F.when(F.col("sim") >= self.link, 1))).first()
        self.links_by_round.append(links)
        return n, total

    def descend(self, tables: range) -> None:
        """NN-descent from the blocks of tables and earlier lists."""
        self.turn += 1
        size, total = self.absorb(projected(self.nodes, tables, self.floor, self.link), NEIGHBOURS)
        for _ in range(ROUNDS):
            if not size:
                break
            ways = either_way(self.lists)
            now, self.turn = self.turn, self.turn + 1
            new_size, new_total = self.absorb(met_around(ways, self.nodes, now, self.floor, self.link, NEIGHBOURS), NEIGHBOURS)
            moved, size, total = (new_size - size) + (new_total - total), new_size, new_total
            if moved <= STILL * size:
                break

    def saturated(self, k: int, lists: DataFrame) -> DataFrame:
        """(u): nodes with k links in their lists."""
        return lists.where(F.col("sim") >= self.link).groupBy("u").agg(F.count("*").alias("links")).where(F.col("links") >= k).select("u")

    def enlarged(self) -> tuple[DataFrame, DataFrame]:
        """The links (u, v) of the lists, with those of saturated lists enlarged; and (u), the nodes that are saturated even so."""
        short = self.lists.where(F.col("sim") >= self.link)
        full = scratch.save(self.saturated(NEIGHBOURS, self.lists), "nn-saturated")
        if not full.first():
            return short.select("u", "v"), full
        wide = short.join(full, "u", "left_semi").withColumn("born", F.lit(self.turn))
        for _ in range(MORE_ROUNDS):
            ways = either_way(wide.unionByName(short.join(full, "u", "left_anti").withColumn("born", F.lit(0))))
            met = scratch.save(met_around(ways, self.nodes, self.turn, self.link, self.link, ENLARGED), "nn-met")
            self.stars.append(met.where("sim IS NULL").select("u", "v"))
            self.turn += 1
            fresh = met.where("sim IS NOT NULL").join(full, "u", "left_semi").withColumn("born", F.lit(self.turn))
            wide = scratch.save(nearest_of_each(wide.unionByName(fresh), ENLARGED), "nn-wide")
        crowded = scratch.save(self.saturated(ENLARGED, wide), "nn-crowded")
        return short.select("u", "v").unionByName(wide.select("u", "v")), crowded

    def components(self, links: DataFrame, extra: list[DataFrame]) -> DataFrame:
        edges = links
        for more in self.stars + extra:
            edges = edges.unionByName(more)
        return scratch.save(graph.components(edges, "nn-parts"), "nn-parts")


def crowded_links(nodes: DataFrame, parts: DataFrame, crowded: DataFrame, link: float) -> DataFrame:
    """(id, links): for each crowded node the members of its component that it links with, counted by their weight n."""
    marked = parts.join(crowded.select(F.col("u").alias("node"), F.lit(True).alias("asked")), "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sizes = marked.groupBy("component").agg(F.sum(F.col("asked").cast("int")).alias("n_asked"), F.sum((~F.col("asked")).cast("int")).alias("n_rest")).where("n_asked > 0")
    first, rest = F.ceil(F.col("n_asked") / CHUNK).cast("int"), F.ceil(F.col("n_rest") / CHUNK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    member = marked.join(sizes, "component").select("node", "component", F.when(F.col("asked"), deal(first)).otherwise(first + deal(rest)).alias("chunk"), F.when(F.col("asked"), first + rest).otherwise(first).alias("faces"))
    packed = (
        member.join(nodes.select(F.col("id").alias("node"), "n", "unit"), "node")
        .groupBy("component", "chunk", "faces")
        .agg(F.collect_list(F.struct("node", "n", "unit")).alias("rows"))  # about CHUNK
    )
    faced = packed.select("component", "chunk", "rows", F.explode(F.sequence(F.lit(0), F.col("faces") - 1)).alias("other"))
    meetings = faced.groupBy("component", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).agg(F.collect_list("rows").alias("sides"))  # one side or two

    def count(batches):
        for batch in batches:
            ids, links = [], []
            for sides in batch.column(0).to_pylist():
                data = [(np.array([r["node"] for r in s]), np.array([r["n"] for r in s]), np.frombuffer(b"".join(r["unit"] for r in s), np.float64).reshape(len(s), -1)) for s in sides]
                sim = data[0][2] @ data[-1][2].T >= link
                if len(data) == 1:
                    np.fill_diagonal(sim, False)
                ids.append(data[0][0])
                links.append(sim @ data[-1][1])
                if len(data) == 2:
                    ids.append(data[1][0])
                    links.append(sim.T @ data[0][1])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(links), pa.int64())], names=["id", "links"])

    counts = meetings.select("sides").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    return counts.join(crowded.select(F.col("u").alias("id")), "id", "left_semi")


def counted_links(nodes: DataFrame, links: DataFrame, crowded: DataFrame, parts: DataFrame, link: float) -> DataFrame:
    """(id, links) of the nodes that have any: from the links (u, v) either way, and for crowded nodes from their components."""
    ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().join(crowded, "u", "left_anti")
    from_lists = ways.join(nodes.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    return scratch.save(from_lists.unionByName(crowded_links(nodes, parts, crowded, link)) if crowded.first() else from_lists, "nn-links")


def audited(nodes: DataFrame, parts: DataFrame, link: float, low: float, high: float) -> DataFrame:
    """(u, v, links): for the nodes u whose place in a fixed shuffle is in [low, high), by brute force over all nodes, the links of a batch of them
    by weight, as rows with a null v; and one link for each batch and component other than the node's own that it links with.

    The nodes asked go to the driver and to all tasks.
    """
    placed = nodes.select("id", "unit", "n").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "unit", F.coalesce("component", "id").alias("component"), "n")
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)
    asked = placed.where((at >= low) & (at < high)).toArrow()
    q_ids, q_units, q_parts = asked.column(0).to_numpy(), asked.column(1).to_pylist(), asked.column(2).to_numpy()
    sizes = np.array([len(x) for x in q_units])
    queries = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        queries.append((int(size), q_ids[own], q_parts[own], b"".join([q_units[i] for i in own])))
    sent = nodes.sparkSession.sparkContext.broadcast(queries)

    def brute(batches):
        for batch in batches:
            ids, units, parts_, weights = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lengths = np.array([len(x) for x in units])
            for size, q_id, q_part, q_unit in sent.value:
                q, total = np.frombuffer(q_unit, np.float64).reshape(len(q_id), -1), np.zeros(len(q_id), np.int64)
                us, vs, across = [], [], []
                of_size = np.flatnonzero(lengths == size)
                for i in range(0, len(of_size), CHUNK):
                    own = of_size[i : i + CHUNK]
                    x = np.frombuffer(b"".join([units[k] for k in own]), np.float64).reshape(len(own), -1)
                    for j in range(0, len(q), BRUTE):
                        a, b = np.nonzero(q[j : j + BRUTE] @ x.T >= link)
                        a, b = j + a, own[b]
                        a, b = a[q_id[a] != ids[b]], b[q_id[a] != ids[b]]
                        np.add.at(total, a, weights[b])
                        far = q_part[a] != parts_[b]
                        us.append(a[far]), vs.append(ids[b[far]]), across.append(parts_[b[far]])
                u, v, c = (np.concatenate(x) if us else np.zeros(0, np.int64) for x in (us, vs, across))
                _, first = np.unique(np.stack([u, c]), axis=1, return_index=True)
                some, u, v = np.flatnonzero(total), q_id[u[first]], v[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q_id[some], u])), pa.array([None] * len(some) + v.tolist(), pa.int64()), pa.array(np.concatenate([total[some], np.zeros(len(u), np.int64)]))], names=["u", "v", "links"])

    return scratch.save(placed.mapInArrow(brute, "u long, v long, links long"), "nn-audit")


def audit(nodes: DataFrame, parts: DataFrame, counts: DataFrame, link: float, n: int, whole: bool = False) -> tuple[float, int, list[DataFrame]]:
    """The share of links that counts (id, links) has, the links that were seen, and the tables of audited().

    Nodes are asked slice by slice, each four times the last one, until SEEN links are counted or all nodes have been asked: then, and if whole
    is set, the result is exact. A slice that goes to the driver holds SLICE_BYTES at most.
    """
    bytes_each = nodes.agg(F.coalesce(F.max(F.octet_length("unit")), F.lit(8))).first()[0]
    most = max(1, SLICE_BYTES // bytes_each)
    low, step, links, same, tables = 0.0, AUDIT, 0, 0, []
    while low < 1.0 and (whole or links < SEEN):
        high = min(1.0, low + min(most if whole else step, most) / max(n, 1))
        high = 1.0 if high > 0.999 else high
        table = audited(nodes, parts, link, low, high)
        true = table.where("v IS NULL").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("true"))
        seen, had = true.join(counts, "id", "left").agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum(F.least("true", F.coalesce("links", F.lit(0)))), F.lit(0))).first()
        links, same = links + seen, same + had
        tables.append(table)
        low, step = high, step * 4
    return (same / links if links else 1.0), links, tables


def tables_for(n: int) -> int:
    """Tables of projections: blocks hold a smaller share of more nodes, so their number grows."""
    return math.ceil(TABLES * max(1.0, (n / PER_TABLE) ** 0.25))


def near_duplicates(vectors: DataFrame, link: float = LINK, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    report, if given, is filled with the recall of links, the links that its audit saw, and the links in the lists after each round.
    """
    rows = scratch.save(_vectors(vectors), "nn-vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"))
    nodes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "nn-nodes")
    size = nodes.count()
    tables, near = tables_for(size), Graph(nodes, 2 * link * link - 1, link, report)
    extra: list[DataFrame] = []
    across = lambda found: [t.where("v IS NOT NULL").select("u", "v") for t in found]

    for turn in range(MORE + 1):
        near.descend(range(turn * tables, (turn + 1) * tables))
        links, crowded = near.enlarged()
        parts = near.components(links, extra)
        counts = counted_links(nodes, links, crowded, parts, link)
        recall, seen, found = audit(nodes, parts, counts, link, size)
        extra += across(found)
        if recall >= RECALL:
            if any(t.first() for t in across(found)):
                parts = near.components(links, extra)
                counts = counted_links(nodes, links, crowded, parts, link)
            break
    else:
        recall, seen, found = 1.0, *audit(nodes, parts, counts, link, size, whole=True)[1:]
        parts = near.components(links, extra + across(found))
        counts = found[0]
        for more in found[1:]:
            counts = counts.unionByName(more)
        counts = counts.where("v IS NULL").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    if report is not None:
        report.update(recall=recall, seen=seen)
    placed = nodes.select("id", "key", "n", "least").join(parts.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.save(placed.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked")), "nn-classes")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, links at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {LINK}),
reached AS (
  SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
least AS (
  SELECT u, min(v) AS component_id FROM reached GROUP BY u),
n AS (
  SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.u LEFT JOIN n ON v.vec_id = n.u
"""
