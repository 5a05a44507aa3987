"""Operator 9: mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected: with a repetition limit, to the
smallest in 0..1 at which no source is passed over more often than the limit, if the largest is passed over once; with a target entropy, to the one at
which the weights have it. Budgets are the weights of a total that gives every source one whole pass at least, so that nothing is lost.
They are met by block permutations: a source's documents are dealt into blocks by a hash, a pass takes all blocks in an order of its own,
and the last, partial pass takes whole blocks while they fit the budget, then the documents of one more block in the order of a hash while they fit.

Sources are rows of a table at all times: each step of the bisection is a sum over it. No source is gathered in a task; a document's place
is known from its block, and blocks are of bounded size.

Cases: null texts and texts of zero length have zero tokens and come once per whole pass; a null source is a source of its own; a source without
tokens gets one pass; rows of an equal doc_id are documents of their own if their text differs, and else share their fate; an empty
table gives no rows; other columns stay unless their names clash with those added, which then replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sedimenta.llm import scratch

LIMIT = 2.0
SEED = 11
#: Documents in a block, about.
BLOCK_DOCS = 2_000
#: Exponents that one job tries, and jobs.
TRIES, JOBS = 15, 6


def entropy_at(sources: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy in nats of the normalised weights at each exponent; sources (tokens)."""
    log_t = F.log(F.col("tokens").cast("double"))
    total = [F.sum(F.exp(a * log_t)) for a in exponents]
    moment = [F.sum(F.exp(a * log_t) * a * log_t) for a in exponents]
    row = sources.where("tokens > 0").agg(*total, *moment).first()
    n = len(exponents)
    return [math.log(row[i]) - row[n + i] / row[i] if row[i] else 0.0 for i in range(n)]


def bisect_exponent(sources: DataFrame, limit: float | None = LIMIT, entropy: float | None = None) -> float:
    """The exponent for a repetition limit (at least 1) or else a target entropy, for sources (tokens).

    Weights even out as the exponent falls from 1 to 0: entropy and repetition grow, so either target brackets one exponent.
    """
    least, most = sources.where("tokens > 0").agg(F.min("tokens"), F.max("tokens")).first()
    if not most or least == most:
        return 1.0
    low, high = 0.0, 1.0
    if limit is not None:  # passes of the smallest source while the largest has one
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if (most / least) ** (1 - middle) <= limit else (middle, high)
        return high
    for _ in range(JOBS):
        grid = [low + (high - low) * i / (TRIES + 1) for i in range(TRIES + 2)]
        found = entropy_at(sources, grid)
        under = [i for i, e in enumerate(found) if e <= entropy]
        i = max(1, under[0]) if under else TRIES + 1
        low, high = grid[i - 1], grid[i]
    return high


def with_budgets(sources: DataFrame, exponent: float) -> DataFrame:
    """sources (source, tokens, docs) with weight, whole passes and the rest of the budget in tokens for a partial pass."""
    log_t = F.log(F.col("tokens").cast("double"))
    row = sources.where("tokens > 0").agg(F.sum(F.exp(exponent * log_t)), F.max("tokens"), F.min("tokens")).first()
    total, most, least = row[0] or 1.0, row[1] or 1, row[2] or 1
    raw = F.when(F.col("tokens") > 0, F.exp(exponent * log_t)).otherwise(F.lit(0.0))
    # the source with the least weight by token has one pass: the largest, as exponents are at most 1
    base = float(most if exponent <= 1 else least)
    passes = F.when(F.col("tokens") > 0, F.pow(F.lit(base) / F.col("tokens"), F.lit(1 - exponent))).otherwise(F.lit(1.0))
    rounded = F.round(passes, 9)
    return sources.withColumns({"weight": raw / F.lit(total), "whole": F.floor(rounded).cast("int"), "rest": F.floor((rounded - F.floor(rounded)) * F.col("tokens")).cast("long")})


def mix(docs: DataFrame, limit: float | None = LIMIT, entropy: float | None = None, tokens=None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each document once a pass that it is in: docs' columns, then n_tokens, pass (from 1), block and place, by which a pass is ordered.

    tokens is a column of docs' token counts; bytes of text if not given. place orders a source's pass; it is a hash, so shuffled data needs no sort.
    """
    count = F.coalesce((tokens if tokens is not None else F.octet_length(F.col("text").cast("binary"))).cast("long"), F.lit(0).cast("long"))
    added = {"n_tokens", "pass", "block", "place"}
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    base = docs.select(kept.alias("row"), "source", count.alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("identity"))
    sizes = scratch.save(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mixing-sources")
    plan = scratch.save(with_budgets(sizes, bisect_exponent(sizes, limit, entropy)).withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("int")), "mixing-plan")
    same = lambda a, b: a.eqNullSafe(b)
    mine = plan.select(F.col("source").alias("of"), "whole", "rest", "blocks")
    own = base.join(mine, same(F.col("source"), F.col("of"))).drop("of")
    own = own.withColumn("block", F.pmod(F.xxhash64("identity"), F.col("blocks")).cast("int"))
    order = lambda n, *c: F.xxhash64(F.lit(seed + 1), n, *c)
    # the partial pass: blocks in its order while they fit, by running sums over blocks; documents only in the block where the budget ends
    last = F.col("whole") + 1
    light = own.where("rest > 0").select("source", "block", "identity", "n_tokens", "rest", last.alias("pass"))
    by_block = light.groupBy("source", "block", "pass", "rest").agg(F.sum("n_tokens").alias("t"))
    queue = Window.partitionBy("source").orderBy(order("pass", "block"), "block")
    cut = by_block.withColumn("after", F.sum("t").over(queue)).select("source", "block", F.when(F.col("after") <= F.col("rest"), F.lit(None)).otherwise(F.col("rest") - F.col("after") + F.col("t")).alias("left"), (F.col("after") - F.col("t") < F.col("rest")).alias("in_part"))
    cut = scratch.save(cut.where("in_part"), "mixing-cut")
    edge = light.join(cut.where("left IS NOT NULL").withColumnRenamed("source", "of"), same(F.col("source"), F.col("of")) & (light["block"] == cut["block"])).select("source", light["block"], "identity", "n_tokens", "pass", "left")
    by_identity = edge.groupBy("source", "block", "identity", "pass", "left").agg(F.sum("n_tokens").alias("t"))
    inner = Window.partitionBy("source", "block").orderBy(order("pass", "identity"), "identity")
    fits = by_identity.withColumn("after", F.sum("t").over(inner)).where("after <= left").select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.col("identity").alias("of_identity"))
    # one row for each block that goes whole, and each document of the blocks that end a budget
    whole_blocks = cut.where("left IS NULL").select(F.col("source").alias("of"), F.col("block").alias("of_block"), F.lit(None).cast("long").alias("of_identity"))
    marks = scratch.save(whole_blocks.unionByName(fits), "mixing-marks")
    in_block = marks.where("of_identity IS NULL").select("of", "of_block", F.lit(1).alias("whole_block"))
    one_by_one = marks.where("of_identity IS NOT NULL").select(F.col("of").alias("of2"), F.col("of_identity").alias("of_identity"), F.lit(1).alias("one"))
    marked = own.join(in_block, same(F.col("source"), F.col("of")) & (F.col("block") == F.col("of_block")), "left").join(one_by_one, same(F.col("source"), F.col("of2")) & (F.col("identity") == F.col("of_identity")), "left")
    passes = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("whole_block").isNotNull() | F.col("one").isNotNull()), 1).otherwise(0)
    out = marked.withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    return out.select("row.*", "n_tokens", "pass", order("pass", "block").alias("block"), order("pass", "identity").alias("place"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by bytes of text, with at most two passes."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", F.col("n_tokens").alias("n_bytes"), "pass", "block", "place")
