"""From files to lanes: features, the gate's hint, the best earlier base and the plan; and what the chunked lane gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import constants as C
from sedimenta.functions import kernels, policy
from sedimenta.operators import similarity
from sedimenta.operators.archive import Archive


def features(files: DataFrame) -> DataFrame:
    """All that the planner knows of each file of files (file_index, ext, raw_size, content); no content."""
    container = policy.is_container(F.col("ext"), F.col("content"))
    known = files.select("file_index", "ext", "raw_size", policy.file_class(F.col("ext")).alias("class_tag"), F.coalesce(container, F.lit(False)).alias("is_container"), "content")
    return kernels.features_of(known)


def best_base(known: DataFrame) -> DataFrame:
    """(file_index, base_index, similarity): of a file's candidates the one of the most similar signature, the earliest of equals; known is features()."""
    fps = known.where("raw_size > 0").select("file_index", "ext", F.col("pi_hash64").alias("fp"))
    pairs = similarity.candidates(fps).select("file_index", "base_index")
    sig = known.select("file_index", "pi_sig")
    both = pairs.join(sig, "file_index").join(sig.select(F.col("file_index").alias("base_index"), F.col("pi_sig").alias("base_sig")), "base_index")
    scored = both.select("file_index", "base_index", similarity.jaccard("pi_sig", "base_sig").alias("similarity"))
    best = scored.groupBy("file_index").agg(F.max(F.struct("similarity", (-F.col("base_index")).alias("earlier"))).alias("b"))
    return best.select("file_index", (-F.col("b.earlier")).alias("base_index"), F.col("b.similarity").alias("similarity"))


def planned(known: DataFrame, fast: bool = False, gate: bool = True, bias: float = 0.0, dedupe: bool = True, micro: bool = True) -> DataFrame:
    """(file_index, class_tag, state, action, level, threshold, reason, base_index) of each file; known is features()."""
    based = known.drop("pi_sig", "pi_hash64").join(best_base(known), "file_index", "left")
    own = policy.hinted(policy.gate_hint(F.col("raw_size"), F.col("ext"), fast), F.col("entropy"), F.col("gain"), F.col("motif_score"), F.col("is_container"), F.coalesce("similarity", F.lit(0.0)), fast, gate)
    taken = based.select("file_index", "class_tag", "ext", "raw_size", "base_index", own.alias("f"))
    lane = policy.plan(F.col("raw_size"), F.col("ext"), *[F.col(f"f.{c}") for c in ("entropy", "gain", "motif", "container", "similarity")], F.lit(bias), dedupe, micro)
    out = taken.select("file_index", "class_tag", lane.alias("p"), "base_index").select("file_index", "class_tag", "p.*", "base_index")
    return out.withColumn("base_index", F.when(F.col("action") == "PI", F.col("base_index")))


def observed_gains(archive: Archive) -> DataFrame:
    """(file_index, raw_size, encoded, gain): the bytes that a file's new blocks take in the archive, headers included, and the share saved; never under 0.

    A block belongs to the file that it comes first in, so that repeats cost nothing.
    """
    owner = archive.spans.groupBy("block_id").agg(F.min("file_index").alias("file_index"))
    cost = owner.join(archive.blocks.select("block_id", "comp_len"), "block_id").groupBy("file_index").agg(F.sum(F.col("comp_len") + C.SECTION_HEADER + C.CHUNK_HEADER).alias("encoded"))
    own = archive.files.select("file_index", "raw_size").join(cost, "file_index", "left").withColumn("encoded", F.coalesce("encoded", F.lit(0)).cast("long"))
    return own.withColumn("gain", F.greatest(F.lit(0.0), 1 - F.col("encoded") / F.greatest("raw_size", F.lit(1))))
