"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. A corpus without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import mixing, packing, scratch, simhash, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, whole_rows=True).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least doc_id: links are two bits of SimHash, or five-word shingles with Jaccard similarity 0.8."""
    return simhash.one_of_each(docs, least=0.8).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; documents of which nothing is left go."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    cut = substring_dedup.remove_repeats(docs.select("doc_id", "text", rest), ["rest"], with_text=True)
    left = cut.where((F.col("n_bytes") == 0) | (F.length("kept") > 0))
    new = {"text": F.when(F.col("n_bytes") > 0, F.col("kept")).otherwise(F.lit("")), "n_chars": F.length("kept").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col(f"rest.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each pass over its source."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), "doc_id", "text", "source")
    return mixing.mix(named).select("all.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]
#: The classifier, the components and the packing aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents that come through all stages, with their bins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
