"""Search for an earlier file that is a good base: an as-of band join on fingerprint buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import constants as C


def bucket(fp: str, bits: int = C.PI_BUCKET_BITS):
    return F.shiftrightunsigned(fp, 64 - bits).cast("int")


def hamming(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def jaccard(a: str, b: str):
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (union == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def candidates(files: DataFrame, top: int = C.PI_CANDIDATES, kept: int = C.PI_BUCKET_KEPT, bits: int = C.PI_BUCKET_BITS) -> DataFrame:
    """(file_index, base_index, hamming, rank) of files (file_index, ext, fp): the nearest of the newest earlier files in the same or a neighbouring bucket.

    In each bucket members are numbered; a query sees how many came before it and joins the two blocks of `kept` numbers that
    hold the newest. So a file meets at most 6 * kept others, however large its bucket is.
    """
    top_bucket = (1 << bits) - 1
    base = files.select("file_index", "ext", "fp", bucket("fp", bits).alias("b"))
    asks = base.select("file_index", "ext", "fp", F.explode(F.array_distinct(F.array("b", (F.col("b") - 1).bitwiseAND(top_bucket), (F.col("b") + 1).bitwiseAND(top_bucket)))).alias("b"))
    events = base.withColumn("is_member", F.lit(1)).unionByName(asks.withColumn("is_member", F.lit(0)))
    # a query stands before the member of its own file
    before = F.coalesce(F.sum("is_member").over(Window.partitionBy("ext", "b").orderBy("file_index", "is_member").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = events.withColumn("before", before)
    members = numbered.where("is_member = 1").select("ext", "b", F.col("file_index").alias("base_index"), F.col("fp").alias("base_fp"), F.col("before").alias("no"), F.floor(F.col("before") / kept).alias("block"))
    last = F.floor((F.col("before") - 1) / kept)
    asked = numbered.where("is_member = 0 AND before > 0").select("ext", "b", "file_index", "fp", "before", F.explode(F.array(last, last - 1)).alias("block"))
    near = asked.join(members, ["ext", "b", "block"]).where((F.col("no") < F.col("before")) & (F.col("no") >= F.col("before") - kept))
    near = near.withColumn("hamming", hamming("fp", "base_fp"))
    rank = F.row_number().over(Window.partitionBy("file_index").orderBy("hamming", "base_index"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("file_index", "base_index", F.col("hamming").cast("int"), F.col("rank").cast("int"))
