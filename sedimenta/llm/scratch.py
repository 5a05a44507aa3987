"""Intermediate tables in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, local mode) a temporary one is made and set.
A table written here cuts the lineage: a lost executor costs the tasks that run, not what is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sedimenta-"))
    return _LOCAL[0]


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own for one run of one step."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df once and returns the table read back; its path is in ``.scratch_path``."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables from save() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
