"""File sets as DataFrames: from the driver's tables, or from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that sources are mapped to, so that every class occurs.
EXTENSIONS = ["txt", "md", "json", "csv", "pdf", "docx", "rtf", "png", "mp4", "zip", "exe", "log"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_index, path, ext, raw_size, content): a file for each document, lang/source/id.ext."""
    d = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 10).cast("int") % len(EXTENSIONS)
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), number + 1)
    content = F.encode("text", "UTF-8")
    return d.select(F.col("doc_id").alias("file_index"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"), ext.alias("ext"), F.octet_length(content).cast("long").alias("raw_size"), content.alias("content"))


def scan(spark: SparkSession, *inputs: str) -> DataFrame:
    """(path, ext, raw_size, mtime, content) of all regular files under the inputs; overlapping inputs give a file again.

    Spark's binary reader leaves out empty files and names that begin with a dot or an underscore: these are listed and added.
    """
    out = None
    for top in inputs:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).select("path", F.col("length").alias("raw_size"), F.col("modificationTime").alias("mtime"), "content")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(top)
        listing = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(fs_path, True)
        empty, hidden = [], []
        while listing.hasNext():
            status = listing.next()
            if status.isFile() and status.getLen() == 0:
                empty.append((status.getPath().toString(), 0, bytearray()))
            elif status.isFile() and any(x[:1] in "._" for x in status.getPath().toString()[len(fs_path.toString()) :].split("/") if x):
                hidden.append(status.getPath().toString())
        if hidden:
            named = spark.createDataFrame([(p,) for p in hidden], "path string").mapInArrow(_contents, "path string, raw_size long, content binary")
            part = part.unionByName(named.withColumn("mtime", F.lit(None).cast("timestamp")))
        if empty:
            part = part.unionByName(spark.createDataFrame(empty, "path string, raw_size long, content binary").withColumn("mtime", F.lit(None).cast("timestamp")))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ext", extension("path"))


def _contents(batches):
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out = []
        for uri in batch.column(0).to_pylist():
            store, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                out.append(f.read())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in out], pa.int64()), pa.array(out, pa.binary())], names=["path", "raw_size", "content"])


def extension(path: str):
    """The lower-case suffix without its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"^.+\.([^.]+)$", 1))


def relative_path(path: str, root):
    """Below root (a string or column) with forward slashes; a path that isn't below root stays as it is."""
    slashed = F.translate(F.col(path), "\\", "/")
    top = F.concat(F.regexp_replace(F.translate(F.lit(root) if isinstance(root, str) else root, "\\", "/"), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(slashed, top), F.substr(slashed, F.length(top) + 1)).otherwise(slashed)
