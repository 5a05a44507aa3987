"""Consecutive small files into shared blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import constants as C
from sedimenta.operators.ordering import running_total


def pack(files: DataFrame, cutoff: int = C.MICRO_CUTOFF, block_max: int = C.MICRO_BLOCK_MAX, entry_max: int = C.MICRO_ENTRY_MAX) -> DataFrame:
    """(file_index, island, block_no, entry, offset) of files (file_index, raw_size) up to cutoff.

    A larger file ends an island of small ones; within it a block is filled until the next file does not fit. An island's rows are
    folded in order by one task, of which it needs the sizes only.
    """
    marked = running_total(files.select("file_index", "raw_size", F.when(F.col("raw_size") > cutoff, 1).otherwise(0).alias("_large")), "_large", "file_index", "island")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("file_index")
        block, entry, used, out = 0, 0, 0, []
        for size in table.column("raw_size").to_pylist():
            if entry and (used + size > block_max or entry >= entry_max):
                block, entry, used = block + 1, 0, 0
            out.append((block, entry, used))
            entry, used = entry + 1, used + size
        return pa.table({"file_index": table.column("file_index"), "island": table.column("island"), **{n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("block_no", "entry", "offset"))}})

    return marked.where("_large = 0").select("file_index", "raw_size", "island").groupBy("island").applyInArrow(fill, "file_index long, island long, block_no long, entry long, offset long")
