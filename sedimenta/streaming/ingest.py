"""Incremental ingest: only chunks that no earlier batch has."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sedimenta.functions import constants as C
from sedimenta.operators import chunking


def new_chunks(files: DataFrame, size: int = C.CHUNK_SIZE) -> DataFrame:
    """(file_index, chunk_no, raw_len, h32) of a stream of files, each distinct chunk once; the hashes seen are the stream's state."""
    return chunking.chunks(files, size).dropDuplicates(["h32"])
