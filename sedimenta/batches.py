"""Arrow batches by bytes: a worker's memory follows its largest row, not how many rows a batch happens to have."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE, ROWS = 1 << 20, 1000


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Arrow batches are cut by bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks, and others run beside them."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], col: str | int, most: int = PIECE, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, in slices of at most `rows` rows and `most` bytes of a text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most or i - start == rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    release()
