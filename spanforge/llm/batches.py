"""Arrow batches in slices of bounded text."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from spanforge.llm.encode import ENCODERS

SLICE_BYTES = 2 << 20
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, or of a single row; a limit that the caller has set stays.

    Spark's own is 64 MiB or 10,000 rows, which the executor holds beside its heap, and the worker again, for every running task.
    """
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


@functools.cache
def _libc():
    """The C library, told to give arrays of a MiB and more back as soon as they are free; None where there is no such call."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)
        return libc
    except (OSError, AttributeError):
        return None


def lean(encoder: Callable | None = None) -> None:
    """Memory that this worker doesn't use any more goes back to the system, now and as it gets free; workers live on from task to task.

    Encoders that earlier tasks loaded go too, but those of `encoder`, which this task uses.
    """
    unused = [e for e in ENCODERS if e is not encoder and e.cache_info().currsize]
    for e in unused:
        e.cache_clear()
    if unused:
        gc.collect()  # an encoder and its tables refer to each other
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


def trim() -> None:
    """Memory that this process has freed goes back to the system."""
    if _libc():
        _libc().malloc_trim(0)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in parts of `most` bytes, or of a single text."""
    for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=most):
        yield b.column(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice take `most` bytes, or are a single text."""
    import numpy as np

    for b in batches:
        sizes = b.column(b.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end
