"""Python functions over Arrow columns, some of the rows at a time.

A batch is up to 10,000 rows or 64 MB.  As Python objects it is many times
that, so only one piece of it is held as objects at any time; the rest stays
Arrow data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of the first column, and rows, of a piece.
BYTES, ROWS = 1 << 20, 512


def in_pieces(function: Callable[..., list], kind: pa.DataType, first: pa.Array, *others: pa.Array) -> pa.Array:
    """``function`` (lists of values to a list of results) over columns of which the first is text or bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = size // BYTES * (len(first) // ROWS + 1) + np.arange(len(first)) // ROWS
    at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(first)]
    return pa.concat_arrays([pa.array(function(*[c.slice(a, b - a).to_pylist() for c in (first, *others)]), kind) for a, b in zip(at, at[1:])])


#: Most bytes of an Arrow batch of whole documents: a worker holds its input and its output several times over.
BATCH = 4 << 20


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in whose session Arrow batches are from now on of ``BATCH`` bytes at most; what is set lower stays."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = rows.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if not 0 < now <= BATCH:
        conf.set(key, str(BATCH))
    return rows
