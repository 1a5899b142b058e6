"""Batches of texts that go to Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch: whole texts are long, so that Spark's usual 10,000 rows would be tens of megabytes several times over.
ROWS_A_BATCH = 1000
#: Bytes of an Arrow batch, for texts that are longer still.
BYTES_A_BATCH = 1 << 25


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch sizes (if larger), which plans read when they run; they have no effect on results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = str(spark.conf.get(name)).removesuffix("b")
    if not told.isdigit() or not 0 < int(told) <= BYTES_A_BATCH:
        spark.conf.set(name, str(BYTES_A_BATCH))


def byte_parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes, or of one row."""
    ends, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
