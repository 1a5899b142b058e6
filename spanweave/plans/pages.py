"""Numbered outputs as plain Parquet, read page by page.

An appended table's rows are numbered in the given order after those that are there, and each carries the bytes of all rows up to
it. Rows lie in folders of a block of numbers, so a page, which is a range of numbers, reads the files of its blocks alone.
A cursor holds a fixed prefix: rows appended after it was opened aren't in its pages, and reading moves nothing but the cursor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.scan import number_rows, prefix_scan
from spanweave.schema import LimitError, ValidationError

ROWS_A_BLOCK = 1 << 16


@dataclass(frozen=True)
class Cursor:
    next: int
    stop: int


class Pages:
    """One writer at a time; readers need none. block: rows of a folder, the same for all appends."""

    def __init__(self, spark: SparkSession, path: str, block: int = ROWS_A_BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block
        self.schema = None

    def append(self, rows: DataFrame, order: list) -> int:
        """Adds rows with seq, upto and block; returns the number of rows that are there now."""
        count, upto = self._end()
        numbered = number_rows(rows, order, "seq").withColumn("seq", F.col("seq") + count)
        block = F.call_function("div", F.col("seq"), F.lit(self.block).cast("long"))
        size = F.octet_length(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).cast("long")
        scanned = prefix_scan(numbered.withColumn("bytes", size), {"upto": ("sum", F.col("bytes"))}, block, ["seq"]).drop("upto_before")
        scanned = scanned.withColumn("upto", F.col("upto") + upto).withColumn("block", block)
        scanned.repartition("block").sortWithinPartitions("block", "seq").write.mode("append").partitionBy("block").parquet(self.path)
        return self._end()[0]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _end(self) -> tuple[int, int]:
        """How many rows there are and their bytes: of the last block alone."""
        try:
            table = self.rows()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return 0, 0
            raise
        last = table.agg(F.max("block")).first()[0]  # from the folders' names
        if last is None:
            return 0, 0
        found = table.where(F.col("block") == last).agg(F.max("seq"), F.max("upto")).first()
        return found[0] + 1, found[1]

    def cursor(self) -> Cursor:
        return Cursor(0, self._end()[0])

    def read(self, cursor: Cursor, limit: int, max_bytes: int | None = None) -> tuple[DataFrame, Cursor]:
        """The next rows of the cursor's prefix: at most `limit`, and as many as their bytes (as JSON) allow; and the cursor after
        them. A row beyond max_bytes by itself raises, since the cursor could never pass it."""
        if limit < 1 or max_bytes is not None and max_bytes < 1:
            raise ValidationError("a page has one row and one byte at least")
        stop = min(cursor.next + limit, cursor.stop)
        page = self._between(cursor.next, stop)
        if max_bytes is not None and stop > cursor.next:
            first = self._between(cursor.next, cursor.next + 1).first()
            before = first["upto"] - first["bytes"]
            fit = page.where(F.col("upto") - before <= max_bytes).agg(F.max("seq")).first()[0]
            if fit is None:
                raise LimitError(f"row {cursor.next} has {first['bytes']} bytes; {max_bytes} at most")
            stop = fit + 1
            page = self._between(cursor.next, stop)
        return page.drop("block", "bytes", "upto"), replace(cursor, next=stop)

    def _between(self, start: int, stop: int) -> DataFrame:
        blocks = F.col("block").between(start // self.block, max(start, stop - 1) // self.block)
        return self.rows().where(blocks & (F.col("seq") >= start) & (F.col("seq") < stop))
