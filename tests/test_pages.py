"""Numbered pages of plain Parquet."""

import tempfile

import pytest
from pyspark.sql import functions as F

from spanweave.plans.pages import Pages
from spanweave.schema import LimitError, ValidationError


def test_pages_prefix_and_bytes(spark):
    pages = Pages(spark, "file://" + tempfile.mkdtemp() + "/p", block=8)
    assert pages.cursor().stop == 0
    rows = lambda a, b: spark.range(a, b).select((F.lit(1000) - F.col("id")).alias("n"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("t")).repartition(3)
    assert pages.append(rows(0, 30), ["n"]) == 30
    cursor = pages.cursor()
    assert pages.append(rows(30, 50), ["n"]) == 50
    table = pages.rows().orderBy("seq").collect()
    assert [r.seq for r in table] == list(range(50)) and [r.n for r in table] == [*range(971, 1001), *range(951, 971)]
    sizes = [r.bytes for r in table]
    assert [r.upto for r in table] == [sum(sizes[: k + 1]) for k in range(50)]
    seen = []
    while cursor.next < cursor.stop:
        start = cursor.next
        page, cursor = pages.read(cursor, 9, 90)
        got = [r.seq for r in page.orderBy("seq").collect()]
        assert got == list(range(start, cursor.next)) and sum(sizes[k] for k in got) <= 90
        full = len(got) == 9 or cursor.next == cursor.stop or sum(sizes[k] for k in [*got, cursor.next]) > 90
        assert full
        seen += got
    assert seen == list(range(30))  # rows appended later aren't in the prefix
    assert pages.read(cursor, 5)[0].count() == 0
    with pytest.raises(LimitError, match="row 0"):
        pages.read(pages.cursor(), 5, 10)
    with pytest.raises(ValidationError):
        pages.read(pages.cursor(), 0)
    page, _ = pages.read(pages.cursor(), 9)
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan
    assert len(page.inputFiles()) >= 2 and len(page.select("n")._jdf.queryExecution().executedPlan().collectLeaves().head().relation().location().inputFiles()) >= 2
