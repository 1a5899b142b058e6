from pyspark.sql import functions as F

from spanweave import catalog
from spanweave.functions import clock

SF = "/root/testdata/sf0.01"


def test_fits_take_every_signup(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'signup'").count()
    assert n > 200
    assert catalog.queries()["offset_fit_every"](spark, SF).first()["anchors"] == n
    assert 200 < catalog.queries()["drift_fit_every"](spark, SF).first()["anchors"] <= clock.MAX_DRIFT_ANCHORS


def test_ranked_medians(spark):
    for n in (1, 2, 7, 1000):
        a = spark.range(n).select(F.col("id").cast("double").alias("reference_ms"), (F.col("id") * F.col("id") % 101).cast("double").alias("observed_ms"))
        d = sorted(i - i * i % 101 for i in range(n))
        mid = (d[(n - 1) // 2] + d[n // 2]) / 2
        r = sorted(abs(x - mid) for x in d)
        assert tuple(clock.estimate_offset(a).first()) == (mid, (r[(n - 1) // 2] + r[n // 2]) / 2, r[-1], n)
