"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Results are written to Spark's noop sink."""

from __future__ import annotations

import json
import os
import time

from spanweave import catalog
from spanweave.operators import align as A
from spanweave.schema import AlignConfig
from spanweave.session import build_session
from spanweave.sources.jsonl import generate_round_robin, round_robin_streams


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)

    queries = catalog.queries()
    timed("warm-up", lambda: queries["align_tumbling"](spark, sf))
    for name, query in queries.items():
        timed(name, lambda query=query: query(spark, sf))
    config = AlignConfig(100.0, required_streams=round_robin_streams(3))
    for n in (3_000, 100_000, 1_000_000):
        for mode, run in (("offline", A.align), ("replay", A.replay)):
            timed(f"round_robin_{mode}_{n}", lambda n=n, run=run: run(generate_round_robin(spark, n, 3), config).windows)
    fixed = seconds.pop("warm-up")
    rates = {k: round(int(k.rsplit("_", 1)[1]) / v) for k, v in seconds.items() if k.startswith("round_robin")}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "warm_up": fixed, "events_per_second": rates}))


if __name__ == "__main__":
    main()
