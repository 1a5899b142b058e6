"""Streams over files, and controls for keyed processors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import shared_dir
from spanweave.streaming.processors import ROCKSDB, KeyedJoin, stateful


def sharded(data: DataFrame, shards: int, controls: str = "op <> 'process'") -> DataFrame:
    """Adds shard: of a data row by its key; a control row, which holds for all keys, goes to each of the shards."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return data.withColumn("shard", F.explode(F.when(F.expr(controls), every).otherwise(own)))


def run_batches(rows: DataFrame, batches: Iterable[Column], build: Callable[[DataFrame], DataFrame], tag: str = "stream") -> DataFrame:
    """Runs a stream over the rows that each condition holds for, one micro-batch after another: a batch's files are added to the
    source's folder, and the query runs until it has read what there is. Its results come back from a file sink, which takes
    each micro-batch once, whatever fails; state stays in the checkpoint between the runs."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = None
    for condition in batches:
        rows.where(condition).write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        schema = out.schema
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def streamed_join(cuts: Iterable[int], shards: int = 8) -> Callable[..., DataFrame]:
    """keyed_join as a stream, for Graph.every and Graph.run: arrivals in micro-batches that end before the positions in cuts, and
    a last one that closes all sides. A graph's joins so close in its order, each after the final rows of those before it."""
    cuts = list(cuts)

    def join(tagged: DataFrame, sides: list[str], insert: str = "last", emit: str = "final") -> DataFrame:
        arrivals = tagged.select(F.lit("data").alias("op"), "pos", "side", "key", "value")
        ends = tagged.sparkSession.createDataFrame([("eof", s) for s in sides], "op string, side string")
        rows = sharded(arrivals.unionByName(ends, allowMissingColumns=True), shards, "op = 'eof'")
        bounds = [None, *cuts, None]
        batches = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            inside = F.col("op") == "data"
            if low is not None:
                inside = inside & (F.col("pos") >= low)
            if high is not None:
                inside = inside & (F.col("pos") < high)
            batches.append(inside)
        return run_batches(rows, [*batches, F.col("op") == "eof"], lambda s: stateful(s, KeyedJoin(sides, insert, emit), "shard"), "join")

    return join
