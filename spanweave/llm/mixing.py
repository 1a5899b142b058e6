"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in built-in functions only.

Sources in order of code point (null last) get weights by a repeating pattern; their targets share the tokens of all
sources and stop at repeats times a source's own size, what exceeds it being shared again by weight. One block of equally
many tokens is one seat: seats go to sources by the highest quotients target / (2 s + 1), and a source's seats go
to its shards in the same way, by size. A block has block_tokens tokens, or fewer (a power of two, down to one token) where
that is more than a 128th of a target: of the smallest one for the sources' seats, of its own for a source's shards. A shard is a part of a source's documents (by hash) in seeded order, its tokens cut
into blocks; a quota of q over n blocks takes each block q div n times and q mod n of them, chosen by a seeded permutation,
once more. A document's share follows from the blocks that its tokens lie in, so blocks are never made as rows and no
window spans more than a shard.

Null texts have size 0 and are never taken; an empty table gives no rows; null sources are one source. Repeated rows are
documents of their own; rows with the same doc_id are told apart by a hash of the text, so reruns agree. Tables of sources and shards hold sums only (shards: one per shard_tokens tokens of a source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import saved

_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: A prime above any number of blocks in a shard, so that j -> j * PRIME mod n is a permutation.
_PRIME = 2147483647


def _sized(docs: DataFrame) -> DataFrame:
    """Adds _size and _source, a text that is never null."""
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return docs.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"), "_source": source, "_hash": F.xxhash64("text")})


def _block_of(target: Column, block_tokens: int) -> Column:
    """The largest power of two that is at most a 128th of the target, from 1 to block_tokens."""
    return F.greatest(F.lit(1.0), F.least(F.lit(float(block_tokens)), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(target, F.lit(1.0)) / 128))))).cast("long")


def apportion(items: DataFrame, group: str, weight: str, seats: str, tie: str) -> DataFrame:
    """Adds column quota: in each group, seats go to items one by one by the highest weight / (2 quota + 1), ties by tie.

    Starts from a lower bound of each quota, so that only about six quotients per item are ranked.
    """
    all_ = Window.partitionBy(group)
    share = F.col(weight) / F.sum(weight).over(all_)
    known = items.where(F.col(weight) > 0).withColumn("_p", share).withColumn("_m", F.ceil(F.col("_p") * F.count(F.lit(1)).over(all_) / 2))
    known = known.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor(F.col("_p") * F.col(seats)) - F.col("_m") - 1)).withColumn("_left", F.col(seats) - F.sum("_low").over(all_))
    tried = known.select(group, tie, weight, "_left", "_low", F.explode(F.sequence(F.col("_low"), F.col("_low") + 2 * F.col("_m") + 4)).alias("_s"))
    ranked = tried.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy((F.col(weight) / (2 * F.col("_s") + 1)).desc(), tie, "_s")))
    quota = ranked.groupBy(group, tie).agg((F.max("_low") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("quota"))
    return items.join(quota, [group, tie], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def plan_sources(sizes: DataFrame, pattern: tuple[int, ...], repeats: int, block_tokens: int) -> DataFrame:
    """One row per source: _source, source_size, target, _block (tokens) and quota (blocks), from rows of _source and _size."""
    every = Window.partitionBy(F.lit(0))
    one = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(every.orderBy(F.col("_source") == "n", "_source"))
    one = one.withColumn("_i", place).withColumn("_w", F.element_at(F.array(*map(F.lit, pattern)), F.pmod(F.col("_i") - 1, F.lit(len(pattern))) + 1).cast("double"))
    one = one.withColumn("_cap", F.col("source_size").cast("double") * repeats).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = every.orderBy("_ratio", "_i").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    one = one.withColumn("_level", level)
    # The first source, by ratio, that its level doesn't fill up sets the level of all that aren't full.
    common = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_i", "_level"))).over(every)["_level"]
    one = one.withColumn("target", F.least(F.col("_cap"), F.col("_w") * common))
    one = one.withColumn("_unit", _block_of(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every), block_tokens))
    one = one.withColumn("_seats", F.round(F.sum("source_size").over(every) / F.col("_unit")).cast("long")).withColumn("_all", F.lit(0))
    one = apportion(one, "_all", "target", "_seats", "_source").withColumn("_block", _block_of(F.col("target"), block_tokens))
    return one.select("_source", "source_size", "target", "_block", F.round(F.col("quota") * F.col("_unit") / F.col("_block")).cast("long").alias("quota"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), pattern: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block_tokens: int = 64, shard_tokens: int = 1 << 21, seed: int = 17) -> DataFrame:
    """The columns keep of every document (doc_id among them), then _size, source_size, target, taken, and how to take it: _start (its first
    token in its shard), _laps, _n (blocks), _rest (blocks taken once more) and _shift (of the permutation)."""
    rows = _sized(docs)
    narrow = saved(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_source", "_size", "_hash"), "mix-sizes")
    sources = saved(plan_sources(narrow, pattern, repeats, block_tokens), "mix-sources")
    sources = sources.withColumn("_shards", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_tokens)))

    def sharded(x: DataFrame) -> DataFrame:
        return x.join(sources, "_source").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_hash"), F.col("_shards")))

    shards = sharded(narrow).groupBy("_source", "_shard").agg(F.sum("_size").alias("_shard_size"), F.max("quota").alias("_seats"), F.max("_block").alias("_block"))
    shards = apportion(shards, "_source", "_shard_size", "_seats", "_shard").withColumn("_n", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_shard_size") / F.col("_block"))))
    shards = shards.withColumn("_q", F.least(F.col("quota"), repeats * F.col("_n"))).select("_source", "_shard", "_n", F.expr("_q div _n").alias("_laps"), F.pmod("_q", "_n").alias("_rest"), F.pmod(F.xxhash64(F.lit(seed), "_source", "_shard"), F.col("_n")).alias("_shift"))

    placed = sharded(narrow if keep == ("doc_id",) else rows.select(*keep, "_source", "_size", "_hash"))
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_hash"), "doc_id", "_hash", "_size")
    placed = placed.withColumn("_start", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    out = placed.join(shards, ["_source", "_shard"])
    end = F.col("_start") + F.col("_size")

    def add(total: Column, j: Column) -> Column:
        own = F.least((j + 1) * F.col("_block"), end) - F.greatest(j * F.col("_block"), F.col("_start"))
        return total + F.when(_chosen(j), own).otherwise(F.lit(0).cast("long"))

    blocks = F.sequence(F.expr("_start div _block"), F.expr("(_start + _size - 1) div _block"))
    once = F.when((F.col("_size") > 0) & (F.col("_rest") > 0), F.aggregate(blocks, F.lit(0).cast("long"), add)).otherwise(F.lit(0).cast("long"))
    return out.withColumn("_once", once).withColumn("taken", F.col("_laps") * F.col("_size") + F.col("_once")).drop("_shards", "quota", "_shard", "_hash")


def _chosen(j: Column) -> Column:
    return F.pmod(j * _PRIME + F.col("_shift"), F.col("_n")) < F.col("_rest")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: a row per time that a document is taken whole, then one with the words of
    its blocks that are taken once more (the whole text if they are all), n_chars being the new text's length."""
    out = mix(docs.withColumn("_doc", F.struct(*docs.columns)), keep=("doc_id", "text", "_doc"), **settings)
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    part = F.array_join(F.filter(words, lambda w, i: _chosen(F.floor((F.col("_start") + i) / F.col("_block")))), " ")
    rest = F.when(F.col("_once") == 0, F.array().cast("array<string>")).when(F.col("_once") == F.col("_size"), F.array("text")).otherwise(F.array(part))
    texts = F.concat(F.array_repeat("text", F.col("_laps").cast("int")), rest)
    out = out.where(F.col("taken") > 0).select("_doc", F.explode(texts).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")
