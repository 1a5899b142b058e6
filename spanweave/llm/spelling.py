"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Two words one inserted, deleted or replaced code point apart share the first half of the shorter one or its last half. So every
word enters blocks of the forward dictionary (by its first half) and of the reversed one (by its last half), once as the shorter
or equal word and once as the longer one. A block with many words is subdivided: what its words don't yet share is halved in
the same way, the first half being added to the common prefix or the last half to the common suffix, until a block is small
or one code point is left, where the alphabet bounds it. Pairs with the longer common prefix belong to the prefix side alone, so
each pair is met in one block. Blocks are ranges of the sorted dictionary; a scan holds one block and verifies its pairs.

A word's form is its near word of the largest count (ties: the smaller one) if that is at least `ratio` times its own; its root
is the end of the chain of forms, found by doubling jumps, since counts grow tenfold with every step.

Null texts have no words; a null doc_id counts as an empty string where words are damaged. Repeated rows count as often as they
come; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import saved

LONG, OFTEN, RATIO, MOST_WORDS, DAMAGE = 7, 2, 10, 64, 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = LONG, least_count: int = OFTEN, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of runs of letters (ASCII and Latin-1, ASCII ones in lower case). A run whose crc32 with its doc_id is divisible
    by `damage` lacks the code point at that crc32 modulo its length. Shorter runs can't become long enough, so they are not read."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_doc"), F.explode(runs).alias("_run"))
    each = each.withColumn("_h", F.crc32(F.concat("_doc", "_run").cast("binary")))
    at = F.pmod("_h", F.char_length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % damage == 0, cut).otherwise(F.col("_run"))
    return each.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of rows with m (length of the shorter words), i and j (code points of the common prefix and suffix): first the
    prefix, in the reversed dictionary the suffix, backwards, then the other one."""
    suffix = F.reverse(F.expr("right(word, j)"))
    return rows.withColumn("head", F.when(F.col("backward"), suffix).otherwise(F.expr("left(word, i)"))).withColumn("tail", F.when(F.col("backward"), F.expr("left(word, i)")).otherwise(suffix))


_BLOCK = ["backward", "head", "tail", "m", "i", "j", "below"]


def _halves(rows: DataFrame, i: Column, j: Column, below: Column) -> DataFrame:
    """The two blocks that each row's block divides into."""
    free = F.col("m") - i - j
    half = F.call_function("div", free, F.lit(2)).cast("int")
    # a pair of the second block shares less of a prefix than one of the first
    first = F.struct(F.lit(False).alias("backward"), (i + half).alias("i"), j.alias("j"), below.alias("below"))
    second = F.struct(F.lit(True).alias("backward"), i.alias("i"), (j + free - half).cast("int").alias("j"), (i + half).alias("below"))
    return _keyed(rows.select("word", "n", "m", F.explode(F.array(first, second)).alias("b")).select("word", "n", "m", "b.*"))


def blocks(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(block columns, word, n): every pair of near words is in exactly one of its common blocks that admit it (see pairs_of)."""
    length = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    now, done = _halves(start, F.lit(0), F.lit(0), F.lit(1 << 30)), None
    while True:
        now = saved(now, "blocks")
        sizes = now.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.char_length("word") == F.col("m")).alias("shorter")).where("size > 1 AND shorter > 0")
        sizes = sizes.withColumn("divide", (F.col("size") > most) & (F.col("m") - F.col("i") - F.col("j") > 1)).drop("size", "shorter")
        found = saved(now.join(sizes, _BLOCK), "blocks")
        ready = found.where("NOT divide").drop("divide")
        done = ready if done is None else done.unionByName(ready)
        large = found.where("divide")
        if large.isEmpty():
            return done
        now = _halves(large, F.col("i"), F.col("j"), F.col("below"))


def near(u: str, v: str, known: int, below: int) -> bool:
    """Whether v, as long as u or one longer, is one edit from u, and their common prefix shorter than `below`."""
    n = len(u)
    while known < n and u[known] == v[known]:
        known += 1
    if known >= below:
        return False
    if len(v) > n:
        return u[known:] == v[known + 1 :]
    return known < n and u[known + 1 :] == v[known + 1 :]


def pairs_of(words: list[tuple[str, int]], m: int, i: int, below: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its count), both ways, of a block's words of m code points with each other and with longer ones."""
    short, long = [x for x in words if len(x[0]) == m], [x for x in words if len(x[0]) > m]
    for k, (u, n) in enumerate(short):
        for v, of in (*short[k + 1 :], *long):
            if near(u, v, i, below):
                yield u, v, of
                yield v, u, n


def links(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, near, near_n): each pair of near words both ways, once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, out = None, [], []
        for batch in batches:
            for head, tail, backward, m, i, j, below, word, n in zip(*(batch[c].to_pylist() for c in ("head", "tail", "backward", "m", "i", "j", "below", "word", "n")), strict=True):
                if (key := (head, tail, backward, m, i, j, below)) != block:
                    if len(own) > 1:
                        out += pairs_of(own, block[3], block[4], block[6])
                    block, own = key, []
                own.append((word, n))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if len(own) > 1:
            out += pairs_of(own, block[3], block[4], block[6])
        yield _rows(out)

    dictionary = blocks(words, most)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = dictionary.repartitionByRange(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "word")
    return dictionary.mapInArrow(scan, "word string, near string, near_n long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])


def spelling_groups(words: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """Of (word, n): word, form, root, n, n_near and form_n."""
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = links(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    chosen = words.join(found, "word", "left").withColumn("_n", -F.col("best.less"))
    is_form = F.col("_n") >= F.col("n") * ratio
    out = saved(chosen.select("word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("_n")).alias("form_n")), "forms")
    jumps = saved(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "jumps")
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if jumps.join(on, "root", "left_semi").isEmpty():
            break
        jumps = saved(jumps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "jumps")
    return out.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """The groups of the words of documents."""
    return spelling_groups(vocabulary(docs), **options)
