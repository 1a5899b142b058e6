"""N-gram Jaccard join: MinHash bands for candidates, Bayesian pruning of pairs, exact verification of the rest.

1. Every text becomes its set of hashed shingles (five lower-case words in a row; all words of a shorter text), and sets
   become MinHash values. Texts with equal sets are copies: only one of them goes on, with the number of copies.
2. Texts that agree in a whole band of MinHash values share a bucket. A bucket links its members to its smallest one only,
   so the number of links is linear, and the components of these links hold every candidate pair.
3. In each component all pairs are compared inside tasks, cell by cell: a cell is two blocks of a component, of a bounded
   number of shingles (small components share a cell). MinHash values are compared a few at a time; a pair is dropped once
   the posterior probability that its similarity reaches the threshold, for a uniform prior, falls below `tolerance`.
   Pairs that are left are verified exactly on the sets. A cell returns a row per text: the number of its links, and the
   smallest text that it is connected to in the cell - never a row per pair.
4. Classes are the components of the verified links.

With 42 bands of 6 values a pair at similarity 0.8 shares no bucket with probability 3e-6 (less above), and pruning loses
it with a probability near `tolerance`; no other link is lost, and none is added that isn't verified.

Null and empty texts, and texts of white space, have the empty set: copies of each other. Rows with a null doc_id take part;
a class's id is the smallest doc_id in it (null if all are null). Repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.arrow import small_batches
from spanweave.llm.graph import components
from spanweave.session import saved

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 42, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def shingles(text: str, n: int = WORDS, hashes: _WordHashes | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams. hashes: a store of words that calls may share."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map((_WordHashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    n = min(n, len(own))
    out = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + own[k : len(own) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size, np.uint32)


_A, _B = _family(BANDS * ROWS)


def minhash(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values (32 bits) of a set; of the empty set, the largest values."""
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    low = (own >> np.uint64(16)).astype(np.uint32)
    for a in range(0, len(low), 512):
        np.minimum(out, (low[a : a + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, different for equal values in different bands."""
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _BASE
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def needed_matches(threshold: float, tolerance: float, sizes: list[int]) -> dict[int, int]:
    """For n compared values the fewest matches m at which P(similarity >= threshold | m of n) reaches the tolerance."""
    out = {}
    for n in sizes:
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # the Beta posterior as a binomial sum
            if total >= tolerance:
                out[n] = m
                break
    return out


def compare(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray, threshold: float, need: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners j > i) whose similarity reaches the threshold; with two sides, only pairs across them."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets) if n else np.empty(0, np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    of = [codes[e - s : e] for e, s in zip(ends, sizes, strict=True)]
    marked = np.zeros(len(codes) + 1, bool)
    two = side.any() and not side.all()
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if two:
            rest = rest[side[rest] != side[i]]
        matches, done = np.zeros(len(rest), np.int32), 0
        for upto, least in need.items():
            if not len(rest):
                break
            matches += (signatures[rest, done:upto] == signatures[i, done:upto]).sum(axis=1, dtype=np.int32)
            going = matches >= least
            rest, matches, done = rest[going], matches[going], upto
        if not len(rest):
            continue
        marked[of[i]] = True
        if len(rest) > 32 and sizes[rest].all():
            first = rest[0]
            base = ends[first] - sizes[first]
            common = np.add.reduceat(marked[codes[base:]], ends[first:] - sizes[first:] - base)[rest - first] if sizes[first:].all() else np.array([np.count_nonzero(marked[of[j]]) for j in rest])
        else:
            common = np.array([np.count_nonzero(marked[of[j]]) for j in rest])
        marked[of[i]] = False
        union = sizes[i] + sizes[rest] - common
        hit = rest[common >= threshold * union - 1e-9]
        if len(hit):
            yield i, hit


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, place (a hash of the text), key (of the shingle set), n (shingles) and bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()  # ends with the task
        for pdf in batches:
            rows = []
            for doc, place, text in zip(pdf["doc_id"], pdf["place"], pdf["text"], strict=True):
                own = shingles(text, hashes=hashes)
                rows.append((doc, place, _key(own), len(own), bands(minhash(own)) if len(own) else np.empty(0, np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "key", "n", "bands"])

    texts = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "xxhash64(coalesce(text, '')) AS place", "coalesce(text, '') AS text")
    return texts.mapInPandas(run, "doc_id string, place long, key binary, n long, bands array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _may_hold(texts: DataFrame, family: DataFrame, most_bits: int = 1 << 24) -> DataFrame:
    """The rows of texts whose doc_id and place are in the family, and few others: a bitmap of their hashes, of at most most_bits bits
    (a broadcast table of most_bits / 64 rows at most), so that other texts needn't be sent to the join after it. A full
    bitmap lets all pass."""
    bits = min(most_bits, 1 << max(10, (16 * family.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "place"), F.lit(bits))
    bitmap = family.select(place.alias("_p")).groupBy(F.expr("_p div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_p % 64 as int)))").alias("_bits"))
    held = texts.withColumn("_p", place).withColumn("_word", F.expr("_p div 64")).join(F.broadcast(bitmap), "_word")
    return held.where(F.expr("(shiftrightunsigned(_bits, cast(_p % 64 as int)) & 1) = 1")).drop("_word", "_bits", "_p")


def _key(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (other documents at or above the threshold, copies included) and
    copies (documents with the same shingle set, itself included)."""
    return _classified(docs, **settings).select("doc_id", "class_id", "n_links", "copies")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The columns of docs, one row of each class: that with the smallest doc_id (null last), then text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "place"))
    kept = _classified(docs, **settings).groupBy("class").agg(first.alias("k")).select("k.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("place"))
    return rows.join(kept, ["none", "id", "place"]).dropDuplicates(["none", "id", "place"]).select("row.*")


def _classified(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = 1e-5, block_shingles: int = 1 << 20, block_texts: int = 1024) -> DataFrame:
    """doc_id, place, class (a key), class_id, n_links and copies of every document."""
    small_batches(docs.sparkSession)
    sketch = saved(_sketches(docs), "sketch")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "place"))  # one row stands for the set
    sets = saved(sketch.groupBy("key").agg(one.alias("one"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "sets")

    # Nodes are 64-bit: keys that meet in one node only share a family, whose pairs are verified.
    member = sets.select(F.xxhash64("key").alias("node"), F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").drop("last")
    near = components(member.join(shared, "bucket").select(F.col("node").alias("a"), "b"))
    family = saved(near.join(sets.drop("bands", "doc_id").withColumn("node", F.xxhash64("key")), "node").drop("node").select("*", "one.*").drop("one"), "families")

    size = family.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("mass"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("texts") / block_texts), F.ceil(F.col("mass") / block_shingles), F.lit(1)).cast("int"))
    small_mass = size.where("blocks = 1").agg(F.coalesce(F.sum("mass"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    bins = max(1, math.ceil(small_mass[0] / block_shingles), math.ceil(small_mass[1] / block_texts))
    family = family.join(size.select("component", "blocks"), "component")

    need = needed_matches(threshold, tolerance, list(range(28, BANDS * ROWS + 1, 28)))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for pdf in batches:
            own = [shingles(t, hashes=hashes) for t in pdf["text"]]
            right = [_key(s) == k for s, k in zip(own, pdf["key"], strict=True)]
            out = pdf.drop(columns="text").assign(shingles=[s.tobytes() for s in own], signature=[minhash(s).tobytes() for s in own])
            yield out[right]

    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text")).withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    held = _may_hold(texts, family.withColumn("doc_id", F.col("id"))).dropDuplicates(["none", "id", "place"])  # repeated rows are one text
    joined = held.join(family, ["none", "id", "place"]).select("key", "component", "copies", "blocks", "text")
    loaded = joined.mapInPandas(load, "key binary, component long, copies long, blocks int, shingles binary, signature binary")
    loaded = loaded.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = loaded.select("*", other).select("key", "component", "copies", "shingles", "signature", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"), F.when(F.col("blocks") > 1, F.col("component")).alias("large"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, one in pdf.groupby("component", sort=False):
            one = one.drop_duplicates("key")
            keys, copies = one["key"].tolist(), one["copies"].to_numpy()
            sets_ = [np.frombuffer(s, np.uint64) for s in one["shingles"]]
            signatures = np.stack([np.frombuffer(s, np.uint32) for s in one["signature"]])
            side = (one["block"] != one["i"]).to_numpy()
            links, parent = np.zeros(len(keys), np.int64), list(range(len(keys)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            if one["i"].iloc[0] == one["j"].iloc[0] or side.any() and not side.all():
                for i, hit in compare(sets_, signatures, side, threshold, need):
                    links[i] += copies[hit].sum()
                    links[hit] += copies[i]
                    for j in hit:
                        a, b = root(i), root(int(j))
                        if a != b:
                            parent[max(a, b, key=keys.__getitem__)] = min(a, b, key=keys.__getitem__)
            rows += [(k, int(n), keys[root(x)]) for x, (k, n) in enumerate(zip(keys, links, strict=True))]
        return pd.DataFrame(rows, columns=["key", "links", "root"])

    verified = saved(cells.groupBy("large", "bin", "i", "j").applyInPandas(verify, "key binary, links long, root binary"), "verified")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(verified.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    found = sets.select("key", "doc_id", "copies").join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key"))
    found = saved(found.select("key", "doc_id", "class", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    ids = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    found = found.join(ids, "class").select("key", "class", "class_id", "n_links", "copies")
    return sketch.select("doc_id", "place", "key").join(found, "key").drop("key")
