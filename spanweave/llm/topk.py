"""Exact top-k inner products by norm buckets: candidates are grouped by length, each bucket is pruned by coordinates or by
length as its local cosine threshold says, and what is left is verified with whole products.

1. Components become integers floor(scale * x); vectors that are null or hold a null or non-finite component take no part.
   Vectors of different dimension are compared as if the shorter one ended in zeros.
2. The `seeds` longest vectors (a bounded broadcast) give every query a first lower bound of its k-th score.
3. Candidates fall into buckets of similar length, buckets into blocks of at most about `block` rows, packed as one row each;
   queries are packed in blocks too. A cell is a block of queries and a block of candidates. Cells in which no query can reach
   its bound (|q| * longest candidate) are dropped before their vectors are sent anywhere.
4. In a cell, query q with bound t has the local threshold c = t / (|q| * longest). Above 1 the bucket is skipped. From
   COSINE on, coordinates prune: a candidate at cosine c or more lies, in each of the query's largest coordinates f, within
   q_f c +- sqrt((1 - c^2) (1 - q_f^2)). Below, length prunes: candidates shorter than t / |q| are skipped. The survivors'
   products are computed whole, in doubles where they are exact (|q| |p| < 2^53), else in Python's integers.
5. Each cell keeps its k best per query, and a window per query keeps the k best of all. Ties go to the smaller vec_id.

Products are exact at any size. A score beyond a long is returned as the nearest long (plus or minus 2^63 - 1); such scores
are ranked by their doubles (up to 10^300), then by vec_id.

Rows with a null vec_id are no queries; as candidates they would have no name, so they take no part. A query is no candidate
for itself: rows of its vec_id are left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import saved

COSINE, FOCUS = 0.5, 3
END = (1 << 63) - 1
FAR = 1e150  # lengths beyond it count as this long, so that products of two lengths stay finite


def integers(vector: str, scale: float) -> Column:
    """array<double> of the integers floor(scale * x), or null if the vector or a component is null or not finite (a finite
    one whose product with the scale is beyond the doubles counts as not finite). From 2^53 on every double is an integer."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    v = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(F.when(F.abs(y) < 2.0**53, y)).cast("double")).otherwise(y))
    finite = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), v)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    most = np.abs(m).max(axis=1, initial=0.0)
    return np.minimum(most * np.sqrt(np.square(m / np.maximum(most, 1.0)[:, None]).sum(axis=1)) if m.shape[1] else most, FAR)


def _double(score: int) -> float:
    """The score as a double, which keeps the order (up to 10^300)."""
    return float(max(-(10**300), min(int(score), 10**300)))


def products(q: np.ndarray, p: np.ndarray, q_norm: float, p_norm: float) -> np.ndarray:
    """Exact inner products of rows of q and p."""
    if q_norm * p_norm < 2.0**53:
        return (q @ p.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q], dtype=object).reshape(len(q), len(p))


def prune(q: np.ndarray, bound: float, q_norm: float, unit: np.ndarray, norms: np.ndarray, cosine: float = COSINE, focus: int = FOCUS) -> np.ndarray:
    """Candidates (positions; norms descending) that may reach the bound. unit: candidates at length 1."""
    if not len(norms) or bound == -math.inf or q_norm == 0 or norms[0] == 0 or max(q_norm, norms[0]) >= FAR:
        return np.arange(len(norms))
    local = bound / (q_norm * norms[0])
    if local > 1 + 1e-9:
        return np.empty(0, np.int64)
    if local < cosine:
        return np.arange(np.searchsorted(-norms, -(bound / q_norm) * (1 - 1e-9), "right")) if bound > 0 else np.arange(len(norms))
    c, u = min(1.0, local) - 1e-9, q / q_norm
    keep = np.ones(len(norms), bool)
    for f in np.argsort(-np.abs(u))[:focus]:
        width = math.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - u[f] ** 2)) + 1e-7
        keep &= np.abs(unit[:, f] - u[f] * c) <= width if c >= abs(u[f]) else unit[:, f] * np.sign(u[f]) >= abs(u[f]) * c - width
    return np.flatnonzero(keep & (norms * q_norm >= bound * (1 - 1e-9)))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(np.float64 if scores.dtype == object else np.int64)))][:k] if scores.dtype != object else np.array(sorted(at, key=lambda i: (-scores[i], ids[i]))[:k], int)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector: str = "embedding", growth: float = 1.05, block: int = 8192, query_block: int = 4096, seeds: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row that is_query holds for, its k best other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(vector, scale).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    norm = F.least(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(FAR))
    rows = saved(rows.withColumn("norm", norm).withColumn("bucket", F.when(F.col("norm") < 1, F.lit(0)).otherwise(F.floor(F.log("norm") / math.log(growth)) + 1).cast("int")), "vectors")
    longest = rows.orderBy(F.col("norm").desc(), "id").limit(seeds).select("id", "v").collect()  # at most `seeds` vectors
    seed_ids, seed_rows = np.array([r["id"] for r in longest], np.int64), [r["v"] for r in longest]

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            width = max([0, *map(len, pdf["v"]), *map(len, seed_rows)])
            q, p = _matrix(pdf["v"].tolist(), width), _matrix(seed_rows, width)
            scores = products(q, p, _norms(q).max(initial=0), _norms(p).max(initial=0))
            out = []
            for i, own in zip(range(len(q)), pdf["id"], strict=True):
                mine = np.sort(scores[i][seed_ids != own])
                out.append(_double(mine[-k]) if len(mine) >= k else -math.inf)
            yield pdf[["id", "v", "norm"]].assign(bound=out)

    queries = rows.where("q").select("id", "v", "norm").mapInPandas(bounds, "id long, v array<double>, norm double, bound double")
    n_queries = max(1, math.ceil(rows.where("q").count() / query_block))
    queries = saved(queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int")), "queries")

    sizes = rows.groupBy("bucket").count().withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("count") / block)).cast("int")).drop("count")
    candidates = rows.join(F.broadcast(sizes), "bucket")  # as many rows as there are lengths, in steps of the growth
    candidates = candidates.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("bucket", "part", "id", "v", "norm")

    tops = candidates.groupBy("bucket", "part").agg(F.max("norm").alias("longest"))
    reach = queries.groupBy("qb").agg(F.max(F.when((F.col("norm") > 0) & (F.col("norm") < FAR), -F.col("bound") / F.col("norm")).otherwise(F.lit(math.inf))).alias("ease"))
    # A cell stays if some query q of its block has |q| * longest >= bound, that is longest >= min(bound / |q|), or a length is FAR.
    spread = tops.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    cells = saved(spread.join(reach, "qb").where((F.col("longest") * (1 + 1e-9) + 1e-9 >= -F.col("ease")) | (F.col("longest") >= FAR)).select("qb", "bucket", "part"), "cells")

    member = F.struct("id", "v")
    packed = candidates.join(cells, ["bucket", "part"]).groupBy("qb", "bucket", "part").agg(F.collect_list(member).alias("candidates"))
    asked = queries.join(cells, "qb").groupBy("qb", "bucket", "part").agg(F.collect_list(F.struct("id", "v", "bound")).alias("asked"))
    pairs = packed.join(asked, ["qb", "bucket", "part"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cands, asks in zip(pdf["candidates"], pdf["asked"], strict=True):
                width = max(max(len(c["v"]) for c in cands), max(len(a["v"]) for a in asks))
                p, q = _matrix([c["v"] for c in cands], width), _matrix([a["v"] for a in asks], width)
                norms = _norms(p)
                order = np.argsort(-norms, kind="stable")
                p, norms, ids = p[order], norms[order], np.array([c["id"] for c in cands], np.int64)[order]
                unit, q_norms, out = p / np.maximum(norms, 1e-300)[:, None], _norms(q), []
                for i, ask in enumerate(asks):
                    at = prune(q[i], ask["bound"], q_norms[i], unit, norms)
                    at = at[ids[at] != ask["id"]]
                    if len(at):
                        scores = products(q[i : i + 1], p[at], q_norms[i], norms[0])[0]
                        best = best_of(ids[at], scores, k)
                        out.append(pd.DataFrame({"query_id": ask["id"], "vec_id": ids[at][best], "score": [max(-END, min(int(s), END)) for s in scores[best]], "about": [_double(s) for s in scores[best]]}))
                if out:
                    yield pd.concat(out)

    found = pairs.select("candidates", "asked").mapInPandas(verify, "query_id long, vec_id long, score long, about double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("about").desc(), F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.coalesce(F.pmod("vec_id", F.lit(100)) == 0, F.lit(False)))


#: DuckDB SQL for the rows of topk_digest() (all products; exact while they are below 2^53).
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM r WHERE rank <= 10
"""
