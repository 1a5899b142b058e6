"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features are indicators of word 1- and 2-grams, of 1- to 3-grams of word shapes (letters, capitals, digits and signs, runs
collapsed) and of 1- to 4-grams of whether a word repeats the one before it, hashed to DIM places. Each is scaled by the log ratio of its smoothed shares in the two classes, rows to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become scores between 0 and 1 by a logistic
curve fitted to margins of held-out folds of the training sample.

Training takes a sample of at most about `most` labelled rows (by hash of doc_id; documented bound), whose features alone reach
the driver; scoring sees every whole text, in place, with a model of fixed size. Labels, language, source and ids are never
inputs. Null and empty texts have no features and get the score of the intercept. Without labels every score is 0.5, with labels
of one class the (smoothed) share of label 1. Conflicting labels of one document count as the lower one. Repeated rows, ties and
extra columns have no effect on other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.arrow import small_batches

DIM, MOST, THRESHOLD = 1 << 18, 4000, 0.7


def shape(word: str) -> str:
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class _Codes(dict):
    """Word -> its hash and its shape's hash in one integer, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = crc32(word.lower().encode("utf-8", "surrogatepass")) << 31 | crc32(shape(word).encode("utf-8", "surrogatepass")) >> 1
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, dim: int = DIM, codes: _Codes | None = None) -> np.ndarray:
    """Sorted numbers of the features that the text has. codes: a store of words that calls may share."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32)
    own = np.fromiter(map((_Codes() if codes is None else codes).__getitem__, words), np.uint64, len(words))
    word, form = own >> np.uint64(31), own & np.uint64(0x7FFFFFFF)
    out = []
    again = (word[1:] == word[:-1]).astype(np.uint64)
    for family, own, most in ((1, form, 3), (2, word, 2), (3, again, 4)):
        grams = np.zeros(len(own), np.uint64)
        for n in range(1, most + 1):
            if len(own) < n:
                break
            grams = (grams[: len(own) - n + 1] + own[n - 1 :]) * _MIX + np.uint64(10 * family + n)
            bits = grams ^ grams >> np.uint64(32)
            out.append(np.unique(bits * _MIX >> np.uint64(40)) if family != 2 else bits * _MIX >> np.uint64(40))
    return np.unique(np.concatenate(out) & np.uint64(dim - 1)).astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + base))); weights hold ratio * weight, so a margin takes two sums."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    base: float

    def margin(self, own: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[own], dtype=np.float64).sum()))
        return (float(self.weights[own].sum(dtype=np.float64)) / norm if norm else 0.0) + self.bias

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(own) + self.base, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dim: int, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(dim, smooth), np.full(dim, smooth)
    for own, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[own] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: float, epochs: int = 10, seed: int = 5) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum of hinge losses; the last coordinate is the bias, whose feature is always 1."""
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the curve, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, dim: int = DIM, cost: float = 1.0, folds: int = 4) -> Model:
    """y: 1 and -1."""
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dim, np.float32), np.zeros(dim, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def one(at: np.ndarray) -> Model:
        own, labels = [rows[i] for i in at], y[at]
        ratio = log_count_ratio(own, labels, dim)
        values = [ratio[r] / (np.linalg.norm(ratio[r]) or 1.0) for r in own]
        w, bias = dual_coordinate_descent(own, values, labels, dim, cost)
        return Model(ratio.astype(np.float32), (ratio * w).astype(np.float32), bias, 1.0, 0.0)

    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        rest, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(out) and (y[rest] > 0).any() and (y[rest] < 0).any():
            part = one(rest)
            margins[out] = [part.margin(rows[i]) for i in out]
    model = one(np.arange(len(y)))
    model.slope, model.base = _logistic(margins, y)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(column: Column, share: float, seed: int) -> Column:
    """Whether a 63-bit hash falls within the share, which may be as small as one in billions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 1) < F.lit(min(int(share * 2**63), 2**63 - 1)).cast("long")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, seed: int = 11) -> Model:
    """From labelled rows that aren't held out. Those sampled are few by their number, so they are the broadcast side."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality").where("_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("_id"))
    known = known.groupBy("_id").agg(F.min("quality").alias("_quality"))
    share = min(1.0, most / max(1, known.count()))
    sample = known if share == 1 else known.where(sampled(F.col("_id"), share, seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for pdf in batches:
            yield pdf[["_id", "_quality"]].assign(features=[features(t, codes=codes).tobytes() for t in pdf["text"]])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "_id").mapInPandas(run, "_id long, _quality int, features binary")
    rows = found.groupBy("_id", "_quality").agg(F.min("features").alias("features")).collect()  # a row per label: at most about `most`, however often an id occurs
    rows = sorted((r["_id"], bytes(r["features"]), r["_quality"]) for r in rows)
    return fit_rows([np.frombuffer(f, np.int32) for _, f, _ in rows], np.array([1 if q == 1 else -1 for *_, q in rows]))


def score_column(model: Model, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = _Codes()  # ends with the task
        for texts in batches:
            yield pd.Series([model.score(features(t, codes=codes)) for t in texts])

    return score(F.coalesce(F.col(text), F.lit("")))


def score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(train(docs, labels)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs. Without labels of both classes there is
    nothing to tell documents apart by, so all stay."""
    names, model = docs.columns, train(docs, labels)
    if model.slope == 0:
        return docs
    scored = docs.select(F.struct(*names).alias("_row"), score_column(model).alias("_score"))
    return scored.where(F.col("_score") >= threshold).select("_row.*")
