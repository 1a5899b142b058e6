import zlib

import numpy as np

from spanweave.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    values = [rng.random(4) for _ in rows]
    y = np.where(rng.random(60) < 0.5, 1, -1)
    w, b = Q.dual_coordinate_descent(rows, values, y, 12, 0.7, epochs=400)

    def loss(w, b):
        return (w @ w + b * b) / 2 + 0.7 * sum(max(0, 1 - t * (w[r] @ v + b)) for r, v, t in zip(rows, values, y))

    at = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.02, 12), b + rng.normal(0, 0.02)) >= at - 1e-4


def test_ratio_by_hand():
    r = Q.log_count_ratio([np.array([0]), np.array([0, 1]), np.array([1])], np.array([1, 1, -1]), 2)
    p, q = np.array([3, 2]) / 5, np.array([1, 2]) / 3
    assert np.allclose(r, np.log(p / q))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.score_digest(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    up, down = [s for s, q in truth if q == 1], [s for s, q in truth if q == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in up for b in down])
    right = np.mean([(s >= 0.7) == q for s, q in truth])
    print("AUC", auc, "accuracy", right, len(up), len(down))
    assert auc > 0.9 and right > 0.9


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int"
    rows = [(1, None, "a", "b", 0, 1), (None, "x y", "a", None, 3, 1), (3, "", None, None, 0, 1), (4, "word " * 50_000, "a", "b", 9, 1), (4, "word", "a", "b", 4, 1)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in Q.score_digest(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in Q.score_digest(docs, one).collect()}) == 1
    both = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.keep_good(docs, both, 0.0).columns == docs.columns and Q.keep_good(docs, both, 0.0).count() == 5
    assert Q.score_digest(docs.limit(0), both).count() == 0
