import random
import re
from collections import Counter, defaultdict

from spanweave.llm import mixing as M


def rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", None, "é"])
        text = None if rng.random() < 0.05 else " \t".join(["w"] * rng.choice([0, 1, 5, 50, 300]))
        data.append((i, text, "en", source, 7, "extra"))
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string")


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3.0 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3.0 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


def test_targets_taken_and_reruns(spark):
    data, docs = rows(spark)
    got = M.mix_digest(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_digest(docs.repartition(5)).collect()))
    of = {d[0]: d for d in data}
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    want, taken = targets(sizes), Counter()
    assert len(got) == len(data)
    for r in got:
        source = of[r.doc_id][3]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", of[r.doc_id][1] or "")) and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4 * 64


def test_documents_hold_what_is_taken(spark):
    data, docs = rows(spark, 300, 8)
    taken = {r.doc_id: r.taken for r in M.mix_digest(docs).collect()}
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    found = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        found[r.doc_id] += len(r.text.split())
    assert found == Counter({k: v for k, v in taken.items() if v})


def test_small_sources_meet_their_targets(spark):
    data = [(1, " ".join(["a"] * 10), "a"), (2, " ".join(["b"] * 2000), "b"), (3, " ".join(["c"] * 21), "c"), (3, " ".join(["d"] * 21), "d"), (3, "x y", "d"), (None, "one", "e"), (None, " ".join(["z"] * 50), "f")]
    data += [(100 + i, " ".join(["g"] * 333), "g") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    for r in M.mixed_documents(docs).collect():
        taken[r.source] += len(r.text.split())
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= max(1, 0.01 * want), (s, taken[s], want)


def test_reruns_agree_on_repeated_ids(spark):
    data = [(i % 3 if i % 4 else None, f"w{i} " * 40, "s" if i % 5 else "t") for i in range(200)]
    schema = "doc_id long, text string, source string"
    one = M.mixed_documents(spark.createDataFrame(data, schema)).collect()
    assert Counter(one) == Counter(M.mixed_documents(spark.createDataFrame(data[::-1], schema).repartition(7)).collect())


def test_apportionment_against_one_by_one(spark):
    rng = random.Random(1)
    items, want = [], {}
    for g in range(30):
        w = [rng.choice([0, 1, 3, 10, 1000, 77777]) * rng.random() for _ in range(rng.randint(1, 12))]
        n, q = rng.randint(0, 300), [0] * len(w)
        for _ in range(n if sum(w) else 0):
            k = max(range(len(w)), key=lambda k: (w[k] / (2 * q[k] + 1), -k))
            q[k] += 1
        for k, x in enumerate(w):
            items.append((g, k, x, n))
            want[g, k] = q[k]
    df = spark.createDataFrame(items, "g int, k int, w double, n long")
    assert {(r.g, r.k): r.quota for r in M.apportion(df, "g", "w", "n", "k").collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_digest(docs).count() == 0 and M.mixed_documents(docs).count() == 0
