import random
from collections import defaultdict

from spanweave.llm import graph, jaccard as J


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, parent = [0] * len(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) / union >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(i, root(i), links[i]) for i in range(len(texts))]


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    texts = [None, "", "  \n", "one two", "One  two", "a b c d e", "x" * 100_000]
    for _ in range(25):
        base = text(rng.choice([8, 60, 300]))
        texts += [base, base]
        for _ in range(rng.randint(0, 6)):
            w = base.split()
            for _ in range(rng.choice([1, 2, 5, len(w) // 20 + 1])):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    base = text(200)
    texts += [base + f" t{i}" for i in range(120)]
    passage = text(100)
    texts += [passage + " " + text(100) for _ in range(10)] + [text(50) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def test_against_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    want = brute(texts)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()) == want
    small = J.jaccard_join(docs.repartition(3), block_texts=7, block_shingles=2000)  # many blocks a component
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in small.collect()) == want


def test_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f g"), (None, "q"), (3, "a b c d e f g"), (3, "a b c d e f g")]
    got = J.jaccard_join(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [("3", "3", 2), ("3", "3", 2), ("None", "3", 2), ("None", "None", 0)]
    assert J.jaccard_join(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_needed_matches():
    need = J.needed_matches(0.8, 1e-5, [28, 252])
    assert 8 < need[28] < 20 and 150 < need[252] < 190


def test_one_row_of_each_class_stays(spark):
    schema = "doc_id long, text string, row string"
    rows = [(None, "a b c d e f g", "x"), (None, "q", "y"), (None, "q", "y"), (3, "a b c d e f g", "z"), (3, "other words", "w"), (3, "other words", "w"), (9, None, "n"), (8, "", "n")]
    kept = J.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.text, r.row) for r in kept) == sorted([("None", "q", "y"), ("3", "a b c d e f g", "z"), ("3", "other words", "w"), ("8", "", "n")])
