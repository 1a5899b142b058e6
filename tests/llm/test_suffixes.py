import hashlib
import random
from collections import Counter

import pytest

from spanweave.llm import suffixes as S

SCHEMA = "doc_id long, text string, kept_sha256 string"


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + least] for d in data for p in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - least + 1):
            if seen[d[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, least, n):
    letters = "abcdeé \n"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    bases = [text(rng.randint(least, 12 * least)) for _ in range(6)]
    out = [None, "", "a", "a" * (5 * least), "ab" * (3 * least), text(least // 2), "a" * (2 * least)]
    for _ in range(n):
        kind = rng.randrange(6)
        base = rng.choice(bases)
        if kind == 0:
            out.append(base)
        elif kind == 1:
            chars = list(base)
            for _ in range(rng.randint(1, 4)):
                chars[rng.randrange(len(chars))] = rng.choice("XYZ")
            out.append("".join(chars))
        elif kind == 2:
            a = rng.randrange(len(base))
            out.append(text(rng.randint(0, 3 * least)) + base[a : a + rng.randint(least - 3, least + 40)] + text(rng.randint(0, 3 * least)))
        elif kind == 3:
            other = rng.choice(bases)
            out.append(base[: rng.randrange(len(base))] + other[rng.randrange(len(other)) :])
        elif kind == 4:
            out.append(base[-least - 7 :] + base[: least + 5])
        else:
            out.append(text(rng.randint(1, 6 * least)))
    return out


@pytest.mark.parametrize(("seed", "least", "options"), [(1, 40, {}), (2, 24, {"run_bytes": 9000, "part_bytes": 700}), (3, 64, {"run_bytes": 20000, "part_bytes": 3000, "most_contexts": 1}), (4, 17, {"run_bytes": 4000, "part_bytes": 400})])
def test_against_all_strings(spark, seed, least, options):
    texts = corpus(random.Random(seed), least, 150)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    rows = sorted(S.suffix_dedup_digest(docs, least, **options).collect())
    assert [tuple(r)[1:] for r in rows] == brute(texts, least)
    assert sum(r.n_removed for r in rows) > 0


def test_kept_bytes_and_rows(spark):
    long = "".join(random.Random(9).choice("abcdef ") for _ in range(900))
    docs = spark.createDataFrame([(None, long, "x"), (None, long, "x"), (7, "é" + long[100:700] + "z", "x"), (7, None, None)], SCHEMA)
    out = S.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()) == [(0, 0, b""), (603, 600, "éz".encode()), (900, 900, b""), (900, 900, b"")]
    assert S.suffix_dedup_digest(docs.limit(0)).collect() == []


def test_tree_of_losers(monkeypatch):
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    runs = []
    for k in range(5):
        own = sorted((w, k.to_bytes(16, "big"), i, b"") for i, w in enumerate(words[k::5]))
        lengths = [0, *(S.shared(a[0], b[0]) for a, b in zip(own, own[1:], strict=False))]
        data = S.encode(own[:20], lengths[:20]), S.encode(own[20:], [0, *lengths[21:]])
        runs.append(S._run_items(list(data)))
    compared, real = [], S.shared
    monkeypatch.setattr(S, "shared", lambda a, b, known=0: compared.append(known) or real(a, b, known))
    merged = list(S.merge_runs(runs))
    assert [x[0] for _, x in merged] == sorted(words)
    for (_, a), (n, b) in zip(merged, merged[1:], strict=False):
        assert n == real(a[0], b[0])
    assert len(compared) < 5 * len(words)
