import math
import re

from spanweave.llm import licenses as L

LONG = " ".join(f"w{i}" for i in range(300))
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    None,
    "",
    "x Under THE mit-license. under the mit license, and Apache License, Version 2.0",
    "CC BY-NC; cc by ncx; K cc\nby\tnc",
    f"{LONG} {MIT} {LONG}",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the mitlicense apache version license",
    "under the mitlicense apache version license",
    "éa 1b",
]


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = sorted((i, label) for label, p in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels, score = set(), 0.0
    for b in range(0, max(1, math.ceil(len(words) / L.STRIDE))):
        block = set(words[b * L.STRIDE : b * L.STRIDE + L.BLOCK])
        for label, t in L.TEMPLATES:
            own = set(t.split())
            if len(own & block) >= math.ceil(L.THRESHOLD * len(own)):
                labels.add(label)
                score = max(score, len(own & block) / len(own))
    base = sorted({x for _, x in hits})
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(base), ",".join(sorted(labels | set(base))), 1.0 if base else score


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    for r in L.license_digest(docs).collect():
        want = brute(TEXTS[r.doc_id])
        assert tuple(r)[1:7] == want[:6], (r, want)
        assert abs(r.score - want[6]) < 1e-12


def test_random_blocks_against_brute_force(spark):
    import random

    rng = random.Random(5)
    pool = sorted({w for _, t in L.TEMPLATES for w in t.split()}) + ["a1", "b2", "é"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += [" ".join([*rng.sample(pool, 20), *rng.sample(t.split(), len(t.split()) - rng.randint(0, 4)), *rng.sample(pool, 20)]) for _, t in L.TEMPLATES for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.license_digest(docs).collect():
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:7] == want[:6] and abs(r.score - want[6]) < 1e-12


def test_empty_table(spark):
    assert L.license_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
