import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanweave.llm import packing as P

DIRECT = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
OURS = P.WordIds(public_tokenizers.path(P.TOKENIZER), most=500)


def ids(text):
    return DIRECT.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!&'sdItreΣς<|>endoftxéÉǅ1२´́\x1c\x85  İK"), st.characters(codec="utf-8")), max_size=60))
def test_ids_by_word_are_the_ids_of_the_text(text):
    assert np.frombuffer(OURS(text), "<u4").tolist() == ids(text)


def test_more_words_than_the_store_holds():
    text = " ".join(f"word{i}, w{i}x." for i in range(2000)) + " <|endoftext|>. don't!"
    assert np.frombuffer(OURS(text), "<u4").tolist() == ids(text)


def used(groups):
    out = Counter()
    for lengths, n in groups:
        for v in lengths:
            out[v] += n
    return out


def test_plans_use_everything_and_fit():
    rng = random.Random(2)
    for case in range(12):
        cap = rng.choice([16, 64, 2048])
        counts = Counter(rng.choice([rng.randint(1, cap), min(cap, int(rng.expovariate(8 / cap)) + 1)]) for _ in range(rng.choice([1, 30, 3000])))
        if case == 0:
            counts[5] = 10**6
        groups = P.plan_sequences(dict(counts), cap, grid=rng.choice([1, 8]), rounds=200)
        assert used(groups) == counts and all(sum(v) <= cap for v, _ in groups)
        bound = -(-sum(v * n for v, n in counts.items()) // cap)
        if sum(counts.values()) == 3000:
            assert sum(n for _, n in groups) <= 1.15 * bound + 2
    assert P.plan_sequences({}, 2048) == []


def test_knapsack_against_all_subsets():
    rng = random.Random(4)
    for _ in range(40):
        w = np.array(sorted(rng.sample(range(1, 12), 4)))
        v = np.array([rng.random() for _ in w])
        got = sum(v[k] * n for k, n in P.best_configuration(w, v, 17).items())
        best = max(sum(a * b for a, b in zip(v, ns)) for ns in np.ndindex(18, 18, 18, 18) if sum(a * b for a, b in zip(w, ns)) <= 17) if _ < 2 else got
        assert abs(got - best) < 1e-9


def test_pack(spark):
    rng = random.Random(6)
    texts = [None, "", "one two", "one two", " ".join(f"w{i}" for i in range(3000))] + [" ".join(rng.choice(["the", "and", "xyzzy."]) for _ in range(rng.randint(0, 1500))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    got = P.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        want = [*ids(t or ""), 0]
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = want[2048 * k : 2048 * k + 2048]
            assert (r.piece, r.start, r.length) == (k, 2048 * k, len(part))
            assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes()) and np.frombuffer(r.ids, "<u4").tolist() == part
        assert sum(r.length for r in by_doc[i]) == len(want)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 2
    assert P.pack(docs.limit(0)).count() == 0
