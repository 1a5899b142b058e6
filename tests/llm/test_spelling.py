import random
import re
import zlib
from collections import Counter

import pytest

from spanweave.llm import spelling as S


def words_of(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return out - {w}


def brute(words):
    letters = set("".join(words))
    out, forms = {}, {}
    for w, n in words.items():
        close = [x for x in edits(w, letters) if x in words]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            forms[w] = best
        out[w] = [n, len(close), words[best] if w in forms else None]
    rows = []
    for w, (n, close, best) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, close, best))
    return sorted(rows)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    chain = ["abcdefgh", "abcdefgx", "abcdefxx", "abcdexxx", "xabcdexxx"]
    docs = [(1, " ".join(w.upper() if i % 2 else w for i, w in enumerate(chain) for _ in range((2600, 250, 24, 2, 2)[i]))), (2, None), (3, ""), (None, "Straße Straße STRA×EEEE straßeeee straßeeee " + "x" * 3000 + " " + "x" * 3000), (None, "x" * 3001 + "," + "x" * 3001)]
    for d in range(10, 60):
        docs.append((d, " ".join(rng.choice(base)[: rng.randint(6, 9)] + rng.choice(["", "", "a", "q"]) for _ in range(60))))
    docs += docs[-5:]
    return docs


@pytest.mark.parametrize(("seed", "most"), [(1, 64), (2, 5), (3, 2)])
def test_against_all_edits(spark, seed, most):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, word string")
    got = sorted(tuple(r) for r in S.spelling_variants(df, most=most).collect())
    want = brute(words_of(docs))
    assert got == want
    assert max(r[4] for r in want) > 3 and any(r[1] and r[1] != r[2] for r in want)


def test_every_pair_in_one_block_of_the_alphabet(spark):
    """All words of one pattern: no half divides them, so blocks go down to one free code point."""
    words = {f"aaa{c}bbb{d}ccc": 5 for c in "abcdefghij" for d in "abcdefghij"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in S.spelling_groups(df, most=3).collect())
    assert got == brute(words)
    assert S.links(df, most=3).count() == S.links(df, most=3).distinct().count() == 100 * 18


def test_empty(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
