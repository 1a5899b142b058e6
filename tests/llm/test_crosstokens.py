import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanweave.llm import crosstokens as X


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), X.sides(X.A_FILE, X.B_FILE)


def ends(models, text):
    """Ids and end offsets by whole-text calls of the tokenizers; None where they don't spell the text."""
    a, b, own = models
    if not text:
        return None
    out = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (b.encode(text), own.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        at, places = 0, []
        for i in ids:
            at += len(table[i])
            places.append(at)
        out.append((ids, places))
    return out


def brute(models, texts):
    found, counts = [], Counter()
    for text in texts:
        e = ends(models, text)
        if e is None:
            found.append(None)
            continue
        (a, x), (b, y) = e
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(x[i - 1] if i else 0, y[j - 1] if j else 0) < min(x[i], y[j])]
        counts.update((a[i], b[j]) for i, j in links)
        groups, i, j = [], 0, 0
        for end in sorted(set(x) & set(y)):
            p, q = x.index(end) + 1, y.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        found.append((a, b, links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        n = [counts[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(groups), len(links), sum(k == best[b[j]] for k, (_, j) in zip(n, links, strict=True)), sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


WORDS = ["the", "Straße", "naïve", "don't", "it's", "123", "4,567.89", "😀", "雪の日", "x" * 40, "</s>", "<|endoftext|>", "<0x41>", "\x00", "a\tb", "é", "ﬁn", "'s", "...", "İI", "​", "мир", "คำ", ""]
GAPS = [" ", " ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", " ", "\t", "   ", "\r\n", "　", ""]


def random_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "\n\n", "  a", "a ", "\na", "▁", "a ▁b", "plain words here", *(rng.choice(["", " ", "\n"]) + random_text(rng, rng.randint(1, 60)) for _ in range(60))]


def test_units_are_whole_texts(models):
    """The ids of units, one after another, are those of the whole text."""
    a, b, own = models
    rng = random.Random(11)
    texts = [random_text(rng, 12) for _ in range(3000)]
    number, offsets, good, both = own.encoded(pa.array(texts), together=50)
    cut = [X.np.split(flat, X.np.cumsum(size)[:-1]) for flat, size in both]
    assert len(set(number.tolist())) < len(number)
    for k, text in enumerate(texts):
        units = number[offsets[k] : offsets[k + 1]].tolist()
        e = ends(models, text)
        assert all(good[u] for u in units) == (e is not None)
        if e:
            for own_ids, (ids, _) in zip(cut, e, strict=True):
                assert [i for u in units for i in own_ids[u].tolist()] == ids, text


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block_tokens": 5}), (3, {"block_tokens": 9, "most_pairs": 0})])
def test_against_all_pairs_of_tokens(spark, models, seed, options):
    texts = corpus(seed)
    texts += texts[3:9] + texts[20:30]
    docs = spark.createDataFrame([(None if i % 9 == 4 else i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = [tuple(r) for r in X.align_tokens(docs, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    want = [(None if i % 9 == 4 else i, *r) for i, r in enumerate(brute(models, texts))]
    order = lambda rows: sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1:]))
    assert order(got) == order(want)
    assert sum(r[1] > 0 for r in want) > 40


def test_empty(spark):
    assert X.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
