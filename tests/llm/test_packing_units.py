import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spanweave.llm import packing, quality

STEMS = ["BİLGİ", "KİŞİ", "TARİHİ", "Straße", "ΣΑΣ", "\u0958\u0915", "\ufb1dx", "naïve", "don't", "I'LL", "x2", "雪", "\u0130", "e\u0301", "ﬁn", "Ǆ", "\u1e9e", "한글", "\u1112\u1161\u11ab", "क्षि", "a\u0338", "K", "Å", "ok", "The", ""]
SIGNS = [".", ",", "...", "?!", ":", "$", "*", "=\u0338", "\u0307", "-", "'s", "😀", "", "", "\x00", "\u200b", ";;", "%", "#1", ".a"]


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    texts = ["".join(rng.choice(STEMS) + rng.choice(SIGNS) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(1, 4))) for _ in range(100_000)]
    ids, bounds = packing.word_ids(packing.TOKENIZER).many(pa.array(texts))
    want = plain.encode_batch(texts, add_special_tokens=False)
    for k, (text, e) in enumerate(zip(texts, want, strict=True)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, text


def test_share_of_ten_billion_labels(spark):
    share = 4000 / 10**10
    rows = spark.range(4_000_000).where(quality.sampled(quality.F.col("id"), share * 1000, 11)).count()
    assert 1000 < rows < 2300
    assert spark.range(10).where(quality.sampled(quality.F.col("id"), 1.0, 11)).count() == 10
