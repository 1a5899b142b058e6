import json
import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spanweave.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
LETTERS = "etaoinshrdlucmfwypvbgkjqxzßàáäåæçèéêëíñóöøúüýþÿ"


def test_latin_words_need_neither_the_tokenizer_nor_the_store():
    ours = packing.WordIds(PATH)
    ours.many(pa.array(["The Größe of one, två THREE...", "", "naïve façade? Ærø!"]))
    assert not [u for u in ours.known if u.isalpha()]


def test_ids_by_ranks_are_the_tokenizers():
    plain, rng = Tokenizer.from_file(PATH), random.Random(7)
    known = [w.removesuffix("</w>") for w in plain.get_vocab()]
    words = [w for w in known if w.isascii() and w.isalpha()]
    words += [w.upper() + rng.choice([".", ",", "!?", "", "'s"]) for w in words]
    words += ["".join(rng.choice(words[:30_000]) for _ in range(rng.randint(2, 4))) for _ in range(30_000)]
    words += ["".join(rng.choices(LETTERS, k=rng.randint(1, 24))) for _ in range(60_000)]
    words += [c * n for c in "aeéßz" for n in (1, 2, 3, 50, 99, 100, 101, 499, 500, 501, 5000)]
    words += ["".join(rng.choices(LETTERS, k=n)) for n in (99, 100, 101, 300, 5000, 200_000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    ids, bounds = packing.WordIds(PATH).many(pa.array(texts))
    for k, e in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == e.ids, texts[k]


def merged(symbols, made):
    while (low := min((made[p] for p in zip(symbols, symbols[1:], strict=False) if p in made), default=None)) is not None:
        out = []
        for s in symbols:
            if out and made.get((out[-1], s)) == low:
                out[-1] = -low  # negative, so that it doesn't merge once more in this turn
            else:
                out.append(s)
        symbols = [abs(s) for s in out]
    return symbols


def test_merges_that_are_never_reached_are_seen():
    rng, seen = random.Random(8), set()
    for _ in range(3000):
        pairs, spelled = [], {k: [k] for k in range(1, 4)}
        for k in range(4, 9):
            pair = rng.choice(list(spelled)), rng.choice(list(spelled))
            pairs.append(pair)
            spelled[k] = spelled[pair[0]] + spelled[pair[1]]
        made = {p: 4 + k for k, p in enumerate(pairs)}
        want = len(made) == len(pairs) and all(merged(spelled[k], made) == [k] for k in range(4, 9))
        assert packing._reached(pairs, 4) == want, pairs
        seen.add(want)
    assert seen == {True, False}


def test_another_tokenizer_goes_without_ranks(tmp_path):
    with open(PATH) as f:
        whole = json.load(f)
    whole["normalizer"] = None
    (tmp_path / "own.json").write_text(json.dumps(whole))
    ours = packing.WordIds(str(tmp_path / "own.json"))
    plain = Tokenizer.from_file(str(tmp_path / "own.json"))
    text = "some words, and more words."
    assert ours.ranked is None
    assert ours.many(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
