import hashlib
import random

import pytest

from spanweave.llm import syncmers as S

SF = "/root/testdata/sf0.001"


def edited(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = t[: len(t) - cut] + n[:cut]
    return out


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_edited_texts_and_likeness(spark, partitions):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i * 7 - 300, t) for i, t in rows] + [(None, "null id é"), (10**15, None), (10**15 + 1, ""), (-(10**12), "x"), (5001, "é" * 700), (5002, "word " * 20_000), (5003, rows[3][1])]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _text string")
        got = {r.doc_id: r for r in S.fingerprint_digest(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, texts = edited(rows), dict(rows)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest(), i
        assert r.n_chars == len(texts[i] or "") and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    of = {}
    for i, r in got.items():
        assert of.setdefault(texts[i] or "", r.fingerprint) == r.fingerprint
    long = [r for r in got.values() if r.n_chars > 100]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 and sum(r.near_next < 0.3 for r in long) > 0.8 * len(long)


def test_closed_syncmers_by_hand(spark):
    rng = random.Random(2)
    units = [[rng.randint(-99, 99) for _ in range(rng.choice([0, 1, 4, 5, 6, 30]))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(units)), "i int, u array<bigint>")
    got = df.select("i", S._anchors("u", 5, 1).alias("a"), S.F.transform(S.F.sequence(S.F.lit(1), S.F.greatest(S.F.size("u") - 4, S.F.lit(1))), lambda i: S.F.hash(*[S.F.try_element_at("u", (i + x).cast("int")) for x in range(5)])).alias("h")).collect()
    for r in got:
        u = units[r.i]
        keep = [r.h[i] for i in range(len(u) - 4) if min(u[i], u[i + 4]) <= min(u[i + 1 : i + 4])]
        assert r.a == keep if keep else len(r.a) == (len(u) > 0)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert S.fingerprint_digest(spark.createDataFrame([], schema)).count() == 0
    one = S.fingerprint_digest(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1
    nulls = S.fingerprint_digest(spark.createDataFrame([(None, "abc"), (None, "abc")], schema)).collect()
    assert len(nulls) == 2 and nulls[0].near_next == 1


def anchors_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return S.add_anchors(df, "t", "a").select("i", "a")


def likeness_of(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    out = S.add_likeness(S.add_anchors(S.add_anchors(df, "x", "a"), "y", "b"), "a", "b", "near").collect()
    return [r.near for r in sorted(out, key=lambda r: r.i)]


def brute_likeness(a, b):
    """The pairs of first occurrences near the median shift, from lists of anchors."""
    first = [{h: i for i, h in reversed(list(enumerate(x)))} for x in (a, b)]
    total = sum(map(len, first))
    shifts = sorted(first[1][h] - first[0][h] for h in first[0] if h in first[1])
    if not total:
        return 1.0
    return 2 * sum(abs(d - shifts[len(shifts) // 2]) <= S.BAND / 2 * total for d in shifts) / total


def test_likeness_by_brute_force(spark):
    rng = random.Random(9)
    pool = [rng.randint(-(2**31), 2**31 - 1) for _ in range(25)] + [-1, 0, 1, 2**31 - 1, -(2**31)]
    rows = [(i, [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 9, 40]))], [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 9, 40]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    got = {r.i: r.near for r in S.add_likeness(df, "a", "b", "near").collect()}
    assert got == {i: pytest.approx(brute_likeness(a, b)) for i, a, b in rows}


def test_units_follow_one_rule_at_every_length(spark):
    rng = random.Random(3)
    han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(800))
    pairs = []
    for n in (60, 510, 512, 513, 515, 800):
        x = han[:n]
        pairs.append((x, x[: n - n // 3] + han[::-1][: n // 3]))
    near = likeness_of(spark, pairs)
    assert max(near) - min(near) < 0.2 and abs(near[1] - near[4]) < 0.05 and min(near) > 0.5
    run = "".join(rng.choice("abcdefghij0123456789") for _ in range(600))  # one long word
    assert likeness_of(spark, [(run, run[:400] + run[::-1][:200])])[0] > 0.5
    short = likeness_of(spark, [("eins zwei drei vier", "eins zwei drei fünf"), ("eins", "eins"), ("eins", "zwei"), ("", ""), ("", "a"), ("...", "")])
    assert 0 < short[0] < 1 and short[1:] == [1, 0, 1, 0, 1]


def test_swapped_halves_and_insertions(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    x, more = words[:600], words[600:]
    text = " ".join
    swapped, inserted, moved = likeness_of(spark, [(text(x), text(x[300:] + x[:300])), (text(x), text(x[:300] + more[:60] + x[300:])), (text(x), text(more[:100] + x))])
    assert 0.35 < swapped < 0.65 and inserted > 0.9 and moved > 0.85


def test_anchors_are_closed_syncmers_of_the_units(spark):
    rng = random.Random(8)
    texts = ["", "!?", "a", "Ab cd, EF", "你好 world 再见", "x" * 33 + " y", " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ß", "é"]) for _ in range(70))]
    units = [[], [], ["a"], ["ab", "cd", "ef"], ["你", "好", "world", "再", "见"], ["x"] * 33 + ["y"], texts[6].split()]
    rows = spark.createDataFrame(list(enumerate(units)), "i int, u array<string>")
    hashed = {r.i: list(r.h) for r in rows.select("i", S.F.transform("u", lambda w: S.F.xxhash64(w)).alias("h")).collect()}
    kmers = []
    for i, h in hashed.items():
        padded = [S.EDGE] * 4 + h + [S.EDGE] * 4 if h else []
        for j in range(len(padded) - 4):
            m = padded[j : j + 5]
            if min(m[0], m[4]) <= min(m[1:4]):
                kmers.append((i, j, m))
    want = spark.createDataFrame(kmers, "i int, j int, m array<bigint>").select("i", "j", S.F.hash(*[S.F.col("m")[x] for x in range(5)]).alias("a")).orderBy("i", "j").collect()
    for r in anchors_of(spark, texts).collect():
        assert list(r.a) == [w.a for w in want if w.i == r.i], texts[r.i]
