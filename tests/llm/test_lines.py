import random
import re

from spanweave.llm import lines as L


def test_patience():
    assert L.patience(list("abcxd"), list("abcd")) == [(0, 0), (1, 1), (2, 2), (4, 3)]
    assert L.patience(list("aab"), list("baa")) in ([(0, 1), (1, 2)], [(2, 0)])
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 12))] for _ in "ab")
        got = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        unique = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
        if a == b:
            assert len(got) == len(a)
        if len(unique) == 1 and len(set(a) & set(b)) == 1:
            assert len(got) == 1


def brute(rows, min_words=5):
    """Pairs every document with every earlier one that holds one of its lines first; no hashes, no joins."""
    docs = {}
    for doc_id, text in rows:
        docs.setdefault((doc_id is None, doc_id or 0, text or ""), re.split(r"(?<=\n)(?=[^\n])", text or ""))
    order = sorted(docs)
    # order among equal ids is by a hash in Spark: the fixtures have none
    holder = {}
    for d in order:
        for x in docs[d]:
            if x.strip():
                holder.setdefault(x.strip(), d)
    out = {}
    for n, d in enumerate(order):
        content = [(i, x.strip()) for i, x in enumerate(docs[d]) if x.strip()]
        marked = set()
        if content and any([x for x in map(str.strip, docs[e]) if x] == [x for _, x in content] and len(docs[e]) == len(docs[d]) for e in order[:n]):
            marked = {i for i, _ in content}
        for e in {holder[x] for _, x in content} - {d}:
            other = [x.strip() for x in docs[e] if x.strip()]
            common = {x for x in other} & {x for _, x in content}
            a, b = [x for x in other if x in common], [(i, x) for i, x in content if x in common]
            marked |= {b[j][0] for _, j in L.patience(a, [x for _, x in b])}
        gone, block = set(), []
        for i, x in [*content, (None, None)]:
            if i in marked:
                block.append((i, len(x.split())))
            else:
                if sum(w for _, w in block) >= min_words:
                    gone |= {k for k, _ in block}
                block = []
        kept = "".join(x for i, x in enumerate(docs[d]) if i not in gone)
        out[d] = kept if kept.strip() or not gone else ""
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 6, 12]))) + f" {k}" for k in range(40)]
    rows = []
    for i in range(120):
        rows.append((i, rng.choice(["\n", "\n\n", " \n"]).join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k} of this text" for k in range(rng.randint(0, 14)))))
    rows += [(i, rows[7][1]) for i in range(200, 240)] + [(300, None), (301, ""), (302, "\n \n"), (None, rows[9][1]), (303, "long words here now " * 20_000)]
    rows += [rows[7], rows[7]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars long, gone string")
    out = L.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_deleted"]
    got, want = out.collect(), brute(rows)
    assert len(got) == len(rows)
    source = {(r[0], (r[1] or "")) for r in rows}
    for doc_id, text in source:
        mine = [g for g in got if g.doc_id == doc_id]
        assert {g.text or "" for g in mine} == {want[doc_id is None, doc_id or 0, text]}, doc_id
        assert all(g.n_chars == len(g.text or "") for g in mine)
    assert next(g for g in got if g.doc_id == 300).text is None
    assert sum(g.n_deleted for g in got if g.doc_id and 200 <= g.doc_id < 240) > 0


def test_empty_table(spark):
    assert L.line_dedup_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
