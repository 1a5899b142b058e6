import random
import re

from spanweave.llm import lines as L
from tests.llm import test_lines


def brute_every(rows, min_words=5):
    """Aligns every document with every earlier one; no hashes, no joins."""
    docs = dict(sorted((doc_id, re.split(r"(?<=\n)(?=[^\n])", text)) for doc_id, text in rows))
    out, before = {}, []
    for d, pieces in docs.items():
        content = [(i, x.strip()) for i, x in enumerate(pieces) if x.strip()]
        marked = set()
        for other in before:
            common = set(other) & {x for _, x in content}
            a, b = [x for x in other if x in common], [(i, x) for i, x in content if x in common]
            marked |= {b[j][0] for _, j in L.patience(a, [x for _, x in b])}
        before.append([x for _, x in content])
        gone, block = set(), []
        for i, x in [*content, (None, None)]:
            if i in marked:
                block.append((i, len(x.split())))
            else:
                gone |= {k for k, _ in block} if sum(w for _, w in block) >= min_words else set()
                block = []
        kept = "".join(x for i, x in enumerate(pieces) if i not in gone)
        out[d] = kept if kept.strip() or not gone else ""
    return out


def check(spark, rows):
    got = {r.doc_id: r.text for r in L.line_dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_every(rows)
    assert got == want, [k for k in want if got[k] != want[k]]
    return want


def test_order_of_a_later_holder(spark):
    p, q = "one line of six words here", "another line that many documents hold"
    rows = [(1, f"{p}\nown 1\n{q}"), (2, f"{q}\nown 2\n{p}"), (3, f"{q}\nown 3\n{p}"), (4, f"{p}\n{q}\nown 4\n{p}\nown 5\n{q}")]
    assert check(spark, rows)[3] == "own 3\n"


def test_every_holder_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 6, 12]))) + f" {k}" for k in range(30)]
    rows = [(i, rng.choice(["\n", "\n\n", " \n"]).join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k} of this text" for k in range(rng.randint(0, 14)))) for i in range(150)]
    hot = pool[3:6]
    rows += [(200 + i, "\n".join([f"own {i} first", *rng.sample(hot, 3), *rng.choices(hot, k=i % 3), f"own {i} last"])) for i in range(80)]
    want = check(spark, rows)
    first = test_lines.brute(rows)
    assert sum(first[False, k or 0, dict(rows)[k]] != v for k, v in want.items()) > 10
