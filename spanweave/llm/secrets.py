"""Secret scans: a trigram inverted index per block of texts, Boolean trigram queries, then the regexes.

Every rule's regex yields a Boolean query over trigrams that any match must hold. Each block of rows (a part of an Arrow batch)
gets an inverted index, made of its texts' own trigrams as far as a query names them; the postings are intersected and united as the query says, and only the
candidate rows meet the regex. A rule with no mandatory trigram (the hex rule) scans every row. The index follows the
data's own blocks, so nothing is shuffled. A block ends at BLOCK code points (or holds one text), and its bytes are looked up
in slices, so that memory follows the longest text and not the number of rows.

Null and empty texts have no spans. Rows are independent: ties, repeated rows and extra columns have no effect.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.arrow import small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


# The base rules as the contract lists them, then rules of our own for published token formats.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is a frozenset of alternatives, each a frozenset of trigrams that must all occur; None: no condition.
Query = frozenset | None
_MOST = 64


def _exact(nodes) -> set[str] | None:
    """The lower-case strings that a sequence of regex nodes can match, if they are few."""
    out = {""}
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            own = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            own = _exact(arg[3])
        elif name == "BRANCH":
            parts = [_exact(x) for x in arg[1]]
            own = None if any(x is None for x in parts) else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            own = _exact(arg[2])
            own = None if own is None else own | ({""} if arg[0] == 0 else set())
        else:
            own = None
        if own is None or len(own) * len(out) > _MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def _all(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else min(a, b, key=len)


def _least(alternatives) -> Query:
    """Without alternatives that another implies."""
    found = set(alternatives)
    return None if frozenset() in found else frozenset(x for x in found if not any(y < x for y in found))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _of(nodes) -> Query:
    query, run = None, {""}
    for node in nodes:
        own = _exact([node])
        if own is not None and len(run) * len(own) <= _MOST:
            run = {a + b for a in run for b in own}
            continue
        query, run = _all(query, _of_strings(run)), own or {""}
        if own is None:
            op, arg = str(node[0]), node[1]
            if op == "SUBPATTERN":
                query = _all(query, _of(arg[3]))
            elif op == "BRANCH":
                parts = [_of(x) for x in arg[1]]
                query = _all(query, None if any(x is None for x in parts) else _least(set().union(*parts)))
            elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                query = _all(query, _of(arg[2]))
    return _all(query, _of_strings(run))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query (lower case) that every match of pattern satisfies; None: the rule must scan fully."""
    return _of(sre.parse(pattern, flags))


@lru_cache
def _compiled(rules: tuple[Rule, ...]):
    return [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]


BLOCK = 1 << 20  # code points of a block's texts
_SLICE = 1 << 21  # bytes looked up at once

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z in lower case


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


def build_index(texts: list[str], trigrams: set[str]) -> dict[str, np.ndarray]:
    """Postings of one block, from the texts' own trigrams: every three bytes in a row (A-Z in lower case, a zero byte between
    texts) are looked up among the rules' trigrams, and the row numbers of those found are collected, ascending. The other
    trigrams of the texts have no postings, as no query names them."""
    wanted = {_code(t): t for t in trigrams}
    known, data = np.zeros(1 << 24, bool), [x.encode("utf-8", "surrogatepass") for x in texts]
    known[list(wanted)] = True
    ends = np.cumsum([len(x) + 1 for x in data])
    flat = np.frombuffer(b"\0".join([*data, b""]), np.uint8)
    places, found = [], []
    for a in range(0, len(flat) - 2, _SLICE):
        part = _FOLD[flat[a : a + _SLICE + 2]].astype(np.uint32)
        codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        hits = np.flatnonzero(known[codes])
        places.append(hits + a)
        found.append(codes[hits])
    if not places:
        return {t: np.empty(0, np.int64) for t in trigrams}
    rows, codes = np.searchsorted(ends, np.concatenate(places), "right"), np.concatenate(found)
    return {t: np.unique(rows[codes == c]) for c, t in wanted.items()}


def candidates(index: dict[str, np.ndarray], query: Query, rows: int) -> np.ndarray:
    """Rows that satisfy the query, from the postings; all rows for a query without a condition."""
    if query is None:
        return np.arange(rows)
    found = np.empty(0, np.int64)
    for needed in query:
        hits = None
        for t in sorted(needed, key=lambda x: len(index[x])):
            hits = index[t] if hits is None else np.intersect1d(hits, index[t], assume_unique=True)
            if not len(hits):
                break
        found = np.union1d(found, hits)
    return found.astype(np.int64)


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most `most` code points together, or of one row."""
    a = size = 0
    for i, text in enumerate(texts):
        if i > a and size + len(text) > most:
            yield a, i
            a, size = i, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end) in order of start, then of rules."""
    plans = _compiled(rules)
    index = build_index(texts, {t for _, _, q in plans for a in q or () for t in a})
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, regex, query) in enumerate(plans):
        for i in candidates(index, query, len(texts)):
            for m in regex.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[i].append((m.start(), k, m.end()))
    for own in spans:
        own.sort()
    return spans


#: doc_id travels as text, since pandas turns a column of integers with nulls into doubles.
_SCHEMA = "doc_id string, kinds array<string>, starts array<long>, ends array<long>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and its spans as parallel arrays kinds, starts, ends (code points, end exclusive)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, b in blocks(texts):
                spans = scan_block(texts[a:b], rules)
                yield pd.DataFrame({"doc_id": ids[a:b], "kinds": [[rules[k].kind for _, k, _ in s] for s in spans], "starts": [[a for a, _, _ in s] for s in spans], "ends": [[e for _, _, e in s] for s in spans]})

    small_batches(docs.sparkSession)
    texts = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "coalesce(text, '') AS text")
    return texts.mapInPandas(scan, _SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts and digest of the base kinds, and all spans as text."""
    names = [r.kind for r in BASE_RULES]
    span = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("mark")))
    found = find_secrets(docs).select("doc_id", span.alias("_spans"))
    marks = lambda keep: F.array_join(F.transform(F.filter("_spans", keep), lambda s: s["mark"]), ",")
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(marks(lambda s: s["kind"].isin(names)), 256).alias("base_sha256"), marks(lambda s: F.lit(True)).alias("spans"))
