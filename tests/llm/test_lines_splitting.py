import itertools
import re
import time

from spanweave.llm import lines as L

WHITE = " \t\n\x0b\f\r"


def test_places_and_words_of_lines(spark):
    texts = ["".join(x) for n in range(6) for x in itertools.product("\n a", repeat=n)]
    texts += [None, "a\tb  c\n\x0bd\x0ce\r\n f g\u2028\n\u00a0\n\u3000h i ", "é ü\n\n\nß", "\n\n\r\n x  y\tz\x0bw"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = L._lines(L._keyed(docs))
    got = sorted((r._doc._id, r._pos, r._line, r.n) for r in found.select("*", L._n_words("_line").alias("n")).collect())
    pieces = ((i, p, x.strip(WHITE)) for i, t in enumerate(texts) for p, x in enumerate(re.split(r"(?<=\n)(?=[^\n])", t or "")))
    assert got == [(i, p, x, len(re.split("[ \t\n\x0b\f\r]+", x))) for i, p, x in pieces if x]


def test_last_line_that_ends_with_a_separator(spark):
    """A regular expression's $ also stands before U+2028 at the very end, so the same line differed there."""
    line = "one line of six words here \u2028"
    docs = spark.createDataFrame([(1, f"own 1\n{line}\nown 2"), (2, f"own 3\n{line}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in L.line_dedup_digest(docs).collect()) == [(1, f"own 1\n{line}\nown 2"), (2, "own 3\n")]


def test_long_gaps_inside_lines(spark):
    """Trimming takes time in proportion to a line, not to the square of the gaps inside it."""
    gap = " " * 200_000
    docs = spark.createDataFrame([(i, f"own {i}\nfour words{gap}and more\n") for i in range(8)], "doc_id long, text string")
    begun = time.monotonic()
    out = {r.doc_id: r.text for r in L.line_dedup_digest(docs).collect()}
    assert out[0] == f"own 0\nfour words{gap}and more\n"  # four words stay everywhere
    assert out[7] == f"own 7\nfour words{gap}and more\n"
    assert time.monotonic() - begun < 30


def test_text_is_shuffled_once(spark):
    """The row that goes through the last join holds the text once."""
    docs = spark.createDataFrame([(1, "a b c d e\n", "x"), (2, "a b c d e\nown", "y")], "doc_id long, text string, source string")
    out = L.dedup_lines(docs, every=True)
    assert out.columns == ["doc_id", "text", "source", "n_deleted"]
    assert sorted((r.doc_id, r.text, r.source, r.n_deleted) for r in out.collect()) == [(1, "a b c d e\n", "x", 0), (2, "own", "y", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"struct\(doc_id, .*source", plan) and not re.search(r"struct\([^)]*\btext, text#", plan)
