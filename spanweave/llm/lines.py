"""Line dedup by pairwise alignment: documents that share lines are aligned by patience diff, and aligned common blocks go
from the later document.

Documents are ordered by doc_id (null last), then by a hash of the text; rows equal in both are one document and share its
fate. A line is a piece of text up to and with its line feeds; lines are compared without surrounding white space, blank
ones are ignored.

1. Line hashes (128 bits) are counted; a line is shared if two documents hold it. Each shared line has a first holder.
2. A later document is paired with the first holders of its shared lines. That is one pair for each holder of a line, however
   frequent the line is, and none between two later holders: lines rare or frequent, the work stays linear in the lines.
   A text equal to an earlier one is wholly aligned with it, so it needs no pair.
   With every=True (the registered queries) a shared line that is not aligned then is taken to its other earlier holders,
   in rounds, until it is aligned or each of them has been tried: the result is that of aligning every document with every
   earlier one. Documents with the same sequence of shared lines align alike, so the first of them stands for all.
3. A pair's shared lines are aligned by patience diff: lines that are unique in both, in their longest increasing order,
   are anchors; what lies between anchors is trimmed at both ends and aligned in the same way.
4. The later document's aligned lines, from all its pairs, form blocks of consecutive lines (blank lines don't interrupt).
   Blocks of min_words words or more are deleted; what remains is kept as it is. A block whose lines have different first
   holders is thus found whole.

Null texts stay null, empty ones stay empty, and a document all of whose lines go has the empty text. An empty table gives
no rows. Columns that docs has besides doc_id and text are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import saved

MIN_WORDS = 5
#: What a regular expression calls \s.
WHITE = " \t\n\x0b\f\r"


def _pieces(text: str | Column) -> Column:
    return F.split(text, r"(?<=\n)(?=[^\n])")


def _lines(keyed: DataFrame) -> DataFrame:
    """(_doc, _pos, _line): the trimmed lines that aren't blank; _pos counts _pieces(). Regular expressions would look at every
    character many times, and at runs of white space inside a line in the square of their length. Each piece has one run without
    line feeds, but for a first one of line feeds alone."""
    runs = keyed.select("_doc", F.startswith("text", F.lit("\n")).cast("int").alias("_lead"), F.posexplode(F.array_remove(F.split("text", "\n"), "")).alias("_run", "_line"))
    return runs.select("_doc", (F.col("_run") + F.col("_lead")).alias("_pos"), F.btrim("_line", F.lit(WHITE)).alias("_line")).where("_line <> ''")


def _n_words(line: str) -> Column:
    """Words of a trimmed line that isn't blank: its spaces and one, unless it has other gaps than single spaces."""
    other = F.lit(False)
    for gap in ("  ", "\t", "\r", "\f", "\x0b"):
        other = other | F.contains(line, F.lit(gap))
    single = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1
    return F.when(other, F.size(F.split(line, r"\s+"))).otherwise(single)


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal elements, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(a[i:m], i) if in_a[x] == 1}
        both = [(place[x], k) for k, x in enumerate(b[j:n], j) if in_b[x] == 1 and x in place]
        anchors = [both[k] for k in _increasing([p for p, _ in both])]
        for p, k in anchors:
            todo.append((i, p, j, k))
            out.append((p, k))
            i, j = p + 1, k + 1
        if anchors:
            todo.append((i, m, j, n))
    return sorted(out)


def aligned_positions(first: tuple[list, list], later: tuple[list, list]) -> list[int]:
    """Positions in the later document that a patience diff aligns. Each side: positions and hashes of its shared lines;
    lines that only one side holds can't be aligned and are left out before."""
    known = set(first[1]) & set(later[1])
    a = [h for h in first[1] if h in known]
    kept = [(p, h) for p, h in zip(*later, strict=True) if h in known]
    return [kept[j][0] for _, j in patience(a, [h for _, h in kept])]


def line_marks(docs: DataFrame, every: bool = False) -> DataFrame:
    """Rows (_doc, _pos, _words, _blank) of documents with aligned lines: those lines, in order; _doc as in _keyed()."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lines = saved(_lines(keyed).select("_doc", "_pos", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), "_line").alias("_g"), _n_words("_line").alias("_words")).distinct(), "lines")

    holders = lines.groupBy("_h", "_g").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).where("_first <> _last").drop("_last")
    shared = saved(lines.join(holders, ["_h", "_g"]), "shared")

    same = lines.groupBy("_doc").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_pos", "_h", "_g")).alias("x"), F.sum(F.xxhash64("_h", "_g", "_pos") % 1000000007).alias("y"))
    heads = same.groupBy("n", "x", "y").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).where("_first <> _last").drop("_last")
    copies = saved(same.join(heads, ["n", "x", "y"]).where("_doc <> _first").select("_doc"), "copies")

    rest = shared.join(copies, "_doc", "left_anti").where("_doc <> _first")
    entry = F.struct("_pos", "_h", "_g")
    lists = shared.groupBy("_doc").agg(F.array_sort(F.collect_list(entry)).alias("own")).select("_doc", *_columns("own"))
    if every:
        lists = saved(lists, "lists")
    aligned = _aligned(rest.select("_doc", F.col("_first").alias("_other")).distinct(), lists)
    if every:
        aligned = saved(aligned, "aligned")
        for found in _other_holders(rest.join(aligned, ["_doc", "_pos"], "left_anti"), shared, lists):
            aligned = aligned.unionByName(found)
        aligned = aligned.distinct()
    whole = lines.join(copies, "_doc", "left_semi").select("_doc", "_pos")
    marked = aligned.unionByName(whole)
    return lines.select("_doc", "_pos", "_words").join(marked.select("_doc").distinct(), "_doc", "left_semi").join(marked.withColumn("_marked", F.lit(1)), ["_doc", "_pos"], "left")


def _aligned(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(_doc, _pos): the lines of _doc that its pairs (_doc, _other) align."""
    own = lists.select("_doc", F.col("pos").alias("later_pos"), F.col("hash").alias("later_hash"))
    other = lists.select(F.col("_doc").alias("_other"), F.col("pos").alias("first_pos"), F.col("hash").alias("first_hash"))
    sides = pairs.join(own, "_doc").join(other, "_other")
    sides = sides.select(F.col("_doc._null").alias("_null"), F.col("_doc._id").cast("string").alias("_id"), F.col("_doc._hash").alias("_hash"), "later_pos", "later_hash", "first_pos", "first_hash")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [aligned_positions((fp.tolist(), fh.tolist()), (lp.tolist(), lh.tolist())) for lp, lh, fp, fh in zip(pdf["later_pos"], pdf["later_hash"], pdf["first_pos"], pdf["first_hash"], strict=True)]
            yield pdf[["_null", "_id", "_hash"]].assign(marks=[np.array(x, np.int32) for x in found])

    aligned = sides.mapInPandas(align, "_null int, _id string, _hash long, marks array<int>")
    doc = F.struct("_null", F.col("_id").cast("long").alias("_id"), "_hash").alias("_doc")
    return aligned.select(doc, F.explode("marks").alias("_pos")).distinct()


def _other_holders(left: DataFrame, shared: DataFrame, lists: DataFrame, growth: int = 8, salts: int = 16) -> list[DataFrame]:
    """Tables (_doc, _pos) of the lines in left (shared lines that their first holder doesn't align) that another earlier
    holder aligns. Round r takes about growth^(r+1) holders of each line, by a hash, and the last one all that remain, so
    lines that are soon aligned never meet the rest of their holders."""
    classes = lists.select("_doc", F.size("hash").alias("n"), F.xxhash64("hash").alias("x"), F.xxhash64(F.lit(1), "hash").alias("y"))
    heads = classes.groupBy("n", "x", "y").agg(F.min("_doc").alias("_head"), F.max("_doc").alias("_last")).where("_head <> _last").drop("_last")
    alike = saved(classes.join(heads, ["n", "x", "y"]).where("_doc <> _head").select("_doc"), "alike")
    left = saved(left.select("_doc", "_pos", "_h", "_g"), "left")
    found = [left.join(alike, "_doc", "left_semi").select("_doc", "_pos")]
    left = saved(left.join(alike, "_doc", "left_anti"), "left")

    others = shared.where("_doc <> _first").join(left.groupBy("_h", "_g").agg(F.max("_doc").alias("_to")), ["_h", "_g"]).where("_doc < _to")
    others = saved(others.join(alike, "_doc", "left_anti").select("_h", "_g", F.col("_doc").alias("_other")).distinct(), "others")
    part = (F.pmod(F.xxhash64("_other"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40)) * F.col("_n")
    others = others.join(others.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")), ["_h", "_g"]).withColumn("_round", F.greatest(F.lit(0), F.ceil(F.log(float(growth), part)) - 1).cast("int"))
    others = saved(others.drop("_n"), "others")
    ends = saved(others.groupBy("_h", "_g").agg(F.max("_round").alias("_end")), "ends")
    last = ends.agg(F.max("_end")).first()[0]
    for r in range(0 if last is None else last + 1):
        here = others.where(F.col("_round") == r)
        salt, each = F.pmod(F.xxhash64("_doc" if r < 2 else "_other"), F.lit(salts)).cast("int").alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
        met = left.select("*", salt if r < 2 else each).join(here.select("_h", "_g", "_other", each if r < 2 else salt), ["_h", "_g", "_salt"]).where("_other < _doc")
        found.append(saved(_aligned(met.select("_doc", "_other").distinct(), lists), "aligned"))
        left = saved(left.join(found[-1], ["_doc", "_pos"], "left_anti").join(ends.where(F.col("_end") > r), ["_h", "_g"], "left_semi"), "left")
        if left.isEmpty():
            break
    return found


def _columns(name: str) -> list[Column]:
    return [F.transform(name, lambda e: e["_pos"]).alias("pos"), F.transform(name, lambda e: F.xxhash64(e["_h"], e["_g"])).alias("hash")]


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds _doc, the document's place in the order: struct of _null, _id and _hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("_doc", F.struct(F.when(F.col("doc_id").isNull(), 1).otherwise(0).alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(text).alias("_hash")))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, every: bool = False) -> DataFrame:
    """(_doc, gone: numbers of the pieces to delete)."""
    by_doc = Window.partitionBy("_doc").orderBy("_pos")
    lines = line_marks(docs, every).withColumn("_block", F.sum(F.when(F.col("_marked").isNull(), 1).otherwise(0)).over(by_doc)).where("_marked IS NOT NULL")
    lines = lines.withColumn("_all", F.sum("_words").over(Window.partitionBy("_doc", "_block")))
    return lines.where(F.col("_all") >= min_words).groupBy("_doc").agg(F.collect_list("_pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, every: bool = False) -> DataFrame:
    """The columns of docs, with text without the deleted blocks and n_chars (if there) its length, and n_deleted (lines), which
    stands in for a column of that name in docs.
    every: align with all earlier holders of a line, not with its first one alone."""
    rest = [c for c in docs.columns if c != "text"]  # the text is shuffled once
    keyed = _keyed(docs.select(F.struct(*rest).alias("_row"), "doc_id", "text")).drop("doc_id")
    gone = deletions(docs, min_words, every)
    out = keyed.join(gone, "_doc", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_pieces") - 1), "gone")
    out = out.withColumn("_pieces", F.when(F.col("gone").isNotNull(), _pieces("text")))
    out = out.withColumn("_kept", F.when(F.col("gone").isNotNull(), F.array_join(F.transform(places, lambda i: F.get("_pieces", i)), "")))
    out = out.withColumn("_new", F.when(F.col("gone").isNull(), F.col("text")).when(F.btrim("_kept", F.lit(WHITE)) == "", F.lit("")).otherwise(F.col("_kept")))
    new = {"text": F.col("_new"), "n_chars": F.coalesce(F.length("_new"), F.lit(0)).cast("long")}
    return out.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns if c != "n_deleted"], F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is kept, its length and the number of deleted lines."""
    return dedup_lines(docs.select("doc_id", "text"), every=True).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "n_deleted")
