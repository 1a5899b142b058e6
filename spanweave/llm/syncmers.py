"""Document fingerprints by closed syncmers, in built-in functions only.

A text's units are its lower-case words; characters of scripts written without spaces (UNSPACED) are units of their own, and
words of more than LONG code points give their code points. This rule is the same for texts of every length. EDGE units
stand before the first and after the last unit, so that the shortest texts have anchors too. A k-mer of units is a closed
syncmer if the smallest hash of its inner s-mers lies at its first or last place. Whether it is one depends on its own units
alone, so equal passages give equal anchors wherever they stand, and in any k - s + 1 consecutive k-mers there is one at
least. The fingerprint is the list of the anchors' 32-bit hashes in text order. A text without units has none.

Likeness matches anchors by place: the first occurrences of each anchor that both texts have are paired, and a pair counts if
the shift of its places is within BAND of the texts' mean number of distinct anchors from the median shift of all pairs (the
diagonal on which the texts lie above each other). It is the Dice coefficient of the pairs that count. So texts whose halves
are swapped are about half alike. Null texts count as empty; two empty fingerprints are alike (1), an empty one and
another aren't (0).

edited_pairs() meets every text with the next one in descending doc_id (null last; ties by a hash of the text; after the last
the first). Ranges of doc_id are dealt to partitions, and the first row of each range goes to the range before it as well, so
that no window spans more than a range and texts are shuffled once. doc_id is meant to be (nearly) unique. An empty table gives
no rows; the only row of a table is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 1
LONG = 32
BAND = 0.25
UNSPACED = "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Hangul", "Thai", "Lao", "Khmer", "Myanmar"))
EDGE = (1 << 63) - 1  # hashes of units meet it hardly ever; as the largest number it is smaller than none of them


def _anchors(units: str, k: int, s: int) -> Column:
    """Hashes of the closed syncmers in an array of unit hashes, in order. units: the name of the column."""
    u = F.col(units)
    size = F.size(u)
    smers = [lambda i, j=j: F.element_at(u, (i + j).cast("int")) if s == 1 else F.xxhash64(*[F.element_at(u, (i + j + x).cast("int")) for x in range(s)]) for j in range(k - s + 1)]

    def closed(i: Column) -> Column:
        inner = [f(i) for f in smers[1:-1]]
        return F.least(smers[0](i), smers[-1](i)) <= (F.least(*inner) if len(inner) > 1 else inner[0])

    def anchor(i: Column) -> Column:
        return F.hash(*[F.element_at(u, (i + x).cast("int")) for x in range(k)])

    found = F.transform(F.filter(F.sequence(F.lit(1), size - k + 1), closed), anchor)
    found = F.when(size >= k, found).otherwise(F.array().cast("array<int>"))
    return F.when(size == 0, F.array().cast("array<int>")).when(F.size(found) == 0, F.array(F.hash(u))).otherwise(found)


def add_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds name: the anchors of column text, which must not be null."""
    lower = F.lower(F.col(text))
    apart = rf"[^\p{{L}}\p{{N}}]+|(?=[{UNSPACED}])|(?<=[{UNSPACED}])"
    words = F.when(F.length(text) == F.octet_length(text), F.split(lower, r"[^\p{L}\p{N}]+")).otherwise(F.split(lower, apart))
    out = df.withColumn("_w", F.filter(words, lambda w: w != ""))
    long = F.exists("_w", lambda w: F.length(w) > LONG)
    pieces = F.flatten(F.transform("_w", lambda w: F.when(F.length(w) <= LONG, F.array(w)).otherwise(F.split(w, ""))))
    units = F.transform(F.when(long, pieces).otherwise(F.col("_w")), lambda w: F.xxhash64(w))
    edge = F.array_repeat(F.lit(EDGE), K - 1)
    out = out.withColumn("_u", F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.concat(edge, units, edge)))
    return out.withColumn(name, _anchors("_u", K, S)).drop("_w", "_u")


def fingerprint(anchors: str) -> Column:
    """Anchors in hexadecimal, joined."""
    return F.array_join(F.transform(anchors, lambda h: F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), ".")


_PLACE = (1 << 31) - 1


def add_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds name: the likeness of the anchors in columns a and b.

    Anchor, side and place are packed into one number, so that sorting brings the occurrences of an anchor together; of each
    side the first is kept, and those of both sides are neighbours then."""

    def packed(c: str, side: int) -> Column:
        return F.transform(c, lambda h, i: F.shiftleft(h.cast("long"), 32).bitwiseOR(F.lit(side << 31)).bitwiseOR(i.cast("long")))

    def before(c: str, i: Column) -> Column:
        return F.element_at(c, F.greatest(i, F.lit(1)))  # place i - 1 counted from 0

    out = df.withColumn("_all", F.sort_array(F.concat(packed(a, 0), packed(b, 1))))
    first = F.filter("_all", lambda x, i: (i == 0) | (F.shiftright(x, 31) != F.shiftright(before("_all", i), 31)))
    out = out.withColumn("_first", first).drop("_all")
    shift = lambda x, i: F.when((i > 0) & (F.shiftright(x, 32) == F.shiftright(before("_first", i), 32)), x.bitwiseAND(F.lit(_PLACE)) - before("_first", i).bitwiseAND(F.lit(_PLACE)))
    out = out.withColumn("_shifts", F.sort_array(F.filter(F.transform("_first", shift), lambda d: d.isNotNull())))
    out = out.withColumn("_median", F.try_element_at("_shifts", (F.floor(F.size("_shifts") / 2) + 1).cast("int")))
    total = F.size("_first")
    near = F.size(F.filter("_shifts", lambda d: F.abs(d - F.col("_median")) <= BAND / 2 * total))
    return out.withColumn(name, F.when(total == 0, F.lit(1.0)).otherwise(2.0 * near / total)).drop("_first", "_shifts", "_median")


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _range and _guest: every row in its range of doc_id, the first of each range also as a guest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [(i + 1) / parts for i in range(parts)]
    tops = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * parts)))).first()[0]
    tops = sorted(set(tops or []))  # ids of rows; range i holds those up to tops[i] and above tops[i - 1]
    if not tops:
        return rows.select("doc_id", "_text", F.lit(0).alias("_range"), F.lit(0).alias("_guest"))
    # Binary search in two steps, so that a row compares itself with about twice the root of the number of ranges.
    step = max(1, int(len(tops) ** 0.5))
    bounds, coarse = F.array(*[F.lit(t).cast("long") for t in tops]), F.array(*[F.lit(t).cast("long") for t in tops[step - 1 :: step]])
    skip = F.size(F.filter(coarse, lambda t: t < F.col("doc_id"))) * step
    at = skip + F.size(F.filter(F.slice(bounds, (skip + 1).cast("int"), F.lit(step)), lambda t: t < F.col("doc_id")))
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    guest = F.struct(F.when(F.col("_range") == len(tops) - 1, 0).otherwise(F.col("_range") + 1).cast("int").alias("r"), F.lit(1).alias("g"))
    is_top = F.coalesce(F.array_contains(F.slice(bounds, F.col("_range") + 1, F.lit(1)), F.col("doc_id")), F.lit(False))
    return rows.withColumn("_e", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "_text", F.col("_e.r").alias("_range"), F.col("_e.g").alias("_guest"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last third of its code points replaced by the first as many of the next's."""
    dealt = _dealt(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = add_anchors(dealt.repartition(parts, "_range"), "_text", "_a")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("_text"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("_text", "_a")}
    out = rows.withColumns({"_next": following["_text"], "_n": following["_a"]}).where("_guest = 0").drop("_range", "_guest")
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    return add_anchors(out.withColumn("_edited", edited).drop("_next"), "_edited", "_e")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    pairs = add_likeness(add_likeness(edited_pairs(docs), "_a", "_e", "near_edited"), "_a", "_n", "near_next")
    return pairs.select(
        "doc_id",
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint("_a").alias("fingerprint"),
        fingerprint("_e").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return add_anchors(rows, "_text", "_a").select("doc_id", fingerprint("_a").alias("fingerprint"))
