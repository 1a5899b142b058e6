"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of sampled suffixes.

A byte goes if a string of `least` bytes covers it that also starts at another place of the corpus. Let p be the start of such
a string (a window). Its anchor is the smallest hash of eight bytes among its first `spread` places, so equal windows have
equal anchors at equal distances, and only suffixes at anchors have to be sorted - about two in `spread` places.

1. Anchors are found per text, each with the range of windows that are its own. Anchors whose first bytes occur once in the
   corpus (by hash) have no repeated window and go no further.
2. The others' suffixes - `least` bytes on, then the bytes before the anchor, backwards - are sorted into runs. A run is
   front-coded: of each suffix only what its predecessor doesn't share is kept, with the length of what it shares.
3. Runs are cut at splitters (sampled at regular places) and exchanged. Each part merges its runs by a tree of losers that
   compares lengths of shared prefixes first and bytes only beyond those that are known to be equal. The prefixes that
   neighbours share say at once which windows of an anchor are repeated with another one that shares `least` bytes after it.
4. What is left are windows near the ends of matches: shorter on the right of the anchor, or further to the left. They are
   compared within the class of anchors with equal first bytes by 128-bit hashes; classes that a splitter cuts, or of very
   many different contexts, hand those hashes to a shuffle instead.

Texts count by their UTF-8 bytes; null is the empty text. Texts shorter than `least` keep every byte. Of equal texts of at
least that length every byte goes, so texts are known by a hash and worked on once per task. Rows with a null or repeated
doc_id each give a row; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import secrets as random_bytes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.arrow import byte_parts, small_batches
from spanweave.session import saved

LEAST, RUN_BYTES, PART_BYTES, MOST_PARTS, MOST_CONTEXTS = 400, 24 << 20, 1 << 20, 1 << 16, 500
_BLOCK, _EVERY, _K = 1 << 17, 32, 8


def spread_of(least: int) -> int:
    """Places among which a window's anchor is chosen: the shorter, the more suffixes; the longer, the less they must share."""
    if not 16 <= least <= 1600:
        raise ValueError("matches have 16 to 1,600 bytes")
    return least * 5 // 8


def anchors(data: np.ndarray, starts: list[int], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts that lie in data one after another, (number, anchors, first and last window of each), places counted in data."""
    spread = spread_of(least)
    if len(data) < least:
        return
    x = np.ndarray((len(data) - _K + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x &= np.uint64(0xFFFFFFFF00000000)
    x |= np.arange(len(x), dtype=np.uint64)
    blocks = np.full((-(-len(x) // spread), spread), ~np.uint64(0))
    blocks.ravel()[: len(x)] = x
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    on = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least_at = (np.minimum(on[: len(x) - spread + 1], upto[spread - 1 : len(x)]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if b - a >= least:
            own = least_at[a : b - least + 1]
            new = np.flatnonzero(np.diff(own, prepend=-1))
            yield k, own[new], new + a, np.append(new[1:], len(own)) - 1 + a


def _texts(docs: DataFrame) -> DataFrame:
    """key (16 bytes of the text's SHA-256), digest and text, null texts as empty ones."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text")).withColumn("key", F.unhex(F.substring("digest", 1, 32)))


def _once(docs: DataFrame, least: int) -> DataFrame:
    """(key, text) of texts that are long enough, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for key in batch["key"].to_pylist():
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    small_batches(docs.sparkSession)
    return _texts(docs).where(F.octet_length("text") >= least).select("key", "text").mapInArrow(run, "key binary, text string")


def _raw(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """A column of texts as their bytes in a row, and where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), [0]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).tolist()


def _anchor_rows(texts: DataFrame, least: int) -> DataFrame:
    """(key, head, at): the hash of an anchor's first bytes; its place, and how far its nearest and farthest window are before it."""
    first = least - spread_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x, y in byte_parts(whole["text"], 1 << 20):  # an anchor's arrays take some fifty bytes a byte of text
                batch = whole.slice(x, y - x)
                data, starts = _raw(batch["text"])
                view, rows, heads, at = memoryview(np.ascontiguousarray(data)), [], [], []
                for k, places, lows, highs in anchors(data, starts, least):
                    rows.append(np.full(len(places), k))
                    heads += [xxhash.xxh3_64_intdigest(view[p : p + first]) for p in places.tolist()]
                    at.append((places - starts[k]) << 20 | (places - highs) << 10 | (places - lows))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(np.concatenate(rows))), pa.array(np.array(heads, np.uint64).view(np.int64)), pa.array(np.concatenate(at))], names=["key", "head", "at"])

    return texts.mapInArrow(run, "key binary, head long, at long")


# -- runs ------------------------------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    low, high = known, min(len(a), len(b))
    step = 16
    while low < high:
        end = min(low + step, high)
        if a[low:end] != b[low:end]:
            high = end - 1
            while low < high:
                middle = (low + high + 1) // 2
                if a[low:middle] == b[low:middle]:
                    low = middle
                else:
                    high = middle - 1
            return low
        low, step = end, step * 4
    return low


def encode(items: list[tuple], lengths: list[int]) -> bytes:
    """Items (suffix, key, at, left) that each share `lengths` bytes with the one before. The suffix of an anchor with `least`
    bytes after it goes on with the bytes before it, backwards; that of a shorter one ends, and left holds those bytes."""
    heads = np.array([(n, len(s) - n, len(left)) for n, (s, _, _, left) in zip(lengths, items, strict=True)], "<u2").reshape(-1, 3)
    at = np.array([a for _, _, a, _ in items], "<i8")
    return b"".join([len(items).to_bytes(4, "little"), heads.tobytes(), at.tobytes(), *(k for _, k, _, _ in items), *(s[n:] for n, (s, _, _, _) in zip(lengths, items, strict=True)), *(x[3] for x in items)])


def decode(data: bytes) -> Iterator[tuple[int, tuple]]:
    n = int.from_bytes(data[:4], "little")
    heads = np.frombuffer(data, "<u2", 3 * n, 4).reshape(-1, 3).tolist()
    at = np.frombuffer(data, "<i8", n, 4 + 6 * n).tolist()
    keys = 4 + 14 * n
    rest = keys + 16 * n
    left = rest + sum(x[1] for x in heads)
    suffix = b""
    for k, (common, own, before) in enumerate(heads):
        suffix = suffix[:common] + data[rest : rest + own]
        yield common, (suffix, data[keys + 16 * k : keys + 16 * k + 16], at[k], data[left : left + before])
        rest += own
        left += before


def _runs(found: DataFrame, least: int, run_bytes: int) -> DataFrame:
    """(run, block, payload, samples, sample_keys): front-coded blocks of sorted runs, with every 32nd suffix as a sample."""

    def flush(items: list[tuple]) -> Iterator[tuple]:
        items.sort()
        run = int.from_bytes(random_bytes.token_bytes(7), "little")
        block, lengths, size, number, last = [], [], 0, 0, b""
        samples: list[tuple] = []
        for i, item in enumerate(items):
            common = shared(last, item[0]) if block else 0
            block.append(item)
            lengths.append(common)
            size += len(item[0]) - common + len(item[3]) + 30
            last = item[0]
            if i % _EVERY == _EVERY // 2:
                samples.append(item[:2])
            if size >= _BLOCK or i == len(items) - 1:
                yield run, number, encode(block, lengths), [s for s, _ in samples], [k for _, k in samples]
                block, lengths, size, number, samples = [], [], 0, number + 1, []

    def batch_of(row: tuple) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["run", "block", "payload", "samples", "sample_keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0
        for batch in batches:
            data, starts = _raw(batch["text"])
            for k, (key, places) in enumerate(zip(batch["key"].to_pylist(), batch["places"], strict=True)):
                text = data[starts[k] : starts[k + 1]].tobytes()
                for at in places.values.to_numpy().tolist():
                    p, far = at >> 20, at & 1023
                    suffix, left = text[p : p + least], text[p - far : p][::-1]
                    items.append((suffix + left, key, at, b"") if len(suffix) == least else (suffix, key, at, left))
                    size += least + far + 200
                    if size >= run_bytes:
                        yield from map(batch_of, flush(items))
                        items, size = [], 0
        if items:
            yield from map(batch_of, flush(items))

    return found.mapInArrow(run, "run long, block long, payload binary, samples array<binary>, sample_keys array<binary>")


def _splitters(runs: DataFrame, part_bytes: int) -> list[tuple[bytes, bytes]]:
    """Bounds of parts of about part_bytes: at most MOST_PARTS of them, from at most about four samples for each."""
    total, n = runs.agg(F.sum(F.octet_length("payload").cast("long")), F.sum(F.size("samples"))).first()
    parts = min(MOST_PARTS, -(-(total or 0) // part_bytes))
    if parts < 2 or not n:
        return []
    each = runs.select("run", "block", F.explode(F.arrays_zip("samples", "sample_keys")).alias("s"))
    some = each.where(F.pmod(F.xxhash64("run", "block", "s.sample_keys"), F.lit(1 << 20)) < F.lit(int(min(1.0, 4 * parts / n) * (1 << 20)) + 1))
    found = sorted((bytes(r[0]), bytes(r[1])) for r in some.select("s.samples", "s.sample_keys").toLocalIterator())
    return sorted({found[len(found) * i // parts] for i in range(1, parts) if found})


def _dealt(runs: DataFrame, bounds: list[tuple[bytes, bytes]]) -> DataFrame:
    """Blocks cut at the bounds: (part, run, block, payload)."""
    shared_bounds = runs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared_bounds.value
        for batch in batches:
            for number, block, payload in zip(batch["run"].to_pylist(), batch["block"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                pairs = list(decode(payload))
                a, cut = 0, []
                while a < len(pairs):
                    part = bisect.bisect_right(bounds, pairs[a][1][:2])
                    b = bisect.bisect_left(pairs, bounds[part], a, key=lambda x: x[1][:2]) if part < len(bounds) else len(pairs)
                    cut.append((part, number, block, encode([x for _, x in pairs[a:b]], [0, *(n for n, _ in pairs[a + 1 : b])])))
                    a = b
                parts, numbers, blocks, payloads = zip(*cut, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], names=["part", "run", "block", "payload"])

    return runs.select("run", "block", "payload").mapInArrow(run, "part long, run long, block long, payload binary")


# -- merging ---------------------------------------------------------------------------------------------------------


def _run_items(blocks: list[bytes]) -> Iterator[tuple[int, tuple]]:
    last = None
    for data in blocks:
        for k, (common, item) in enumerate(decode(data)):
            yield (shared(last, item[0]) if not k and last is not None else common), item
            last = item[0]


def merge_runs(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """One sorted sequence of (bytes shared with the item before, item) by a tree of losers.

    Every loser carries the length that it shares with the winner it lost to. On the way up from the last winner's leaf all
    those winners are the last item put out, so of two lengths the longer one belongs to the smaller item, and bytes are
    compared only where the lengths are equal, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    item: list = [None] * size
    common = [0] * size
    for k, run in enumerate(runs):
        common[k], item[k] = next(run, (0, None))

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = item[a], item[b]
        if y is None or x is None:
            return (b, a) if x is None else (a, b)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        s, t = x[0], y[0]
        n = shared(s, t, common[a])
        if n == len(s) or n == len(t):
            less = x < y
        else:
            less = s[n] < t[n]
        winner, loser = (a, b) if less else (b, a)
        common[loser] = n
        return winner, loser

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while item[top] is not None:
        yield common[top], item[top]
        common[top], item[top] = next(runs[top], (0, None))
        node = (size + top) // 2
        while node:
            top, losers[node] = play(losers[node], top)
            node //= 2


def classes(merged: Iterator[tuple[int, tuple]], first: int) -> Iterator[tuple[list[int], list[tuple]]]:
    """Runs of items that share their first bytes, with the length that each shares with the one before; repeats of one anchor
    (from other tasks that held the same text) are left out."""
    lengths: list[int] = []
    items: list[tuple] = []
    for common, item in merged:
        if items and item[1:3] == items[-1][1:3] and item[0] == items[-1][0]:
            continue
        if common < first and items:
            yield lengths, items
            lengths, items = [], []
        lengths.append(common if items else 0)
        items.append(item)
    if items:
        yield lengths, items


def resolve(lengths: list[int], items: list[tuple], least: int, whole: bool, most: int = MOST_CONTEXTS) -> Iterator[tuple[bytes, int, int, bytes | None]]:
    """(key, start, end, None) of repeated strings of a class. Where the class isn't whole or too varied, also
    (key, start, end, hash) of the windows that have to be looked up elsewhere."""
    contexts: dict[tuple, list[tuple]] = {}
    wanted_low, wanted_high = 1 << 30, -1
    for k, (suffix, key, at, left) in enumerate(items):
        p, near, far = at >> 20, at >> 10 & 1023, at & 1023
        after = min(len(suffix), least)
        best = max(lengths[k], lengths[k + 1] if k + 1 < len(items) else 0)
        low = max(near, least - after)
        if best >= least:
            if (d := min(best - least, far)) >= near:
                yield key, p - d, p - near + least, None
            low = max(low, best - least + 1)
        else:
            low = max(low, least - best)
        if low <= far:
            wanted_low, wanted_high = min(wanted_low, low), max(wanted_high, far)
        contexts.setdefault((suffix, left), []).append((key, p, near, far, after))
    if whole and wanted_high < 0:
        return
    send = not whole or len(contexts) > most
    seen: dict[bytes, int] = {}
    hashes: list[tuple] = []
    for (suffix, left), own in contexts.items():
        key, p, near, far, after = own[0]
        before = (suffix[least:] if after == least else left)[::-1]
        if len(own) > 1:  # the same on both sides: repeated as far as its windows reach
            for key, p, near, far, after in own:
                if max(near, least - after) <= far:
                    yield key, p - far, p - max(near, least - after) + least, None
        text = before + suffix[:after]
        for d in range(max(near, least - after, 0 if send else wanted_low), min(far, 1 << 30 if send else wanted_high) + 1):
            h = xxhash.xxh3_128_digest(text[far - d : far - d + least])
            if send:
                yield key, p - d, p - d + least, h
            else:
                seen[h] = seen.get(h, 0) + len(own)
                hashes.append((h, key, p - d))
    for h, key, start in hashes:
        if seen[h] > 1:
            yield key, start, start + least, None


def _merged(dealt: DataFrame, bounds: list[tuple[bytes, bytes]], least: int, most: int) -> DataFrame:
    first = least - spread_of(least) + 1
    shared_bounds = dealt.sparkSession.sparkContext.broadcast([s[:first] for s, _ in bounds])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cuts = key[0].as_py(), shared_bounds.value
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for number, block, payload in zip(batch["run"].to_pylist(), batch["block"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                blocks.setdefault(number, []).append((block, payload))
        runs = [_run_items([data for _, data in sorted(own)]) for own in blocks.values()]
        open_at = {cuts[k] for k in (part - 1, part) if 0 <= k < len(cuts)}
        rows: list[tuple] = []
        for lengths, items in classes(merge_runs(runs), first):
            whole = items[0][0][:first] not in open_at
            if len(items) > 1 or not whole:
                rows += resolve(lengths, items, least, whole, most)
            if len(rows) > 20_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    return dealt.groupBy("part").applyInArrow(run, "key binary, start long, end long, window binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "start", "end", "window"])


# -- the operator ----------------------------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, least: int = LEAST, run_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(key, spans): per different text the repeated strings as an array of (start, end) in bytes, which may overlap; without
    those that only copies of the same text share."""
    texts = _once(docs, least)
    found = saved(_anchor_rows(texts, least), "anchors")
    place = F.xxhash64("key", "at")
    again = saved(found.groupBy("head").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("head"), "heads")  # so that a hot head's join can be split
    places = found.join(again, "head", "left_semi").groupBy("key").agg(F.collect_set("at").alias("places"))
    runs = saved(_runs(texts.join(places, "key"), least, run_bytes), "runs")
    bounds = _splitters(runs, part_bytes)
    merged = saved(_merged(_dealt(runs, bounds), bounds, least, most_contexts), "matches")
    windows = merged.where("window IS NOT NULL")
    place = F.xxhash64("key", "start")
    twice = saved(windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("window"), "windows")
    spans = merged.where("window IS NULL").unionByName(windows.join(twice, "window", "left_semi").select(*merged.columns))
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _united(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return out


def _cut(texts: DataFrame, keep: bool) -> DataFrame:
    """Of (key, text, spans): n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch["key"], batch["text"], batch["spans"], strict=True):
                if (key := key.as_py()) in seen:
                    continue
                seen.add(key)
                data, at, kept, gone = text.as_buffer().to_pybytes(), 0, [], _united(spans.as_py())
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((key, len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), *([rest] if keep else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (4 + keep)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + keep])

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def _result(docs: DataFrame, least: int, keep: bool, columns: list, **options) -> DataFrame:
    spans = repeated_spans(docs, least, **options)
    cut = _cut(_once(docs, least).join(spans, "key"), keep).dropDuplicates(["key"])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*columns).alias("_row"), F.sha2(text.cast("binary"), 256).alias("_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("key", F.unhex(F.substring("_digest", 1, 32)))
    copies = rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("_copied"))
    out = rows.join(copies, "key", "left").join(cut, "key", "left")
    gone = F.coalesce("_copied", F.lit(False)) & (F.col("n_bytes") >= least)
    return out.select(
        "_row.*",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "_digest")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", F.col("_row.text").cast("binary"), F.lit(b""))).alias("kept")] if keep else []),
    )


def remove_repeats(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """docs with the bytes that are left of each text (kept: a cut may fall inside a character), and n_bytes, n_removed, n_spans
    and kept_sha256 of the text. Columns of docs with these names give way."""
    new = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}
    return _result(docs, least, True, [F.col(c) for c in docs.columns if c not in new], **options)


def suffix_dedup_digest(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return _result(docs, least, False, [F.col("doc_id").cast("long").alias("doc_id")], **options)
