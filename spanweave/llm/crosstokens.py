"""Alignment of two tokenizers' tokens by an event sweep.

Both tokenizers cut the same bytes (a space and the text), so a token is known by the offset where it ends. The end events of
both sides, packed in blocks that begin and end where both sides do, are united, dealt by text, sorted by offset within their
partition and swept: the state is one block and a running digest, however long the text. An end on one side alone ends a link,
an end on both ends a link and a group; each stretch between two ends is the link of the two tokens that cover it.

How often two ids are linked in the corpus is counted where texts are tokenized: they fall into units at whose borders both
sides must end, so a task sweeps each different unit of a batch once and weighs its links by how often the unit comes. The table of pairs goes to
the sweep's tasks if it has at most `most_pairs` rows; beyond that, the links of a block are joined with it instead.

Null and empty texts, and texts that the tokens of a side don't spell byte by byte, have no tokens: zeros, and an empty digest.
Equal texts have equal results and are swept once; rows with a null or repeated doc_id each give a row, an empty table none.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.arrow import byte_parts, small_batches
from spanweave.session import saved

A_FILE, B_FILE, MOST_PAIRS, BLOCK_TOKENS, CHUNK_BYTES = "byte_bpe_50k.json", "piece_bpe_32k.model", 1 << 22, 1 << 15, 4_000_000
_SAFE = r"[\pL\pN\pP\pS\pM]"  # neither white space nor a control to any tokenizer


class Sides:
    """The two tokenizers of a task."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        a_file, b_file = (x if os.sep in x else public_tokenizers.path(x) for x in (a_file, b_file))
        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(plain)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, k in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[k] = bytes(byte_of[c] for c in piece)
        n = self.b.vocab_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        #: No piece goes on over a space or a line end, so texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for k, p in enumerate(pieces) if not self.b.is_byte(k))
        self.space = self.b.piece_to_id("▁")
        self.a_long, self.b_long = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), n) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.a_ids = self._ranked(a_file, public_tokenizers.PATTERN) or (lambda text: self.a.encode(text, add_special_tokens=False).ids)

    def _ranked(self, a_file: str, pattern: str):
        """The same encoding by ranks, which takes a fifth of the time; none unless the file is plain byte-level merges whose
        order is that of their ids."""
        import tiktoken

        with open(a_file) as f:
            all_of = json.load(f)
        model, split = all_of["model"], all_of["pre_tokenizer"] or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not all_of["normalizer"]
        if model["type"] != "BPE" or not usual or merged != [*range(256, 256 + len(merged))]:
            return None
        ranks = {x: k for k, x in enumerate(self.a_bytes) if x}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _one(self, unit: str) -> tuple[list[int], list[int], bool]:
        x, y = self.a_ids(unit), self.b.encode(unit[1:] if unit[0] == " " else unit)
        if unit[0] != " ":  # before a line end the space that B adds is a token of its own
            y = y[1:] if y and y[0] == self.space else []
        return x, y, b"".join(map(self.a_bytes.__getitem__, x)) == unit.encode() == b"".join(map(self.b_bytes.__getitem__, y))

    def _many(self, units: pa.Array) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Of each side the ids of units encoded as one text, and the number of each unit's; None if they don't spell them. B adds
        the space before the first."""
        data, starts = _raw(units)
        text = b" a" + data.tobytes()
        ends, string, out = np.array(starts) + 2, text.decode(), []
        for ids, table, long in ((self.a_ids(string), self.a_bytes, self.a_long), (self.b.encode(string[1:]), self.b_bytes, self.b_long)):
            spelled = b"".join(map(table.__getitem__, ids)) == text
            ids = np.array(ids, "<u2")
            places = np.cumsum(long[ids])
            at = np.searchsorted(places, ends)
            if not spelled or (places[at] != ends).any():
                return None
            out.append((ids[at[0] + 1 :], np.diff(at)))
        return out

    def encoded(self, texts: pa.Array, together: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers of units in a row, where texts begin, the units' flags, and of each side the units' ids in a row and how many
        each has. A text with a unit that isn't spelled becomes one unit, and is judged as a whole."""
        units, number, offsets = self.units(texts)
        used, number = np.unique(number, return_inverse=True)  # words that are only parts of units are none
        units = units.take(pa.array(used))
        safe = pc.match_substring_regex(units, rf"(?s)\A[ \n]{_SAFE}(.*{_SAFE})?\z").to_numpy(zero_copy_only=False).astype(bool) & self.cuts
        order = np.concatenate([np.flatnonzero(safe), np.flatnonzero(~safe)])  # safe borders: many units can be one text
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        units, number, n = units.take(pa.array(order)), place[number], int(safe.sum())
        parts: list[list[tuple]] = [[], []]
        good = np.ones(len(units), bool)

        def alone(a: int, b: int) -> None:
            found = [self._one(u) for u in units.slice(a, b - a).to_pylist()]
            good[a:b] = [x[2] for x in found]
            for side in (0, 1):
                parts[side].append((np.array([i for x in found for i in x[side]], "<u2"), np.array([len(x[side]) for x in found], np.int64)))

        for k in range(0, n, together):
            end = min(k + together, n)
            if (found := self._many(units.slice(k, end - k))) is None:
                alone(k, end)
                continue
            for side in (0, 1):
                parts[side].append(found[side])
        alone(n, len(units))
        bad = np.unique(np.searchsorted(offsets, np.flatnonzero(~good[number]), "right") - 1)
        if len(bad):
            odd, sizes, rows = set(bad.tolist()), np.diff(offsets), []
            found = [self._one(" " + texts[k].as_py()) for k in bad.tolist()]
            for k in range(len(texts)):
                own = number[offsets[k] : offsets[k + 1]]
                if k in odd:
                    own = np.array([len(units) + int(np.searchsorted(bad, k))])
                sizes[k] = len(own)
                rows.append(own)
            number, offsets = np.concatenate(rows), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            good = np.concatenate([good, np.array([x[2] for x in found], bool)])
            for side in (0, 1):
                parts[side].append((np.array([i for x in found for i in x[side]], "<u2"), np.array([len(x[side]) for x in found], np.int64)))
        return number, offsets, good, [tuple(np.concatenate(x) for x in zip(*own, strict=True)) for own in parts]

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different units of texts, the number of each unit in a row, and where a text's units begin (one more than texts)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")  # a word that begins with a line end has no space before it
        words = split.flatten().dictionary_encode()
        code, offsets = words.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        names = words.dictionary
        units = pc.if_else(pc.starts_with(names, "\n"), names, pc.binary_join_element_wise(" ", names, ""))
        if not len(code):
            return units, code, offsets
        opens = pc.match_substring_regex(names, rf"\A\n?{_SAFE}").to_numpy(zero_copy_only=False)
        closes = pc.match_substring_regex(names, rf"{_SAFE}\z").to_numpy(zero_copy_only=False)
        begin = np.zeros(len(code), bool)
        if self.cuts:
            begin[1:] = closes[code[:-1]] & opens[code[1:]]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begin)
        number = code[at]
        ends = np.append(at[1:], len(code))
        if len(at) < len(code):
            ids: dict[str, int] = {}
            for k in np.flatnonzero(ends - at > 1).tolist():
                unit = "".join(units.take(pa.array(code[at[k] : ends[k]])).to_pylist())
                number[k] = len(names) + ids.setdefault(unit, len(ids))
            units = pa.concat_arrays([units, pa.array(list(ids), pa.string())])
        return units, number, np.searchsorted(at, offsets)


def _raw(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """A column of texts as their bytes in a row, and where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).tolist()


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_file: str, b_file: str) -> Sides:
    """One per Python worker."""
    if (a_file, b_file) not in _SIDES:
        _SIDES[a_file, b_file] = Sides(a_file, b_file)
    return _SIDES[a_file, b_file]


def _laid_out(number: np.ndarray, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in a row, and where each unit's begin (one more than units)."""
    first, long = np.cumsum(size) - size, size[number]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(long)])
    return flat[np.repeat(first[number] - ends[:-1], long) + np.arange(ends[-1])], ends


# -- the sweep -------------------------------------------------------------------------------------------------------


def sweep(a: np.ndarray, b: np.ndarray, a_long: np.ndarray, b_long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of both sides over the same bytes: the tokens of each link (two arrays of places), and which tokens of A and B
    end a group."""
    ends = np.concatenate([np.cumsum(a_long[a]), np.cumsum(b_long[b])])
    order = np.argsort(ends, kind="stable")  # of equal ends A's comes first
    ends, from_a = ends[order], order < len(a)
    both = np.zeros(len(ends), bool)
    both[:-1] = ends[1:] == ends[:-1]
    seen_a, seen_b = np.cumsum(from_a) - from_a, np.cumsum(~from_a) - ~from_a
    keep = np.ones(len(ends), bool)
    keep[1:] = ~both[:-1]
    a_last, b_last = both[from_a], np.concatenate([np.zeros(1, bool), both[:-1]])[~from_a]
    return seen_a[keep], seen_b[keep], a_last, b_last


_SEPARATED: list[pa.Array] = []


def _written(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, b_ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Groups as text (a1,a2|b1;...), and where the text of each block ends; b_ends: the number of B's tokens up to each block's end."""
    if not _SEPARATED:
        _SEPARATED.append(pa.array([f"{k}{s}" for s in (",", "|", ";", "") for k in range(1 << 16)], pa.large_string()))
    group_a, group_b = 2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1
    order = np.argsort(np.concatenate([group_a, group_b]), kind="stable")
    sign_b = np.where(b_last, 2, 0)
    sign_b[b_ends - 1] = 3
    which = np.concatenate([a + (np.where(a_last, 1, 0) << 16), b + (sign_b << 16)])[order]
    text = _SEPARATED[0].take(pa.array(which))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    offsets = np.frombuffer(text.buffers()[1], np.int64)
    return memoryview(text.buffers()[2]), offsets[place[len(a) + b_ends - 1] + 1]


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 16 | b


# -- events ----------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"))


def end_events(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, start, side, ids). Sides 0 and 1: the end events of A and B in blocks from byte `start` on; an event's offset is the
    start plus the bytes of the ids (two bytes each, packed by zstd) up to it. A task gives a text's events once, however often the text comes. Side 2: pairs of
    ids and how often a task's texts link them, copies included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, pairs, counts = sides(a_file, b_file), set(), [], []
        for batch in batches:
            new = []
            for key in batch["key"].to_pylist():
                new.append(key not in seen)
                seen.add(key)
            for x, y in byte_parts(batch["text"], CHUNK_BYTES):
                part = batch.slice(x, y - x)
                number, offsets, good, both = own.encoded(part["text"])
                used = np.flatnonzero(good)
                if len(used):
                    found = _linked(own, used, np.bincount(number, minlength=len(good))[used], both)
                    pairs.append(found[0])
                    counts.append(found[1])
                yield blocks(own, part["key"].to_pylist(), new[x:y], number, offsets, good, both)
                if sum(map(len, pairs)) > 2_000_000:
                    pairs, counts = _summed(pairs, counts)
                    if len(pairs[0]) > 1_000_000:
                        yield count_rows(pairs, counts)
                        pairs, counts = [], []
        if pairs:
            yield count_rows(*_summed(pairs, counts))

    def count_rows(pairs: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        return event_rows([b""], [len(pairs[0])], [2], [pairs[0].astype("<i8").tobytes() + counts[0].astype("<i8").tobytes()])

    def event_rows(keys: list, starts: list, side: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], names=["key", "start", "side", "ids"])

    def blocks(own: Sides, texts: list[bytes], new: list[bool], number: np.ndarray, offsets: np.ndarray, good: np.ndarray, both: list) -> pa.RecordBatch:
        (ids_a, ends_a), (ids_b, ends_b) = (_laid_out(number, *x) for x in both)
        place = np.concatenate([np.zeros(1, np.int64), np.cumsum(own.b_long[ids_b])])[ends_b]
        whole = np.add.reduceat(~good[number], offsets[:-1]) == 0 if len(number) else []
        keys, starts, side, ids, packer = [], [], [], [], zstandard.ZstdCompressor(level=1)
        for k, key in enumerate(texts):
            u, end = int(offsets[k]), int(offsets[k + 1])
            if not new[k] or not whole[k]:
                continue
            first = place[u]
            while u < end:
                v = min(end, max(u + 1, int(np.searchsorted(ends_a, ends_a[u] + block_tokens, "right")) - 1))
                keys += [key, key]
                starts += [int(place[u] - first)] * 2
                side += [0, 1]
                ids += [packer.compress(ids_a[ends_a[u] : ends_a[v]].tobytes()), packer.compress(ids_b[ends_b[u] : ends_b[v]].tobytes())]
                u = v
        return event_rows(keys, starts, side, ids)

    small_batches(docs.sparkSession)
    return _keyed(docs.where("text <> ''"), "text").mapInArrow(run, "key binary, start long, side int, ids binary")


def _linked(own: Sides, used: np.ndarray, weight: np.ndarray, both: list) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that units link, and how often, if each unit comes `weight` times."""
    (ids_a, _), (ids_b, ends) = (_laid_out(used, *x) for x in both)
    at_a, at_b, _, _ = sweep(ids_a, ids_b, own.a_long, own.b_long)
    pairs, counts = _summed([_codes(ids_a[at_a], ids_b[at_b])], [weight[np.searchsorted(ends, at_b, "right") - 1]])
    return pairs[0], counts[0]


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return [found], [np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)]  # exact below 2^53


def pair_counts(events: DataFrame) -> DataFrame:
    """(pair, n, best): per pair of ids (a * 65536 + b) its links in the corpus, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["ids"].to_pylist():
                pair, n = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    total = saved(events.where("side = 2").select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    total = total.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFF)))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def swept(events: DataFrame, pairs: DataFrame | None, a_file: str = A_FILE, b_file: str = B_FILE, chunk_tokens: int = 1 << 19) -> DataFrame:
    """Per block: key, n_a, n_b, n_groups, n_links; the digest of a text's groups with its last block. With a table of pairs also
    n_best and count_sum; without one, the block's pairs and how often each comes."""
    table = None
    if pairs is not None:
        rows = pairs.orderBy("pair").toArrow()  # at most most_pairs rows
        table = events.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, unpack = sides(a_file, b_file), {"key": None, "sha": None}, zstandard.ZstdDecompressor().decompress
        waiting: list[tuple] = []  # (key, A's ids, B's ids)
        size, last, a = 0, None, b""
        for batch in batches:
            for key, start, side, ids in zip(batch["key"].to_pylist(), batch["start"].to_pylist(), batch["side"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if last == (key, start, side):  # also from another task that held the same text
                    continue
                last = (key, start, side)
                ids = unpack(ids)
                if side == 0:
                    a = ids
                else:
                    waiting.append((key, a, ids))
                    size += len(a) + len(ids)
                    if size > 2 * chunk_tokens:
                        yield chunk(own, state, waiting)
                        waiting, size = [], 0
        yield chunk(own, state, waiting, True)

    def chunk(own: Sides, state: dict, waiting: list[tuple], end: bool = False) -> pa.RecordBatch:
        rows: list[tuple] = []
        if waiting:
            a, b = (np.frombuffer(b"".join(x[k] for x in waiting), "<u2").astype(np.int64) for k in (1, 2))
            ends_a, ends_b = (np.cumsum([len(x[k]) // 2 for x in waiting]) for k in (1, 2))
            at_a, at_b, a_last, b_last = sweep(a, b, own.a_long, own.b_long)
            text, ends_text = _written(a, b, a_last, b_last, ends_b)
            pair = _codes(a[at_a], b[at_b])
            ends_link = np.searchsorted(at_b, ends_b)
            groups = np.cumsum(b_last)[ends_b - 1]
            if table is not None:
                known, n, best = table.value
                at = np.searchsorted(known, pair)
                sums = [np.cumsum(x)[ends_link - 1] for x in (best[at].astype(np.int64), n[at])]
            x = y = g = l = t = 0
            for k, (key, *_) in enumerate(waiting):
                if state["key"] != key:
                    rows += finished(state)
                    state["key"], state["sha"] = key, hashlib.sha256()
                else:
                    state["sha"].update(b";")
                state["sha"].update(text[t : ends_text[k]])
                row = [key, ends_a[k] - x, ends_b[k] - y, groups[k] - g, ends_link[k] - l, None]
                if table is not None:
                    row += [s[k] - (s[k - 1] if k else 0) for s in sums]
                else:
                    found, times = np.unique(pair[l : ends_link[k]], return_counts=True)
                    row += [found.tolist(), times.tolist()]
                rows.append(tuple(row))
                x, y, g, l, t = ends_a[k], ends_b[k], groups[k], ends_link[k], ends_text[k]
        if end:
            rows += finished(state)
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), *([pa.int64()] * 2 if table is not None else [pa.list_(pa.int64())] * 2)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def finished(state: dict) -> list[tuple]:
        if state["key"] is None:
            return []
        nothing = (0, 0) if table is not None else ([], [])
        return [(state["key"], 0, 0, 0, 0, state["sha"].hexdigest(), *nothing)]

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["n_best", "count_sum"] if table is not None else ["pairs", "times"])]
    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("n_best long, count_sum long" if table is not None else "pairs array<long>, times array<long>")
    return events.where("side < 2").repartition("key").sortWithinPartitions("key", "start", "side").mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most_pairs: int = MOST_PAIRS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    events = saved(end_events(docs, a_file, b_file, block_tokens), "events")
    pairs = saved(pair_counts(events), "pairs")
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    if pairs.count() <= most_pairs:
        blocks = swept(events, pairs, a_file, b_file)
        sums += ["n_best", "count_sum"]
        found = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums], F.max("groups_sha256").alias("groups_sha256"))
    else:
        blocks = saved(swept(events, None, a_file, b_file), "links")
        each = blocks.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        each = each.groupBy("key", "pair").agg(F.sum("times").alias("times")).join(pairs, "pair")
        worth = each.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        found = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums], F.max("groups_sha256").alias("groups_sha256")).join(worth, "key")
        sums += ["n_best", "count_sum"]
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(found, "key", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
