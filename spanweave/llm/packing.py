"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids and an end id, longer ones pieces of `capacity` tokens. Only the histogram of piece lengths (as
many rows as the capacity) reaches the driver. There, a covering program whose columns are configurations (multisets of
length classes that fit a sequence) is solved by multiplicative weights, priced by knapsack dynamic programming, until the
solution is within GAP of the dual's bound or ROUNDS rounds are over. Half of the solution is rounded to whole sequences, the fullest configurations
first, each sequence's shortest piece being exchanged for the longest one that fits; then the program of what is left is
solved, and so on for PASSES passes. The few pieces then left go best-fit, longest first, into gaps or new sequences. All of this works
on runs of equal sequences, so its cost follows the number of lengths, not of documents. Pieces then look up their place by
their rank among the pieces of their length; ranks are counted per (length, shard), so a hot length is no hot task.

Null and empty texts are one end id. Repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.arrow import small_batches
from spanweave.session import saved

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
WORDS_KEPT, BYTES_AT_ONCE = 200_000, 2_000_000  # of a task; half of both where ids go out as well
CLASSES, GAP, PASSES, ROUNDS = 192, 0.05, 7, 150  # of the configuration program
_PUNCTUATION = ".,!?;:&%$#*"  # trailing signs that are split off
_SMALL = "a-zß-öø-ÿ"  # small Latin letters, which neither compose with each other nor change in lower case
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_RUNS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


_MARKED: list[str] = []


def _marked() -> str:
    """A class of the letters that are more than letters in the tokenizer's normal form (composed and in lower case)."""
    if not _MARKED:
        odd = [c for c in map(chr, range(0x80, 0x32000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
        _MARKED.append("[" + "".join(odd) + "]")
    return _MARKED[0]


def _reached(pairs: list[tuple[int, int]], first: int) -> bool:
    """Whether merging the lowest pair again and again makes each token (the k-th pair's is first + k) from its own bytes by its
    own pair last. Then two neighbours that spell a token are always that token's pair, so a pair is known by its bytes."""
    made = {pair: first + k for k, pair in enumerate(pairs)}
    if len(made) != len(pairs):
        return False
    for k, (a, b) in enumerate(pairs):
        if max(a, b) >= first + k:
            return False
        lowest = first + k  # the pair must be able to stand side by side until its turn: undo both, the later merge first
        while a >= first or b >= first:
            if made.get((a, b), lowest) < lowest:
                return False
            if b >= first and (a < first or a <= b):
                lowest, b = b + 1, pairs[b - first][0]
            else:
                lowest, a = a, pairs[a - first][1]
        if made.get((a, b), lowest) < lowest:
            return False
    return True


def _by_ranks(path: str):
    """An encoder by ranks of words of small Latin letters that each end in a space, and which ids end a word. None unless the
    tokenizer leaves such words alone and merges their bytes in the order of its ids. The space stands for the end of a word:
    a word's last byte and it are one symbol, whose id is below those of all merges."""
    import tiktoken

    with open(path) as f:
        whole = json.load(f)
    model, end = whole["model"], whole["model"].get("end_of_word_suffix")
    usual = model["type"] == "BPE" and end and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    if not usual or whole["normalizer"] != _NORMAL or whole["pre_tokenizer"] != _RUNS or any(len(t["content"]) < 2 or t["content"].isalpha() for t in whole["added_tokens"]):
        return None
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in letters]
    byte = {chr(c): x for c, x in zip([*letters, *range(256, 256 + len(rest))], [*letters, *rest], strict=True)}
    vocab, ranks = model["vocab"], {}
    for token, k in vocab.items():
        ranks[bytes(map(byte.__getitem__, token.removesuffix(end))) + b" " * token.endswith(end)] = k
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = len(vocab) - len(pairs)
    if first != 512 or len(ranks) != len(vocab) or [vocab.get(a + b) for a, b in pairs] != [*range(first, len(vocab))]:
        return None
    if any(vocab.get(c + e, first) >= first for c in byte for e in ("", end)) or not _reached([(vocab[a], vocab[b]) for a, b in pairs], first):
        return None
    ends = np.zeros(len(vocab), bool)
    ends[[k for token, k in vocab.items() if token.endswith(end)]] = True
    return tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), ends


class WordIds:
    """Token ids of texts, with the ids of words kept from one call to the next.

    The tokenizer drops white space and no token, composition or case rule reaches across an ASCII space, so a text's ids
    are those of its words. A word of letters that stay letters when composed and in lower case (a capital I with a dot becomes
    a letter and a mark, which joins the signs after it) with trailing punctuation is two runs to the tokenizer, so both count
    as units of their own. Arrow splits texts and finds the different words; each different unit of a call is encoded once,
    words of Latin letters by ranks if the tokenizer allows it, which takes less time than to keep them.
    At most about `most` other units are kept; beyond that the store starts anew.
    """

    def __init__(self, path: str, most: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {"": b""}
        self.ranked = _by_ranks(path)

    def _each(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, (np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)), strict=True))

    def _letters(self, words: list[str], many: int = 2000) -> None:
        """Words of letters are one run each, so many can be one text, and its runs are theirs."""
        for a in range(0, len(words), many):
            some = words[a : a + many]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.flatnonzero(np.diff(np.asarray(found.word_ids, np.int64), prepend=-1))
            if len(starts) != len(some):  # a letter that becomes more than letters in lower case
                self._each(some)
                continue
            data = np.asarray(found.ids, "<u4").tobytes()
            ends = [*(4 * starts[1:]).tolist(), len(data)]
            self.known.update(zip(some, map(data.__getitem__, map(slice, (4 * starts).tolist(), ends)), strict=True))

    def _kept(self, units: list[str]) -> list[bytes]:
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {"": b""}
            new = [u for u in units if u]
        letters = [u.isalpha() for u in new]
        self._letters([u for u, x in zip(new, letters, strict=True) if x])
        self._each([u for u, x in zip(new, letters, strict=True) if not x])
        return [self.known[u] for u in units]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different units in a row, how many each has, and the order in which the units stand there."""
        plain = np.zeros(len(units), bool)
        if self.ranked:
            plain = pc.match_substring_regex(units, rf"\A[{_SMALL}]+\z").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        ids = self._kept(units.take(pa.array(order[n:])).to_pylist())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        if n:
            encoding, ends = self.ranked
            fast = encoding.encode_to_numpy(" ".join([*units.take(pa.array(order[:n])).to_pylist(), ""]))
            flat = np.concatenate([fast.astype("<u4", copy=False), flat])
            sizes = np.concatenate([np.diff(np.flatnonzero(ends[fast]), prepend=-1).astype(np.int32), sizes])
        return flat, sizes, order

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the places where a text's ids begin (one more than texts)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        found = pc.extract_regex(words.dictionary, rf"\A(?P<a>\pL*)(?P<b>[{_PUNCTUATION}]*)\z")
        two = found.is_valid()
        stem = pc.struct_field(found, "a")
        two = pc.and_(two, pc.invert(pc.fill_null(pc.match_substring_regex(stem, _marked()), True)))
        stem = pc.if_else(two, stem, words.dictionary)
        latin = pc.match_substring_regex(stem, rf"\A[A-ZÀ-ÖØ-Þ{_SMALL}]*\z")
        stem = pc.if_else(pc.and_(two, latin), pc.utf8_lower(stem), stem)
        units = pa.concat_arrays([stem, pc.if_else(two, pc.struct_field(found, "b"), "")]).dictionary_encode()
        flat, sizes, order = self._units(units.dictionary)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        of, n = place[units.indices.to_numpy()], len(words.dictionary)
        codes = words.indices.to_numpy()
        own = np.empty(2 * len(codes), np.int32)
        own[0::2], own[1::2] = of[:n][codes], of[n:][codes]
        long = sizes[own]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(long, dtype=np.int32)])  # a batch has less than 2 GB, so fewer ids than 2^31
        at = np.repeat(first[own] - ends[:-1], long)
        at += np.arange(ends[-1], dtype=np.int32)
        offsets = split.offsets.to_numpy()
        return flat[at], ends[2 * (offsets - offsets[0])].astype(np.int64)

    def forget(self) -> None:
        self.known = {"": b""}

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text]))[0].tobytes()


_TOKENS: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """One per Python worker. name: a file of the public tokenizers, or a path."""
    if name not in _TOKENS:
        import public_tokenizers

        _TOKENS[name] = WordIds(name if os.sep in name else public_tokenizers.path(name))
    return _TOKENS[name]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian 32-bit) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, half = word_ids(tokenizer), 1 + with_ids
        ids_of.most = WORDS_KEPT // half
        try:
            for batch in batches:
                sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
                for a, b in _parts(sizes, BYTES_AT_ONCE // half):
                    yield _pieces_of(batch["doc_id"].slice(a, b - a), *ids_of.many(batch["text"].slice(a, b - a)), capacity, names)
        finally:  # a worker serves many tasks, of other operators too
            ids_of.forget()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _pieces_of(docs: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, names: list[str]) -> pa.RecordBatch:
    """The pieces of documents whose ids lie between the bounds; each document gets its end id here."""
    flat = np.insert(ids, bounds[1:], END_ID).astype("<u4", copy=False)
    bounds = bounds + np.arange(len(bounds))
    long = np.diff(bounds)
    count = -(-long // capacity)
    of = np.repeat(np.arange(len(long)), count)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(long[of] - start, capacity)
    begin = bounds[of] + start
    data = memoryview(flat).cast("B")
    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    out = [docs.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    if len(names) > len(out):  # pieces follow each other without a gap
        offsets = pa.array(np.append(4 * begin, 4 * len(flat)), pa.int64())
        out.append(pa.Array.from_buffers(pa.large_binary(), len(of), [None, offsets.buffers()[1], pa.py_buffer(flat)]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=names)


def _parts(ends: np.ndarray, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, or of one row."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


# -- the plan, from the histogram ------------------------------------------------------------------------------------


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity from 0 on the highest value of items (any number of each; weights ascending), and the item that
    reaches it last (-1: none, the value is that of the capacity below)."""
    least, pad = int(weights[0]), int(weights[-1])
    best, choice = np.full(pad + capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[pad] = 0.0
    for b in range(1, capacity + 1, least):  # what `least` cells in a row need lies before them
        c = np.arange(b, min(b + least, capacity + 1))
        tried = best[pad + c[:, None] - weights] + values
        j = tried.argmax(1)
        top = tried[np.arange(len(c)), j]
        own = np.maximum.accumulate(np.concatenate([best[pad + b - 1 : pad + b], top]))
        choice[c] = np.where(top > own[:-1], j, -1)
        best[pad + c] = own[1:]
    return best[pad:], choice


def best_configuration(weights: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each item (by position) have the highest value within the capacity."""
    choice, out, c = knapsack(weights, values, capacity)[1], Counter(), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[int(choice[c])] += 1
            c -= int(weights[choice[c]])
    return dict(out)


def configurations(weights: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """Row k: how many of each item the best configuration with at least one item k holds, from knapsack()'s choices."""
    rows = np.eye(len(weights), dtype=np.int64)
    filled = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))  # the next capacity below with a choice
    at = filled[capacity - weights]
    while (live := np.flatnonzero(at > 0)).size:
        j = choice[at[live]]
        rows[live, j] += 1
        at[live] = filled[at[live] - weights[j]]
    return rows


def solve_configurations(weights: np.ndarray, demand: np.ndarray, capacity: int, rounds: int | None = None, gap: float = GAP, rate: float = 0.5, slack: float = 0.05) -> tuple[dict[tuple, float], float]:
    """min sum x, each class covered, by multiplicative weights: a class's price is its share of a sequence, lowered by the
    factor exp(-rate) for every time that its demand has been covered. A round prices all configurations by one knapsack,
    takes for each class the best one that holds it if its worth is within `slack` of the best of all, and raises them so
    that no class is covered more than once over. Prices that are scaled to the best worth are a dual solution, so each
    round gives a lower bound, and the cover so far, scaled to the least covered class, is a solution.

    Returns configurations ((class, count), ...) with their x, and the best bound. Ends when sum x is at most (1 + gap) times
    the bound (or after `rounds` rounds, if given).
    """
    n, base = len(weights), weights / capacity
    cover, taken, total, bound, done = np.zeros(n), {}, 0.0, 0.0, 0
    while rounds is None or done < rounds:
        done += 1
        price = base * np.exp(-rate * (cover - cover.min()))
        best, choice = knapsack(weights, price, capacity)
        bound = max(bound, float(price @ demand) / best[capacity])
        rows = configurations(weights, choice, capacity)
        own = np.flatnonzero(rows @ price >= (1 - slack) * best[capacity])
        rows = rows[own]
        amount = demand[own] / rows[np.arange(len(own)), own]
        amount /= (amount @ rows / demand).max()
        for row, x in zip(rows, amount.tolist(), strict=True):
            config = row.tobytes()
            taken[config] = taken.get(config, 0.0) + x
        cover += amount @ rows / demand
        total += float(amount.sum())
        if cover.min() > 0 and total <= (1 + gap) * bound * cover.min():
            break
    out = {}
    for config, x in taken.items():
        row = np.frombuffer(config, np.int64)
        out[tuple((int(k), int(row[k])) for k in np.flatnonzero(row))] = x / max(float(cover.min()), 1e-12)
    return out, bound


def length_classes(counts: dict[int, int], capacity: int, grid: int = 1, most: int = CLASSES) -> dict[int, int]:
    """The class of each length: the longest one in it. Classes are runs of lengths with about as many tokens each, about `most`
    of them, so a hot length has its own. Lengths under a 64th of the capacity have none: they go into gaps."""
    steps: dict[int, list[int]] = {}
    for length in sorted(counts):
        if length >= capacity // 64:
            steps.setdefault(-(-length // grid), []).append(length)
    part = sum(length * counts[length] for own in steps.values() for length in own) / most
    out, run, tokens = {}, [], 0.0
    for own in steps.values():
        now = sum(length * counts[length] for length in own)
        if run and len(steps) > most and tokens + now > part:
            out |= dict.fromkeys(run, run[-1])
            run, tokens = [], 0.0
        elif len(steps) <= most and run:
            out |= dict.fromkeys(run, run[-1])
            run = []
        run, tokens = run + own, tokens + now
    return out | dict.fromkeys(run, run[-1] if run else 0)


@dataclass(frozen=True)
class Plan:
    """groups of equal sequences: (lengths in a sequence, number of such sequences), which use up the histogram exactly; how
    many sequences configurations of the program opened, and the least number that their tokens need."""

    groups: list[tuple[tuple[int, ...], int]]
    by_program: int
    least: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.groups)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, grid: int = 1, rounds: int | None = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    return make_plan(counts, capacity, grid, rounds).groups


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, grid: int = 1, rounds: int | None = ROUNDS, passes: int = PASSES, share: float = 0.97) -> Plan:
    """The program is solved and rounded in passes. A pass takes half of the solution, rounded down, in configurations that fill
    `share` of a sequence; what is left is a program of its own, whose solution knows which lengths have become scarce."""
    left = {k: n for k, n in counts.items() if n}
    least = -(-sum(k * n for k, n in left.items()) // capacity)
    groups = [((capacity,), left.pop(capacity))] if capacity in left else []
    rest = dict(left)
    for _ in range(passes):
        of = length_classes(left, capacity, grid)
        if not of:
            break
        demand: dict[int, int] = {}
        for length, k in of.items():
            demand[k] = demand.get(k, 0) + left[length]
        keys = sorted(demand)
        x = solve_configurations(np.array(keys), np.array([demand[k] for k in keys], float), capacity, rounds)[0]
        placed = _Left(left, of, capacity)
        new = _rounded(placed, {tuple((keys[k], n) for k, n in c): v for c, v in x.items()}, capacity, share)
        if not new:
            break
        groups += new
        left = {k: n for k, n in enumerate(placed.n) if n}
    by_program = sum(n for _, n in groups)
    full = [g for g in groups if g[0] == (capacity,)]
    return Plan(full + _best_fit([g for g in groups if g[0] != (capacity,)], rest, capacity), by_program, least)


class _Left:
    """The pieces not yet placed, by length and by class."""

    def __init__(self, counts: dict[int, int], of: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for length, n in counts.items():
            self.n[length] = n
        self.of = of
        self.classes: dict[int, list[int]] = {}
        for length in sorted(of, reverse=True):
            self.classes.setdefault(of[length], []).append(length)

    def take(self, config: tuple, capacity: int) -> tuple[list[int], int] | None:
        """Lengths for one sequence of the configuration and how many sequences can take the same; None if a class has too few.
        Classes give their longest pieces; the gap that is left goes to the shortest one, for which the longest piece comes
        that fits, of whatever class."""
        out: list[int] = []
        for k, need in config:
            own = self.classes[k]
            while own and not self.n[own[0]]:  # used up for good
                own.pop(0)
            for length in own:
                now = min(need, self.n[length])
                out += [length] * now
                need -= now
                if not need:
                    break
            if need:
                return None
        out.sort(reverse=True)
        used = Counter(out[:-1])
        last = capacity - sum(out[:-1])
        while last > out[-1] and self.n[last] <= used[last]:
            last -= 1
        out[-1] = last
        used = Counter(out)
        return sorted(out, reverse=True), min(self.n[length] // n for length, n in used.items())

    def remove(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.n[length] -= times


def _rounded(left: _Left, x: dict[tuple, float], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences of configurations that fill the share, the fullest ones first: half as often as the solution says, or
    once where that is less than one and the solution near one. Takes the pieces out of left."""
    groups, fill = [], {c: sum(k * n for k, n in c) for c in x}
    for config in sorted((c for c in x if fill[c] >= share * capacity), key=lambda c: (-fill[c], -x[c], c)):
        times = int(x[config] / 2) or int(x[config] > 0.5)
        while times > 0 and (found := left.take(config, capacity)):
            lengths, most = found
            if sum(lengths) < share * capacity:
                break
            now = min(times, most)
            left.remove(lengths, now)
            groups.append((tuple(lengths), now))
            times -= now
    return groups


def _best_fit(groups: list, counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Puts what the groups leave of the counts, longest first, where the smallest gap holds it, else into new sequences."""
    left = Counter(counts)
    by_gap: list[list] = [[] for _ in range(capacity + 1)]
    for lengths, n in groups:
        by_gap[capacity - sum(lengths)].append([lengths, n])
        for length in lengths:
            left[length] -= n
    rest = sorted(((length, n) for length, n in left.items() if n), reverse=True)
    for length, n in rest:
        gap = length
        while n:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                if n >= each:
                    by_gap[capacity - each * length].append([(length,) * each, n // each])
                if n % each:
                    by_gap[capacity - n % each * length].append([(length,) * (n % each), 1])
                break
            group = by_gap[gap][-1]
            now = min(n, group[1])
            by_gap[gap - length].append([(*group[0], length), now])
            group[1] -= now
            n -= now
            if not group[1]:
                by_gap[gap].pop()
    return [(tuple(sorted(lengths, reverse=True)), n) for own in by_gap for lengths, n in own]


def place_table(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of `length` from rank `rank` on fill `each` places a sequence from `sequence`, `offset` on."""
    rows, used, sequence = [], {}, 0
    for lengths, n in groups:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += each * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


# -- the operator ----------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False, shards: int = 64) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cut = saved(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = place_table(plan_sequences(counts, capacity))
    start = (table["length"] << 40) | table["rank"]

    ranked = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = ranked.groupBy("length", "_shard").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_shard")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = ranked.withColumn("_own", own).join(before, ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(start, (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64), "right") - 1
        nth = rank.to_numpy(np.int64) - table["rank"][k]
        return pd.DataFrame({"sequence_id": table["sequence"][k] + nth // table["each"][k], "offset": table["offset"][k] + nth % table["each"][k] * table["length"][k]})

    out = ranked.withColumn("_place", place("length", "_rank"))
    return out.select(*cut.columns, "_place.sequence_id", "_place.offset")
