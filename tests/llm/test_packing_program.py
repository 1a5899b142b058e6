import numpy as np

from spanweave.llm import packing as P
from tests.llm.test_packing import used

HOT = {668: 100_000, 680: 100_000, 700: 100_000, **{k: 50 for k in range(300, 660)}}


def sequences(counts):
    groups = P.plan_sequences(dict(counts))
    assert used(groups) == counts and all(sum(v) <= P.CAPACITY for v, _ in groups)
    return sum(n for _, n in groups)


def test_hot_lengths_that_fill_a_sequence_together():
    bound = -(-sum(k * n for k, n in HOT.items()) // P.CAPACITY)
    assert sequences(HOT) <= 1.003 * bound


def test_small_histograms_against_the_fewest_sequences():
    rng = np.random.default_rng(3)
    for _ in range(8):
        lengths = rng.integers(3, 20, 9).tolist()
        counts = {int(k): lengths.count(k) for k in lengths}
        got = sum(n for _, n in P.plan_sequences(counts, 20))

        def fewest(left, bins):  # every way, with bins in falling order
            if not left:
                return len(bins)
            x, out = left[0], len(bins) + 1 + len(left)
            for i in range(len(bins)):
                if bins[i] >= x and bins[i] not in bins[:i]:
                    out = min(out, fewest(left[1:], bins[:i] + [bins[i] - x] + bins[i + 1 :]))
            return min(out, fewest(left[1:], [*bins, 20 - x]))

        assert got <= fewest(sorted(lengths, reverse=True), []) + 1


def test_the_program_places_most_sequences():
    counts = {k: 200 for k in range(100, 2048)}
    plan = P.make_plan(counts)
    assert used(plan.groups) == counts and plan.by_program >= 0.85 * plan.sequences and plan.sequences <= 1.02 * plan.least


def test_program_is_solved_to_the_gap():
    for counts in (HOT, {k: 5000 for k in range(1, 2048)}, {k: 100_000 // k + 1 for k in range(1, 2048)}):
        of = P.length_classes(counts, P.CAPACITY)
        assert all(length <= k for length, k in of.items()) and {k for k in counts if k >= 32} == set(of)
        demand = {}
        for length, k in of.items():
            demand[k] = demand.get(k, 0) + counts[length]
        keys = sorted(demand)
        x, bound = P.solve_configurations(np.array(keys), np.array([demand[k] for k in keys], float), P.CAPACITY)
        got = np.zeros(len(keys))
        for config, v in x.items():
            assert sum(keys[k] * n for k, n in config) <= P.CAPACITY
            for k, n in config:
                got[k] += v * n
        assert (got >= 0.99999 * np.array([demand[k] for k in keys])).all()
        assert bound <= sum(x.values()) <= (1 + P.GAP + 1e-6) * bound
