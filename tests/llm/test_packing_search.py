"""The search of the packing plan completes plans on histograms of many lengths, with fillings that leave no room for a piece left."""

from collections import Counter

import numpy as np

from canopygrid.llm import packing


def lengths_of(documents):
    drawn = np.random.default_rng(3).lognormal(6, 1.1, documents).astype(int)
    return {k: 10 * v for k, v in Counter(np.clip(drawn, 1, 4096).tolist()).items()}


def test_budget_follows_the_distinct_lengths():
    assert packing.budget(dict.fromkeys(range(1, 4097), 1)) >= 4 * 4096
    assert packing.budget({1: 1}) == packing.SEARCH_NODES


def test_fillings_leave_no_room_for_a_piece():
    counts = {57: 500, 31: 500, 30: 500, 2: 500}
    found = packing.Completion(counts, 4096, 0).fillings(4000)
    assert found and all(sum(f) >= 3999 and all(f.count(x) <= counts[x] for x in f) for f in found)


def test_search_reaches_the_bound_where_best_fit_does_not():
    histogram = lengths_of(6000)
    bound, capacity = packing.lower_bound(histogram, 4096), 4096
    assert sum(times for _, times in packing.best_fit(histogram, capacity)) > bound
    found, used = packing.plan(histogram, capacity), Counter()
    for lengths, times in found:
        assert sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert used == Counter(histogram) and sum(times for _, times in found) == bound
