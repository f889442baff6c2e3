from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvath.llm import packing

LIMITS = "limit_name string, max_size int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_is_valid_and_not_below_the_bound(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins, fill = packing.best_fit_decreasing(sizes, 20)
    assert all(f <= 20 for f in fill)
    assert np.array_equal(np.bincount(bins, weights=sizes, minlength=len(fill)).astype(int), fill)
    assert packing.lower_bound(sizes, 20) <= len(fill)


def test_bounds_by_dual_feasible_functions():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # volume alone says 2
    assert packing.lower_bound(np.array([4] * 6), 10) == 3
    assert packing.lower_bound(np.array([], dtype=int), 10) == 0


def test_whole_items_and_capacity(spark):
    rows = [(i, (i * 37) % 90) for i in range(400)] + [(1000, 250), (1001, None), (None, 7), (3, (3 * 37) % 90)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([("a", 100), ("b", 64)], LIMITS)
    packed = packing.pack(sizes, limits, group_items=60)
    got = packed.collect()
    expected = {(d, n) for d, n in rows if n}
    for name, capacity in (("a", 100), ("b", 64)):
        fill, items = defaultdict(int), defaultdict(list)
        for r in got:
            if r.limit_name == name:
                fill[r.container_id] += r.n_tokens
                items[r.doc_id].append((r.token_start, r.n_tokens))
        assert max(fill.values()) <= capacity
        assert {(d, sum(n for _, n in p)) for d, p in items.items()} == expected
        assert all(len(p) == 1 for d, p in items.items() if sum(n for _, n in p) <= capacity)
        for p in items.values():
            at = 0
            for start, n in sorted(p):
                assert start == at
                at += n
        assert all(r.container_fill == fill[r.container_id] for r in got if r.limit_name == name)
    report = {r.limit_name: r for r in packing.certificate(packed, limits).collect()}
    assert all(r.lower_bound <= r.containers <= r.lower_bound * 1.05 + 1 for r in report.values())


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(sizes, spark.createDataFrame([("a", 100)], LIMITS)).count() == 0


def test_bound_of_a_histogram_needs_no_row_per_item():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 65, 500)
    values, items = np.unique(sizes, return_counts=True)
    assert packing.lower_bound(values, 64, items) == packing.lower_bound(sizes, 64)
    assert packing.lower_bound(np.array([40, 24]), 64, np.array([10**12, 10**12])) == 10**12
