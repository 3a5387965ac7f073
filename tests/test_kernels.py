import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandspark.operators import phasing
from strandspark.operators.graph import components


def brute_phase(n, edges):
    got = {}
    for rest in itertools.product("01", repeat=n - 1):
        c = "0" + "".join(rest)
        got[c] = sum(k >= 0 and (int(c[a]) ^ int(c[b])) == k for a, b, k in edges)
    best = [c for c, s in got.items() if s == max(got.values())]
    return best[0] if len(best) == 1 else "-" * n


blocks = st.integers(2, 8).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.sampled_from([0, 0, 1, 1, -1])).filter(lambda e: e[0] < e[1]), max_size=16, unique_by=lambda e: e[:2])))


@settings(max_examples=200, deadline=None)
@given(blocks)
def test_exhaustive(block):
    n, edges = block
    assert phasing.exhaustive(n, edges) == brute_phase(n, edges)


@settings(max_examples=200, deadline=None)
@given(blocks)
def test_concordant_is_the_best(block):
    n, edges = block
    got = phasing.concordant(n, edges)
    if got is not None:
        assert got == brute_phase(n, edges)
        assert phasing.support(phasing.np.array([[int(x) for x in got]]), edges)[0] == sum(k >= 0 for _, _, k in edges)


@settings(max_examples=200, deadline=None)
@given(blocks, st.integers(0, 6))
def test_stretches(block, most):
    n, edges = block
    for compat in (False, True):
        out = phasing.phase_block(n, edges, most, compat)
        ends = [(a, a + len(c)) for a, c in out]
        assert all(c[0] == "0" and set(c) <= {"0", "1"} and len(c) >= 2 for _, c in out)
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:])) and all(e <= n for _, e in ends)
    for a, cut in zip([0, *phasing.split_points(n, edges, most or n)], [*phasing.split_points(n, edges, most or n), n]):
        assert cut - a >= 2 or n < 4


@settings(max_examples=100, deadline=None)
@given(blocks)
def test_crossing(block):
    n, edges = block
    assert phasing.crossing(n, edges).tolist() == [sum(a < p <= b for a, b, _ in edges) for p in range(n)]


def test_recovers_simulated_phase():
    r = random.Random(8)
    for _ in range(20):
        n = r.randint(3, 40)
        truth = [0] + [r.randint(0, 1) for _ in range(n - 1)]
        edges = [(a, b, truth[a] ^ truth[b]) for a in range(n) for b in range(a + 1, min(n, a + 4))]
        bad = r.randrange(len(edges))
        a, b, c = edges[bad]
        if b - a > 1:
            edges[bad] = (a, b, 1 - c)
        got = phasing.phase_block(n, edges)
        assert [c for _, c in got] == ["".join(map(str, truth))] or sum(len(c) for _, c in got) >= n - 3


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    n = 200
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    df = spark.createDataFrame(pairs, "u long, v long")
    assert dict(components(df).collect()) == want
    names = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "u string, v string")
    assert len(set(dict(components(names).collect()).values())) == len(set(want.values()))
    assert components(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 31, 64])
def test_medians_as_of_drawn_resamples(n):
    """The same distribution as of resamples that are drawn value by value."""
    import numpy as np

    from strandspark.functions.stats import resampled_medians

    rng = np.random.default_rng(n)
    values = np.sort(rng.normal(size=n).round(1))
    times = 60_000
    quick = resampled_medians(values, times, rng)
    drawn = np.median(rng.choice(values, (times, n)), axis=1)
    spots = np.unique(np.concatenate([quick, drawn]).round(9))
    share = lambda x: np.searchsorted(np.sort(x.round(9)), spots, "right") / times
    assert np.abs(share(quick) - share(drawn)).max() < 1.95 * np.sqrt(2 / times)


def test_median_of_few_values_exactly():
    """Three values: the median's ranks have 7, 13 and 7 of 27 chances."""
    import numpy as np

    from strandspark.functions.stats import resampled_medians

    got = resampled_medians(np.array([1.0, 2.0, 3.0]), 270_000, np.random.default_rng(1))
    assert np.allclose([(got == v).mean() for v in (1, 2, 3)], [7 / 27, 13 / 27, 7 / 27], atol=0.004)
