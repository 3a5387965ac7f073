import math
import random

import numpy as np
import pytest
from strandspark.llm import q_whitening
from strandspark.llm.whitening import Summary, Whitening, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x int, component string"


def brute(rows, dim, k=4):
    """(kept rows' x, n, sums, eigenvalues and eigenvectors of the different vectors' covariance)."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), float)
    c = fit - fit.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    return kept, fit, e[::-1][:k], v.T[::-1][:k], e.sum()


def check(spark, rows, dim, k=4):
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], SCHEMA).repartition(5)
    got = whiten(df, components=k).collect()
    kept, fit, e, v, total = brute(rows, dim, k)
    n, sums = len(fit), fit.sum(0)
    assert len(got) == len(kept) * min(k, dim)
    by = {}
    for r in got:
        by.setdefault((str(r["vec_id"]), r["deviation"]), []).append(r)
    for comp in range(1, min(k, dim) + 1):
        own = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == comp)
        want = sorted((str(i), int(((n * np.array(x) - sums) ** 2).sum()), float((np.array(x) - sums / n) @ v[comp - 1] / np.sqrt(e[comp - 1]))) for i, x in kept)
        assert [x[:2] for x in own] == [x[:2] for x in want]
        a, b = (np.array([x[2] for x in rs]) for rs in (own, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / total, rel=1e-9)


def rows(seed, n=300, dim=12):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim)) * np.linspace(2, 0.1, dim) + 5
    out = [(i, list(map(float, v))) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0] * (dim - 1) + [None]), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, []), (905, [1.0] * 3)]
    return out + bad + [out[4], out[4], (77, out[9][1]), (None, out[5][1]), (None, [0.0] * dim)]


def test_against_eigenvectors(spark):
    check(spark, rows(1), 12)
    check(spark, rows(2, n=90, dim=5), 5)


def test_fewer_vectors_than_dimensions(spark):
    data = [(i, [float(i == j) * (j + 1) for j in range(20)]) for i in range(4)]
    got = whiten(spark.createDataFrame([(i, v, 1, 2, "c") for i, v in data], SCHEMA)).collect()
    assert len(got) == 16
    for r in got:  # four vectors span three directions
        assert (r["whitened"] is None) == (r["component"] == 4) and r["identity_error"] < 1e-9


def test_degenerate_tables(spark):
    frame = lambda data: spark.createDataFrame([(i, v, 1, 2, "c") for i, v in data], SCHEMA)
    assert whiten(frame([])).collect() == [] and whiten(frame([(1, None), (2, [])])).collect() == []
    same = whiten(frame([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in same)
    line = whiten(frame([(1, [0.0]), (2, [1.0]), (3, [1.0])])).collect()
    assert sorted((r["vec_id"], abs(r["whitened"])) for r in line) == [(1, 1.0), (2, 1.0), (3, 1.0)] and line[0]["n"] == 2


def test_merging_loses_nothing():
    """Any tree of merges has the singular values of the whole."""
    r = random.Random(5)
    g = np.random.default_rng(5)
    x = (g.normal(size=(500, 9)) * [900, 400, 90, 30, 9, 3, 1, 1, 1]).astype(np.int64) + 12345
    cuts = sorted(r.sample(range(1, 500), 12))
    parts = [Summary.of(p) for p in np.split(x, cuts)]
    while len(parts) > 1:
        r.shuffle(parts)
        parts = [parts[0].merge(parts[1]), *parts[2:]]
    whole = Summary.of(x)
    assert parts[0].n == 500 and (parts[0].total == x.sum(0)).all() and len(parts[0].values) == 9
    assert np.allclose(parts[0].values, whole.values, rtol=1e-10)
    assert np.allclose(np.abs((parts[0].vectors * whole.vectors).sum(1)), 1)


def test_deviation_beyond_64_bits():
    s = Summary(1 << 20, np.array([0, 0]), np.array([1.0]), np.array([[1.0, 0.0]]))
    x = np.array([[1 << 28, 1 << 28], [3, 4]])
    assert Whitening(s).deviation(x) == [None, 25 << 40]


def test_query(spark):
    got = q_whitening.query(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = got.collect()
    w = np.array([r["whitened"] for r in sorted(out, key=lambda r: (r["component"], r["vec_id"]))]).reshape(4, -1)
    assert np.abs(w @ w.T / w.shape[1] - np.eye(4)).max() < 1e-4 and out[0]["identity_error"] < 1e-4
