import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandspark.llm.neighbours import CentroidGraph, IndexConfig, nearest
from strandspark.llm.q_neighbours import query


def brute(rows, is_query, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 4:
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = []
    for q in filter(is_query, ok):
        d = sorted((min(float(np.sqrt(((ok[q][0] - x) ** 2).sum())) for x in xs), i) for i, xs in ok.items() if i != q)
        out += [(q, r, i, s) for r, (s, i) in enumerate(d[:k], 1)]
    return sorted(out)


def test_awkward_vectors_and_ties(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(300)]
    rows += [(900, None), (1000, [0.0] * 4), (1100, [1.0, None, 2.0, 3.0]), (1200, [1.0, float("nan"), 2.0, 3.0]), (1300, [float("inf"), 0.0, 0.0, 1.0]), (1400, [1.0, 2.0]), (None, [1.0] * 4), rows[100], rows[100], rows[7]]
    df = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    config = IndexConfig(per_list=20, part=16, ratio=9.0)
    got = sorted(tuple(x) for x in nearest(df, F.col("vec_id") % 100 == 0, 10, config=config).collect())
    assert got == brute(rows, lambda i: i % 100 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0, 10).collect() == []
    assert nearest(df.limit(1), F.col("vec_id") % 100 == 0, 10).collect() == []


def recall(rows, got, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    hit = total = 0
    for i in np.flatnonzero(queries(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = set(ids[np.lexsort((ids, d))[:k]].tolist())
        assert len(got[ids[i]]) == k
        hit, total = hit + len(best & set(got[ids[i]])), total + k
    return hit / total


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_recall(spark):
    """At the query's own settings, on the largest small table there is."""
    import os

    sf = "/root/testdata/check_s" if os.path.isdir("/root/testdata/check_s") else "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(rows, by_query(query(spark, sf)), lambda ids: ids % 100 == 0) >= 0.95


def test_recall_and_pruning_of_clustered_vectors(spark):
    """Many lists in many cells: few are read, and nearly all neighbours found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = nearest(df, F.col("vec_id") % 100 == 0, 10, config=IndexConfig(per_list=50, part=64, cell_part=500))
    assert recall(rows, by_query(got), lambda ids: ids % 100 == 0) >= 0.9


def test_a_third_of_all_vectors_are_equal(spark):
    """They share one list; its parts meet its queries in blocks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 4)).round(1)
    rows = [(i, (x[0] if i % 3 == 0 else x[i]).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0, 10, config=IndexConfig(per_list=40, part=8, cell_part=50, ratio=50.0)).collect())
    want = []
    for q in range(0, 900, 10):
        d = sorted((float(np.sqrt(((np.array(rows[q][1]) - np.array(v)) ** 2).sum())), i) for i, v in rows if i != q)
        want += [(q, r, i, s) for r, (s, i) in enumerate(d[:10], 1)]
    assert [t[:3] for t in got] == [t[:3] for t in sorted(want)]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(7)
    c = rng.normal(size=(300, 8))
    g = CentroidGraph.build(c, IndexConfig(ratio=1.3), np.full(300, 5))
    hit = total = 0
    for q in rng.normal(size=(50, 8)):
        found, best = g.search(q, 20)
        d = np.sqrt(((c - q) ** 2).sum(1))
        assert len(found) >= 4 and [x for x, _ in found] == sorted(x for x, _ in found) and best >= d.min() - 1e-9
        want = set(np.flatnonzero(d <= 1.3 * d.min()).tolist())
        hit, total = hit + len(want & {i for _, i in found}), total + len(want)
    assert hit / total > 0.95
