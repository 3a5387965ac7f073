"""Large blocks in pieces: the same phase as the kernel gives them as one row."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.operators import phasing, scans, splitting


def random_block(r, n, noise, reach):
    """Connected block of ``n`` variants with local connections, some of them wrong or ties."""
    hap = [r.randint(0, 1) for _ in range(n)]
    edges = {}
    for i in range(1, n):
        for j in {i - 1, *(max(0, i - r.randint(1, reach)) for _ in range(r.randint(0, 2)))}:
            c = hap[i] ^ hap[j]
            edges[(j, i)] = -1 if r.random() < noise / 3 else c ^ (r.random() < noise)
    return [(a, b, int(c)) for (a, b), c in sorted(edges.items())]


def tables(spark, cases):
    nodes = spark.createDataFrame([("c", f"b{k:03}", i) for k, (n, _) in enumerate(cases) for i in range(n)], "contig string, block string, idx int").repartition(3)
    edges = spark.createDataFrame([("c", f"b{k:03}", a, b, c) for k, (_, es) in enumerate(cases) for a, b, c in es], "contig string, block string, ia int, ib int, config int").repartition(3)
    return nodes, edges


@pytest.fixture(scope="module")
def cases():
    r = random.Random(8)
    out = [(n, random_block(r, n, noise, reach)) for n, noise, reach in [(2, 0, 1), (3, 0.5, 2), (4, 0.5, 3), (7, 0.4, 5), (40, 0, 3), (200, 0.1, 2), (300, 0.2, 12), (150, 0.5, 40), (90, 0.9, 1)]]
    for _ in range(40):
        n = r.randint(2, 60)
        out.append((n, random_block(r, n, r.choice([0, 0.05, 0.3, 0.7]), r.choice([1, 2, 6, 20]))))
    return out


def test_cut_points(spark, cases):
    nodes, edges = tables(spark, cases)
    for most, chunk in ((15, 16), (2, 7), (0, 1 << 16)):
        got = {}
        for x in splitting.cut_points(nodes, edges, most, chunk).collect():
            got.setdefault(x["block"], []).append(x["at"])
        for k, (n, e) in enumerate(cases):
            assert sorted(got.get(f"b{k:03}", [])) == phasing.split_points(n, e, most or n), (most, k)


def test_same_phase_as_one_row(spark, cases):
    nodes, edges = tables(spark, cases)
    for most, chunk in ((15, 16),):
        got = {}
        for x in splitting.phase_large(nodes, edges, most, chunk).collect():
            got.setdefault(x["block"], {}).setdefault(x["at"], {})[x["idx"]] = x["hap_a"]
        for k, (n, e) in enumerate(cases):
            own = [(at, "".join(str(v) for _, v in sorted(cells.items()))) for at, cells in sorted(got.get(f"b{k:03}", {}).items())]
            assert own == phasing.phase_block(n, e, most), (most, k)


def test_phase_takes_either_way(spark, cases):
    rows = [("c", f"v{k:03}.{a:04}", a + 1000 * k, f"v{k:03}.{b:04}", b + 1000 * k, c) for k, (_, es) in enumerate(cases) for a, b, c in es]
    edges = spark.createDataFrame(rows, "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int").cache()
    blocks = phasing.blocks_of(edges).cache()
    want = sorted(map(tuple, phasing.phase(edges, blocks).collect()))
    assert sorted(map(tuple, phasing.phase(edges, blocks, large=20).collect())) == want


def test_a_very_large_block(spark):
    """Fragments stay small whatever the block; its phase is found again."""
    r = random.Random(2)
    n = 6_000
    edges = random_block(r, n, 0.01, 3)
    e = spark.createDataFrame([("c", "b", *x) for x in edges], "contig string, block string, ia int, ib int, config int")
    nodes = spark.range(n).select(F.lit("c").alias("contig"), F.lit("b").alias("block"), F.col("id").cast("int").alias("idx"))
    got = splitting.phase_large(nodes, e, chunk=1500).orderBy("idx").collect()
    want = [(at, at + i, int(x)) for at, c in phasing.phase_block(n, edges) for i, x in enumerate(c)]
    assert [(x["at"], x["idx"], x["hap_a"]) for x in got] == want
    cuts = [0, *(x["at"] for x in splitting.cut_points(nodes, e, 15, 1500).orderBy("at").collect()), n]
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= 15


def test_running_values(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, *range(-5, 6)])) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    for how, f in (("sum", lambda v: sum(v)), ("max", lambda v: max(v, default=None)), ("min", lambda v: min(v, default=None))):
        for backwards in (False, True):
            for x in scans.running(df, ["k"], "at", "v", how, "out", backwards, chunk=7).collect():
                own = [v for k, i, v in rows if k == x["k"] and v is not None and (i >= x["at"] if backwards else i <= x["at"])]
                assert x["out"] == f(own)


def test_numbers_of_a_global_order(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.randint(0, 10**6), i) for i in range(5000)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = scans.numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(6), "n", "k", "v", start=1)
        assert df.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(key)
    got = df.orderBy("n").collect()
    assert [x["n"] for x in got] == list(range(1, 5001))
    assert [(x["k"], x["v"]) for x in got] == sorted((k, v) for k, v, _ in rows)
    assert scans.numbered(df.limit(0).drop("n"), "n", "k").collect() == []
